"""Tables that outlive an executor: written to the folder the cluster shares, then reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is absent, a local one in local mode; a cluster needs it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="capstan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the finished write have no more use; a collection on the driver lets Spark's cleaner delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/capstan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned, once all that is derived from them has been written itself."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for long texts; never raises a lower setting. The setting stays with the session,
    as Spark reads it when a result is computed and not when it is declared."""
    if int(spark.conf.get(_ARROW_ROWS, "10000")) > rows:
        spark.conf.set(_ARROW_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names for ``names`` that ``df`` does not have, whatever the case, so helpers cannot meet a user's column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = n
        while k.lower() in taken:
            k += "_"
        taken.add(k.lower())
        out.append(k)
    return out


def held(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with columns that the optimiser will not copy into the expressions that use them.

    An expression inlined into a lambda would run once for each array element; a generator over one row keeps
    it apart at the cost of one copy.
    """
    (inner,) = private(df, "_held")
    return df.select("*", F.explode(F.array(F.struct(*columns))).alias(inner)).select(*df.columns, f"{inner}.*")
