"""Tables that outlive an executor: written once to the folder the cluster shares, then read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own in local mode where that is unset, and no other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="capstan-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it was written: its rows are not worked out again, and lost executors lose none of them."""
    path = f"{folder(df.sparkSession)}/operators/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``df``, of narrow rows, dealt out evenly over as many tasks as its number of rows asks for."""
    return df.repartition(max(1, -(-df.count() // rows_a_task)))
