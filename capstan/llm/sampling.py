"""Bounded, repeatable samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def labelled_sample(rows: DataFrame, label: str, key: tuple[str, ...], per_label: int, classes: int = 1000) -> DataFrame:
    """At most ``per_label`` rows of each value of ``label``, those with the least hashes of ``key``.

    Two passes over the narrow columns. The first counts the rows by label and by a logarithmic class of the hash, combined
    before the shuffle, and gives a threshold by label that leaves few rows more than asked for; the second takes
    the least of these. Rows that are equal in ``key`` are one row. ``classes`` labels are learned at most, the most frequent.
    """
    unit = F.pmod(F.xxhash64(*(F.col(k) for k in key), F.lit(20240607)), F.lit(1 << 60)).cast("double") / float(1 << 60)
    step = F.floor(8 * F.log2(F.greatest(unit, F.lit(2.0**-60)))).cast("int")
    counts: dict[object, dict[int, int]] = {}
    marked = rows.filter(F.col(label).isNotNull()).withColumns({"sample_unit": unit, "sample_step": step})
    totals = marked.groupBy(label, "sample_step").count()
    often = totals.groupBy(label).agg(F.sum("count").alias("all")).orderBy(F.desc("all"), label).limit(classes).select(label)
    for r in totals.join(F.broadcast(often), label).collect():  # classes * 481 rows at most
        counts.setdefault(r[label], {})[r["sample_step"]] = r["count"]
    chosen = F.lit(False)
    for value, by in counts.items():
        sofar, top = 0, 0
        for k in sorted(by):
            top, sofar = k, sofar + by[k]
            if sofar >= per_label:
                break
        chosen = chosen | ((F.col(label) == F.lit(value)) & (F.col("sample_step") <= top))
    near = marked.filter(chosen).dropDuplicates([label, "sample_unit"])
    nth = F.row_number().over(Window.partitionBy(label).orderBy("sample_unit"))  # a few more than per_label rows a label
    return near.withColumn("sample_nth", nth).filter(F.col("sample_nth") <= per_label).drop("sample_nth", "sample_unit", "sample_step")
