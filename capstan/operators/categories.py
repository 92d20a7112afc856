"""Ordered categories: a column's levels are kept with it as metadata, so that indices, indicators and tables agree on their order.

A level's index counts from 1 in the order of the levels; a missing value, and one that is no level, has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a column may have: they are kept in its metadata.
MOST_LEVELS = 1000
KEY = "levels"


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The levels that ``column`` carries; None if it has none."""
    return df.schema[column].metadata.get(KEY)


def with_levels(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """``column`` as text with its levels: those given, in their order, or all its values in order. Values that are no level become null."""
    value = F.col(column).cast("string")
    if levels is None:
        levels = _used(df, column)
    elif len(set(levels)) < len(levels):
        raise ValueError(f"levels of {column} repeat")
    known = F.when(value.isin(*levels), value) if levels else F.lit(None).cast("string")
    return df.withColumn(column, known).withMetadata(column, {KEY: list(levels)})


def _used(df: DataFrame, column: str) -> list[str]:
    value = F.col(column).cast("string").alias("level")
    found = [r["level"] for r in df.select(value).filter("level is not null").distinct().orderBy("level").limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return found


def drop_unused(df: DataFrame, column: str) -> DataFrame:
    """``df`` without the levels of ``column`` that no row has; the others keep their order."""
    used = set(_used(df, column))
    return df.withMetadata(column, {KEY: [v for v in _needed(df, column) if v in used]})


def _needed(df: DataFrame, column: str) -> list[str]:
    levels = levels_of(df, column)
    if levels is None:
        raise ValueError(f"{column} has no levels; see with_levels")
    return levels


def level_index(df: DataFrame, column: str) -> Column:
    """The number of each value among the column's levels, from 1."""
    return F.nullif(F.array_position(F.array(*(F.lit(v) for v in _needed(df, column))).cast("array<string>"), F.col(column)), F.lit(0)).cast("int")


def counts(df: DataFrame, column: str) -> DataFrame:
    """level, index, rows: every level in its order, with 0 rows where none has it."""
    levels = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(_needed(df, column), 1)] or [("", 0)], "level string, index int").filter("index > 0")
    rows = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("rows"))
    return levels.join(rows, "level", "left").select("level", "index", F.coalesce("rows", F.lit(0)).alias("rows"))
