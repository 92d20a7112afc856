"""Synthetic tables from a recipe; a value depends on the seed, the row and the column alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import hash_uniform
from ..sources.files import read_csv, write_csv

# Rows, seed and id pattern of a recipe that names none.
DEFAULT_ROWS, DEFAULT_SEED, DEFAULT_PATTERN = 50_000, 91_735_246, "id-{seq:05d}"
ROW = "_row"
#: Rows that are numbered in one task; a group of any size is numbered in blocks of these.
BLOCK_ROWS = 1 << 16


def _unit(name: str, seed: int) -> Column:
    return hash_uniform(F.col(ROW), F.lit(seed), F.lit(name))


def sample(name: str, spec: dict, seed: int, built: list[str]) -> Column:
    values = spec["values"]
    weights = spec.get("weights") or [1] * len(values)
    total, upto, u = float(sum(weights)), 0.0, _unit(name, seed)
    out = F.lit(values[-1])
    bounds = []
    for w in weights[:-1]:
        upto += w / total
        bounds.append(upto)
    for v, b in reversed(list(zip(values[:-1], bounds))):
        out = F.when(u < b, F.lit(v)).otherwise(out)
    return out


def bernoulli(name: str, spec: dict, seed: int, built: list[str]) -> Column:
    """Two labels; the row's latent rate, shared by all columns, adds to the probability."""
    yes, no = spec.get("labels") or ("Yes", "No")
    p = F.lit(float(spec.get("p", 0.1))) + F.lit(float(spec.get("p_with_baserate", 0.0))) * _unit("_baserate", seed)
    return F.when(_unit(name, seed) < p, F.lit(yes)).otherwise(F.lit(no))


def poisson_steps(rate: float) -> list[float]:
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(int(rate + 12 * math.sqrt(rate) + 20)):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def poisson(name: str, spec: dict, seed: int, built: list[str]) -> Column:
    """The inverse of the distribution function, raised to the least value."""
    steps = F.array(*(F.lit(s) for s in poisson_steps(float(spec.get("lambda", 1.0)))))
    u = _unit(name, seed)
    count = F.get(F.transform(F.array(u), lambda x: F.size(F.filter(steps, lambda s: x >= s))), F.lit(0))  # u is drawn once, not for each step
    return F.greatest(count, F.lit(int(spec.get("min", 0))))


def sequence(name: str, spec: dict, seed: int, built: list[str]) -> Column:
    return F.col(ROW) + int(spec.get("from", 1))


def id_pattern(name: str, spec: dict, seed: int, built: list[str]) -> Column:
    """``{seq:05d}``, and ``{year}`` where a year column is built already; then ``number_within`` must have numbered the rows."""
    year = spec.get("year_col")
    out = F.lit(spec.get("pattern") or DEFAULT_PATTERN)
    if year and year in built:
        number = F.col(f"_number_{name}")
        out = F.replace(out, F.lit("{year}"), F.col(year).cast("string"))
    else:
        number = F.col(ROW) + 1
    return F.replace(out, F.lit("{seq:05d}"), F.format_string("%05d", number))


def number_within(df: DataFrame, key: str, out: str, order: str = ROW, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``out``, the place of each row among those of its ``key`` by ``order`` (a whole number), from 1.

    Rows are numbered within blocks of ``order`` and moved on by the rows of the key's earlier blocks, so that a
    key that holds most rows is not sorted in one task.
    """
    at = F.floor(F.col(order) / block).cast("long")
    blocks = df.groupBy(F.col(key).alias("_key"), at.alias("_block")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_key", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(key, "_at").orderBy(order))
    numbered = df.withColumn("_at", at).withColumn(out, inside)
    joined = numbered.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_block")))
    return joined.withColumn(out, F.col(out) + F.col("_offset")).drop("_at", "_key", "_block", "_offset")


TYPES = {"sample": sample, "bernoulli": bernoulli, "poisson": poisson, "id_pattern": id_pattern, "sequence": sequence}


def make_column(name: str, spec: dict, seed: int, built: list[str] = ()) -> Column:
    kind = spec.get("type", "sample")
    if kind not in TYPES:
        raise ValueError(f"unknown column type {kind!r}")
    return TYPES[kind](name, spec, seed, list(built))


def add_column(df: DataFrame, name: str, spec: dict, seed: int, built: list[str] = ()) -> DataFrame:
    """``df`` (with ROW) with one more column; ids by year are numbered first."""
    year = spec.get("year_col") if spec.get("type") == "id_pattern" else None
    if not year or year not in built:
        return df.withColumn(name, make_column(name, spec, seed, built))
    number = f"_number_{name}"
    return number_within(df, year, number).withColumn(name, make_column(name, spec, seed, built)).drop(number)


def _rows_of(spark: SparkSession, recipe: dict, rows: int | DataFrame | None, seed: int | None) -> DataFrame:
    """The recipe's columns, in its order, and ROW: the numbers up to ``rows``, or what a table of row numbers holds. With ``row_replication`` each row is repeated by a weighted random count and ids are
    given after that; ids without a year column cannot be replicated."""
    seed = recipe.get("seed", DEFAULT_SEED) if seed is None else seed
    columns: dict = recipe["columns"]
    if isinstance(rows, DataFrame):
        df = rows.select(F.col(rows.columns[0]).cast("long").alias(ROW))
    else:
        df = spark.range(rows or recipe.get("n_rows") or DEFAULT_ROWS).withColumnRenamed("id", ROW)
    again = recipe.get("row_replication")
    late = [c for c, s in columns.items() if s.get("type") == "id_pattern"] if again else []
    built: list[str] = []
    for name, spec in columns.items():
        if name not in late:
            df = add_column(df, name, spec, seed, built)
        built.append(name)
    if again:
        for name in late:
            if not columns[name].get("year_col"):
                raise ValueError(f"{name}: ids without year_col do not follow replicated rows")
        copies = make_column("_copies", {"values": again["values"], "weights": again.get("weights")}, seed)
        df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        df = df.withColumn(ROW, F.col(ROW) * (max(again["values"]) + 1) + F.col("_copy"))
        for name in late:
            df = add_column(df, name, columns[name], seed, list(columns))
    return df.select(ROW, *columns)


def make_table(spark: SparkSession, recipe: dict, rows: int | DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """Columns in the recipe's order, for so many rows or for each row number (one column, all different) of a table; see
    ``_rows_of`` for ``row_replication``."""
    return _rows_of(spark, recipe, rows, seed).drop(ROW)


def make_csv(spark: SparkSession, recipe: dict, path: str, rows: int | None = None, seed: int | None = None, one_file: bool = True) -> dict:
    """Write the recipe's table as CSV with a header under ``path``; path, rows (as written) and seed. One file, in the
    order of the rows, or several, each of a range of rows, unless ``one_file``; equal recipes give equal bytes."""
    seed = recipe.get("seed", DEFAULT_SEED) if seed is None else seed
    made = _rows_of(spark, recipe, rows, seed)
    table = (made.repartition(1).sortWithinPartitions(ROW) if one_file else made.sort(ROW)).drop(ROW)
    write_csv(table, path, one_file)
    return {"path": path, "rows": read_csv(spark, path, table.schema).count(), "seed": seed}
