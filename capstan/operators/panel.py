"""Person-period panels: lags, change flags, conditional codes, restricted distinct counts, weighted summaries.

A source has one row for each event; columns are named by ``Panel``. All steps but the summaries share one
partitioning, by subject and period: the window and the aggregate after it need a single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import core_mean, core_std, weighted_mean, weighted_var

# Codes of the flag combinations that count, by (first, second, third) flag.
CODES = {(1, 0, 0): "a1", (0, 1, 0): "a2", (1, 1, 0): "a4", (0, 1, 1): "a5", (1, 1, 1): "a7", (0, 0, 0): "a8"}
OTHER = "other"
# Midpoints of the age groups.
MIDPOINTS = {"18 to 24": 21.0, "25 to 49": 42.0, "50+": 57.5}


@dataclass(frozen=True)
class Panel:
    subject: str = "subject"
    period: str = "period"
    place_now: str = "place_now"
    place_last: str = "place_last"
    flags: tuple[str, str, str] = ("flag_1", "flag_2", "flag_3")
    count: str = "n"
    carried: tuple[str, ...] = ()
    tie_break: tuple[str, ...] = ()


def selected(df: DataFrame, names: dict[str, str], casts: dict[str, str] | None = None) -> DataFrame:
    """The columns of a dictionary (new name to old one), renamed, in its order, as the types of ``casts`` where it has them.

    Old names that the table does not have are listed in one error, before anything is read.
    """
    missing = [old for old in names.values() if old not in df.columns]
    if missing:
        raise ValueError("no such columns: " + ", ".join(missing))
    casts = casts or {}
    return df.select(*((F.col(f"`{old}`").cast(casts[new]) if new in casts else F.col(f"`{old}`")).alias(new) for new, old in names.items()))


def combination(flags: tuple[str, str, str]) -> Column:
    """Code of the three flags; a null flag matches no code."""
    out = F.lit(OTHER)
    for values, code in CODES.items():
        met = F.lit(True)
        for name, v in zip(flags, values):
            met = met & (F.col(name) == F.lit(bool(v)))
        out = F.when(met, F.lit(code)).otherwise(out)
    return out


def age_midpoint(age: Column) -> Column:
    out = F.lit(None).cast("double")
    for label, mid in MIDPOINTS.items():
        out = F.when(age == label, F.lit(mid)).otherwise(out)
    return out


def with_moves(df: DataFrame, p: Panel) -> DataFrame:
    """``df`` with code, moved_within, place_before (lag), moved_across and moves."""
    order = Window.partitionBy(p.subject, p.period).orderBy(p.place_now, *p.tie_break)
    now = F.col(p.place_now)
    return (
        df.withColumn("code", combination(p.flags))
        .withColumn("moved_within", (now != F.col(p.place_last)).cast("int"))
        .withColumn("place_before", F.lag(p.place_now).over(order))
        .withColumn("moved_across", (F.col("place_before").isNotNull() & (now != F.col("place_before"))).cast("int"))
        .withColumn("moves", F.col("moved_within") + F.col("moved_across"))
    )


def person_period(df: DataFrame, p: Panel) -> DataFrame:
    """One row for each subject and period: vm (moves), ac (distinct listed codes), np, carried, rc and treat."""
    first = F.struct(p.place_now, *p.tie_break)
    listed = F.when(F.col("code").isin(*CODES.values()), F.col("code"))
    return (
        with_moves(df, p)
        .groupBy(p.subject, p.period)
        .agg(
            F.sum("moves").alias("vm"),
            F.size(F.collect_set(listed)).alias("ac"),
            F.sum(p.count).alias("np"),
            *(F.min_by(c, first).alias(c) for c in p.carried),
            F.concat_ws(" + ", F.array_sort(F.array_distinct(F.concat(F.collect_set(p.place_now), F.collect_set(p.place_last))))).alias("rc"),
        )
        .withColumn("treat", (F.col("ac") >= 2).cast("int"))
    )


def descriptives(panel: DataFrame, x: str = "vm", w: str = "np", treat: str = "treat") -> DataFrame:
    """One row: unweighted and weighted summaries, whole and by treatment."""
    on, off = F.when(F.col(treat) == 1, F.col(x)), F.when(F.col(treat) == 0, F.col(x))
    w_on, w_off = F.when(F.col(treat) == 1, F.col(w)), F.when(F.col(treat) == 0, F.col(w))
    return panel.agg(
        F.count("*").alias("n"), F.sum(w).alias("total"), core_mean(x).alias("mean"), core_std(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        weighted_mean(x, w).alias("w_mean"), F.sqrt(weighted_var(x, w)).alias("w_sd"), F.avg(F.col(treat).cast("double")).alias("treated_share"),
        F.avg(on).alias("mean_1"), F.avg(off).alias("mean_0"), weighted_mean(on, w_on).alias("w_mean_1"), weighted_mean(off, w_off).alias("w_mean_0"),
    )


def long_table(one: DataFrame, scope: str) -> DataFrame:
    """scope, statistic, value from a row of summaries."""
    names = one.columns
    return one.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "statistic", "value").select(F.lit(scope).alias("scope"), "statistic", "value")


def pooled_and_by(df: DataFrame, period: Column, **measures: Column) -> DataFrame:
    """Measures over all rows and by period, the pooled row with a null period."""
    keyed = df.withColumn("period", period)
    return keyed.groupingSets([[], [F.col("period")]], F.col("period")).agg(*(v.alias(k) for k, v in measures.items()))


def expand_by_count(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count says; rows without a positive count go."""
    rows = df.filter(F.col(count) > 0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.dropna(subset=columns)


def change_flag(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with previous and changed: 1 where the value differs from the one before, 0 for the first."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", before).withColumn("changed", (F.col("previous").isNotNull() & (F.col(column) != F.col("previous"))).cast("int"))


def first_match(df: DataFrame, keys: list[str], value: str, position: list[str], where: Column) -> DataFrame:
    """The first row of each key that meets a condition, by position."""
    return df.filter(where).groupBy(*keys).agg(F.min_by(value, F.struct(*position)).alias(value))


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value that occurs most often by key; among equals the longest, then the first in order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    # Largest count, then largest length, then least name: all as one minimum, combined before the shuffle.
    rank = F.struct((-F.col("times")).alias("a"), (-F.length(value)).alias("b"), F.col(value).alias("c"))
    return counts.groupBy(*keys).agg(F.min(rank).alias("r")).select(*keys, F.col("r.c").alias(value), (-F.col("r.a")).alias("times"))


def last_seen(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "seen") -> DataFrame:
    """The nearest non-null value at or before each row (backward as-of)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
