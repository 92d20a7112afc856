"""Greedy nearest matching on a continuous score, as a sweep over ranges that carry unmatched stretches to their neighbours.

Treated units are taken from the highest score down, and each takes the nearest control that is left. In the order of scores such
a sweep has a small state: the controls that were passed and left, of which only the last is ever the nearest above, and how many
controls ahead have been taken, always the first ones. So the order is cut into ranges of rows, each swept in a task of its own, and
between ranges go two things: the number of the next free control, and the stretches of controls that earlier ranges have left.

All ranges are swept at once from a guess of what reaches them; a range is swept again while what reaches it differs from what it was
swept with, so the result is that of one sweep from top to bottom. The first range is right at once and each round settles at least one
more; rounds are few as long as most units find a partner within a range or two. The driver holds a few numbers a range, and a
task no more than a range, with as many controls ahead of it and as many left behind as the range has treated units.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import propensity
from .shared import kept

#: Rows of a range; ranges of a smaller number grow up to this one, as long as there are more than LEAST_RANGES of them.
RANGE_ROWS = 1 << 16
LEAST_RANGES = 64

_SWEPT = "range int, kind int, place long, control long, score double, popped long, digest long"
_PAIR, _LEFT, _END = 0, 1, 2


@dataclass
class _Range:
    """What the driver knows of a range: its controls' numbers, how many treated it has, how its last sweep went, and the round that first
    left the controls that it leaves now."""

    begin: int
    end: int
    treated: int
    swept_with: tuple | None = None
    round: int = -1
    left_round: int = -1
    digest: int = 0
    next_control_in: int = 0
    next_control: int = 0
    popped: int = 0
    left: int = 0
    reach: list[tuple[int, int, int]] = field(default_factory=list)


def ranges_of(rows: int, range_rows: int) -> int:
    """How many ranges ``rows`` are cut into: the same rounds settle few large ranges and many small ones, but a round costs by the range."""
    size = max(range_rows, min(RANGE_ROWS, -(-rows // LEAST_RANGES)))
    return max(1, -(-rows // size))


def ordered(df: DataFrame, treat: str, score: str, order: list[str], range_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that have a score and a treatment: range, place, treated, score, row (a struct), by falling score, treated
    first, then ``order``; and the same without row, but with each control's number in the whole order."""
    held = df.select(F.struct(*df.columns).alias("row"), (F.col(treat) == 1).alias("treated"), F.col(score).cast("double").alias("score"), F.struct(*order).alias("key"))
    able = held.filter("treated is not null and score is not null and not isnan(score)")
    ranges = ranges_of(able.count(), range_rows)
    by = [F.desc("score"), F.desc("treated"), "key"]
    dealt = able.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = kept(dealt.select(F.shiftright("at", 33).cast("int").alias("range"), F.expr("at & 8589934591").alias("place"), "treated", "score", "row"), "match-rows")
    counts = rows.groupBy("range").agg(F.count_if(~F.col("treated")).alias("controls")).orderBy("range").collect()  # one row a range
    begins = np.cumsum([0, *(r["controls"] for r in counts)]).tolist()
    offsets = df.sparkSession.createDataFrame([(r["range"], b) for r, b in zip(counts, begins)] or [(0, 0)], "range int, begin long")
    before = F.count_if(~F.col("treated")).over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    light = rows.select("range", "place", "treated", "score", before.alias("before")).join(F.broadcast(offsets), "range")
    number = F.when(~F.col("treated"), F.col("begin") + F.coalesce("before", F.lit(0)))
    return rows, kept(light.select("range", "place", number.alias("control"), "treated", "score"), "match-order")


def sweep(own: pd.DataFrame, ahead: pd.DataFrame, left: pd.DataFrame, next_control: int) -> tuple[list[tuple[int, int]], list[tuple[int, float]], int, int]:
    """Pairs of (a treated's place, a control's number), the controls left (numbers and scores, the last the nearest), the number of the next
    free control, and how many of ``left`` were taken. A control as near on either side is taken from below."""
    mine = own[~own["treated"]]
    numbers = np.concatenate([mine["control"].to_numpy(np.int64), ahead["control"].to_numpy(np.int64)])
    scores = np.concatenate([mine["score"].to_numpy(float), ahead["score"].to_numpy(float)]).tolist()
    j = int(np.searchsorted(numbers, next_control))
    numbers = numbers.tolist()
    stack = list(zip(left["control"].tolist(), left["score"].tolist()))
    low, pairs = len(stack), []
    for treated, score, place, control in zip(own["treated"].tolist(), own["score"].tolist(), own["place"].tolist(), own["control"].tolist()):
        if not treated:
            if control >= next_control:
                stack.append((control, score))
                next_control, j = int(control) + 1, j + 1
            continue
        below = j < len(numbers)
        if below and (not stack or score - scores[j] <= stack[-1][1] - score):
            pairs.append((place, numbers[j]))
            next_control, j = numbers[j] + 1, j + 1
        elif stack:
            pairs.append((place, stack.pop()[0]))
            low = min(low, len(stack))
    return pairs, stack[low:], next_control, len(left) - low


def _swept(light: DataFrame, active: dict[int, _Range], ahead: list[tuple], left: DataFrame | None) -> DataFrame:
    """One round: the active ranges' sweeps, as rows of _SWEPT."""
    spark = light.sparkSession
    starts = {k: r.next_control for k, r in active.items()}
    chosen = F.broadcast(spark.createDataFrame([(k,) for k in active], "range int"))  # a few numbers a range, here and below
    parts = light.join(chosen, "range").select("range", F.lit(0).alias("part"), F.lit(0).cast("long").alias("stretch"), "place", "control", "treated", "score")
    wanted = F.broadcast(spark.createDataFrame(ahead, "source int, first long, last long, to int"))
    more = light.filter("not treated").join(wanted, (F.col("range") == F.col("source")) & (F.col("control") >= F.col("first")) & (F.col("control") < F.col("last")))
    parts = parts.unionByName(more.select(F.col("to").alias("range"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("stretch"), "place", "control", "treated", "score"))
    if left is not None:
        parts = parts.unionByName(left)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["range"].iloc[0])
        own, front, behind = (group[group["part"] == p] for p in range(3))
        pairs, rest, number, popped = sweep(own.sort_values("place"), front.sort_values("control"), behind.sort_values(["stretch", "place"]), starts[k])
        out = [(k, _PAIR, p, c, None, None, None) for p, c in pairs] + [(k, _LEFT, i, c, s, None, None) for i, (c, s) in enumerate(rest)]
        digest = int.from_bytes(blake2b(np.array([c for c, _ in rest], np.int64).tobytes(), digest_size=8).digest(), "big", signed=True)
        out.append((k, _END, len(rest), number, None, popped, digest))
        return pd.DataFrame(out, columns=["range", "kind", "place", "control", "score", "popped", "digest"])

    # A sweep is long for its bytes: a task for each range, which Spark would put together otherwise.
    return parts.repartition(len(active), "range").groupBy("range").applyInPandas(run, _SWEPT)


def _reaching(ranges: dict[int, _Range]) -> list[int]:
    """Work out what reaches each range, as things stand; the ranges that were swept with something else."""
    number, stack, active = 0, [], []  # stack: stretches [range, round that left them, from, to] of left controls, the nearest last
    for k in sorted(ranges):
        r = ranges[k]
        number = max(number, r.begin)
        need, reach = r.treated, []
        for q, at, first, last in reversed(stack):
            if not need:
                break
            take = min(need, last - first)
            reach.append((q, at, last - take, last))
            need -= take
        reach.reverse()
        if r.swept_with != (number, tuple(reach)):
            active.append(k)
        r.next_control_in, r.reach = number, reach
        if r.round < 0:  # not swept yet: a guess
            number = r.end
            continue
        drop = r.popped
        while drop and stack:
            take = min(drop, stack[-1][3] - stack[-1][2])
            stack[-1][3] -= take
            drop -= take
            if stack[-1][2] == stack[-1][3]:
                stack.pop()
        if r.left:
            stack.append([k, r.left_round, 0, r.left])
        number = r.next_control
    return active


def pairs_of(light: DataFrame) -> DataFrame:
    """range and place of a treated, and the number of its control."""
    spark = light.sparkSession
    counts = light.groupBy("range").agg(F.count_if("treated").alias("treated"), F.count_if(~F.col("treated")).alias("controls")).orderBy("range").collect()
    ranges, at = {}, 0
    for r in counts:
        ranges[r["range"]] = _Range(at, at + r["controls"], r["treated"])
        at += r["controls"]
    keys = sorted(ranges)
    ends = [ranges[k].end for k in keys]
    rounds: list[DataFrame] = []
    while active := _reaching(ranges):
        ahead, behind = [], []
        for k in active:
            r = ranges[k]
            first = max(r.end, r.next_control_in)
            last = min(first + r.treated, at)
            i = bisect_right(ends, first)
            while i < len(keys) and first < last:  # the ranges that hold these controls
                ahead.append((keys[i], first, min(last, ends[i]), k))
                first = max(first, ends[i])
                i += 1
            behind += [(q, n, a, b, k, j) for j, (q, n, a, b) in enumerate(r.reach)]
        left = None
        if behind:
            wanted = F.broadcast(spark.createDataFrame(behind, "source int, of int, first long, last long, to int, stretch long"))
            used = sorted({b[1] for b in behind})
            found = [rounds[n].filter(F.col("kind") == _LEFT).withColumn("round", F.lit(n)) for n in used]
            every = found[0]
            for f in found[1:]:
                every = every.unionByName(f)
            met = (F.col("range") == F.col("source")) & (F.col("round") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))
            left = every.join(wanted, met).select(F.col("to").alias("range"), F.lit(2).alias("part"), "stretch", "place", "control", F.lit(False).alias("treated"), "score")
        for k in active:
            ranges[k].next_control = ranges[k].next_control_in
        swept = kept(_swept(light, {k: ranges[k] for k in active}, ahead, left), "match-round")
        for row in swept.filter(F.col("kind") == _END).collect():  # one row a range
            r = ranges[row["range"]]
            r.swept_with = (r.next_control_in, tuple(r.reach))
            if r.left_round < 0 or (r.left, r.digest) != (row["place"], row["digest"]):  # else who was swept with them need not be again
                r.left_round = len(rounds)
            r.round, r.next_control, r.popped, r.left, r.digest = len(rounds), row["control"], row["popped"], row["place"], row["digest"]
        rounds.append(swept)
    last = F.broadcast(spark.createDataFrame([(k, r.round) for k, r in ranges.items()] or [(0, 0)], "range int, round int"))
    out = None
    for n, swept in enumerate(rounds):
        own = swept.filter(F.col("kind") == _PAIR).join(last.filter(F.col("round") == n), "range").select("range", "place", "control")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else light.select("range", "place", "control").limit(0)


def nearest_by_score(df: DataFrame, treat: str, score: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Nearest 1:1 matching on ``score`` without replacement: ``df`` with pair, for the rows that have a partner.

    Ties in score go by ``order``; of two controls that are equally near the one with the lower score is taken, of controls with one
    score the one next to the treated in the order. Rows without score or treatment are left out. ``pair`` grows in the order of the sweep.
    """
    rows, light = ordered(df, treat, score, order, range_rows)
    pairs = pairs_of(light)
    name = (F.shiftleft(F.col("range").cast("long"), 33) + F.col("place")).alias("pair")
    pairs = kept(pairs.select("range", "place", "control", name), "match-pairs")
    controls = light.filter("not treated").select("range", "place", "control").join(pairs.select("control", "pair"), "control")
    both = pairs.select("range", "place", "pair").unionByName(controls.select("range", "place", "pair"))
    return rows.join(both, ["range", "place"]).select("row.*", "pair")


def nearest_match(df: DataFrame, treat: str, covariates: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``nearest_by_score`` on the propensity score, fitted to all rows, of covariates of any kind: ``df`` with score and pair."""
    return nearest_by_score(propensity(df, treat, covariates), treat, "score", order, range_rows)
