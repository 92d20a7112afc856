"""Pairs of events in time, and likelihoods of self-exciting event sequences."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import gamma_cdf_array
from .shared import kept

#: What an infeasible parameter set costs.
INFEASIBLE = 1e12
YEAR_DAYS = 365.25


def prior_pairs(events: DataFrame, key: str, time: str, event: str) -> DataFrame:
    """All pairs of a key's events in time order: key, event, earlier, lag."""
    a = events.select(key, F.col(event).alias("event"), F.col(time).alias("t"))
    b = events.select(key, F.col(event).alias("earlier"), F.col(time).alias("s"))
    return a.join(b, key).filter("s < t").select(key, "event", "earlier", (F.col("t") - F.col("s")).alias("lag"))


def banded_pairs(events: DataFrame, key: str, time: str, event: str, cutoff: float) -> DataFrame:
    """Pairs no further apart than ``cutoff``. Time is cut into bins of that width, so a row meets only its own and the
    preceding bin: the join is on equal keys and grows with the pairs, not with the square of a key's events."""
    bin_of = F.floor(F.col(time) / cutoff).cast("long")
    a = events.select(key, F.col(event).alias("event"), F.col(time).alias("t"), F.explode(F.array(bin_of, bin_of - 1)).alias("bin"))
    b = events.select(key, F.col(event).alias("earlier"), F.col(time).alias("s"), bin_of.alias("bin"))
    lag = F.col("t") - F.col("s")
    return a.join(b, [key, "bin"]).filter((lag > 0) & (lag <= cutoff)).select(key, "event", "earlier", lag.alias("lag"))


def trailing_sum(events: DataFrame, key: str, time: str, value: str, width: float, name: str = "trailing") -> DataFrame:
    """Sum of the values in the ``width`` up to each event."""
    over = f"(PARTITION BY `{key}` ORDER BY `{time}` RANGE BETWEEN {float(width)!r}D PRECEDING AND CURRENT ROW)"
    return events.withColumn(name, F.expr(f"sum(`{value}`) OVER {over}"))


def sequences(events: DataFrame, key: str, time: str) -> DataFrame:
    """key, times: each key's event times in order."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("times"))


def exponential_nll(times: Column, horizon: float, a0: float, eta: float, beta: float) -> Column:
    """Negative log-likelihood with an exponential kernel and a constant rate, by one pass over a sorted array."""
    if not (1e-6 < eta < 0.999 and 0.05 < beta < 30 and -20 < a0 < 20):
        return F.lit(INFEASIBLE)
    nu = math.exp(a0)
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("a"), F.lit(0.0).alias("total"))

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["before"].isNull(), F.lit(0.0)).otherwise(F.exp((s["before"] - t) * beta) * (s["a"] + beta))
        return F.struct(t.alias("before"), a.alias("a"), (s["total"] + F.log(F.lit(nu) + eta * a) - eta * (1 - F.exp((t - horizon) * beta))).alias("total"))

    return F.lit(nu * horizon) - F.aggregate(times, start, step, lambda s: s["total"])


def exponentials_nll(times: Column, horizon: float, nu: float, eta: float, weights: list[float], rates: list[float]) -> Column:
    """As above for a sum of exponentials; the state is an array with one entry for each."""
    if not (nu > 0 and math.isfinite(nu)):
        return F.lit(INFEASIBLE)
    pairs = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, rates)))
    start = F.struct(F.lit(None).cast("double").alias("before"), F.array(*(F.lit(0.0) for _ in weights)).alias("a"), F.lit(0.0).alias("total"))

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["before"].isNull(), s["a"]).otherwise(F.zip_with(s["a"], pairs, lambda x, p: F.exp((s["before"] - t) * p["b"]) * (1 + x)))
        excited = F.aggregate(F.zip_with(a, pairs, lambda x, p: x * p["w"]), F.lit(0.0), lambda u, v: u + v)
        spent = F.aggregate(F.transform(pairs, lambda p: p["w"] / p["b"] * (1 - F.exp((t - horizon) * p["b"]))), F.lit(0.0), lambda u, v: u + v)
        return F.struct(t.alias("before"), a.alias("a"), (s["total"] + F.log(F.lit(nu) + eta * excited) - eta * spent).alias("total"))

    return F.lit(nu * horizon) - F.aggregate(times, start, step, lambda s: s["total"])


def _wave(t: Column, horizon: float, a0: float, a1: float, a2: float, a3: float) -> Column:
    turn = 2 * math.pi / YEAR_DAYS * t
    return F.exp(a0 + a1 / max(horizon, 1.0) * t + a2 * F.sin(turn) + a3 * F.cos(turn))


def wave_integral(horizon: float, a0: float, a1: float, a2: float, a3: float, points: int = 2001) -> Column:
    """The integral of the wave over a grid of ``points``, by trapezoids."""
    step = horizon / (points - 1)
    values = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: _wave(k * F.lit(step), horizon, a0, a1, a2, a3))
    ends = (_wave(F.lit(0.0), horizon, a0, a1, a2, a3) + _wave(F.lit(float(horizon)), horizon, a0, a1, a2, a3)) / 2
    return (F.aggregate(values, F.lit(0.0), lambda s, v: s + v) - ends) * step


def exponential_wave_nll(times: Column, horizon: float, a0: float, a1: float, a2: float, a3: float, eta: float, beta: float, points: int = 2001) -> Column:
    """As ``exponential_nll`` with a rate that has a trend and a yearly wave (see ``sinusoidal``): still one pass."""
    if not (1e-6 < eta < 0.999 and 0.05 < beta < 30 and -20 < a0 < 20):
        return F.lit(INFEASIBLE)
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("a"), F.lit(0.0).alias("total"))

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["before"].isNull(), F.lit(0.0)).otherwise(F.exp((s["before"] - t) * beta) * (s["a"] + beta))
        gained = F.log(_wave(t, horizon, a0, a1, a2, a3) + eta * a) - eta * (1 - F.exp((t - horizon) * beta))
        return F.struct(t.alias("before"), a.alias("a"), (s["total"] + gained).alias("total"))

    return wave_integral(horizon, a0, a1, a2, a3, points) - F.aggregate(times, start, step, lambda s: s["total"])


def poles_nll(times: Column, horizon: float, nu: float, eta: float, weights: list[complex], rates: list[complex]) -> Column:
    """As ``exponentials_nll`` with complex weights and rates, whose conjugates come in pairs: an array of (re, im) is the state, so time
    grows with the events times the poles."""
    if not (nu > 0 and math.isfinite(nu) and all(complex(b).real > 0 for b in rates)):
        return F.lit(INFEASIBLE)
    fields = [(complex(w), complex(b), complex(w) / complex(b)) for w, b in zip(weights, rates)]
    names = ("wr", "wi", "br", "bi", "qr", "qi")
    pairs = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (w.real, w.imag, b.real, b.imag, q.real, q.imag)))) for w, b, q in fields))
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    start = F.struct(F.lit(None).cast("double").alias("before"), F.array(*(zero for _ in fields)).alias("a"), F.lit(0.0).alias("total"))
    whole = sum(q.real for _, _, q in fields)
    add = lambda u, v: u + v

    def turned(x: Column, p: Column, lag: Column) -> Column:
        """(1 + x) exp(-b lag)."""
        size, angle = F.exp(-p["br"] * lag), p["bi"] * lag
        return F.struct(
            (size * ((1 + x["re"]) * F.cos(angle) + x["im"] * F.sin(angle))).alias("re"), (size * (x["im"] * F.cos(angle) - (1 + x["re"]) * F.sin(angle))).alias("im")
        )

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["before"].isNull(), s["a"]).otherwise(F.zip_with(s["a"], pairs, lambda x, p: turned(x, p, t - s["before"])))
        excited = F.aggregate(F.zip_with(a, pairs, lambda x, p: p["wr"] * x["re"] - p["wi"] * x["im"]), F.lit(0.0), add)
        left = horizon - t
        ahead = F.aggregate(F.transform(pairs, lambda p: F.exp(-p["br"] * left) * (p["qr"] * F.cos(p["bi"] * left) + p["qi"] * F.sin(p["bi"] * left))), F.lit(0.0), add)
        return F.struct(t.alias("before"), a.alias("a"), (s["total"] + F.log(F.lit(nu) + eta * excited) - eta * (whole - ahead)).alias("total"))

    total = F.aggregate(times, start, step, lambda s: s["total"])
    return F.when(total.isNull() | F.isnan(total), F.lit(INFEASIBLE)).otherwise(nu * horizon - total)


#: Events of a block of a sequence.
BLOCK_EVENTS = 1 << 16


def exponentials_nll_by_blocks(events: DataFrame, key: str, time: str, horizon: float, nu: float, eta: float, weights: list[float], rates: list[float], block_events: int = BLOCK_EVENTS) -> DataFrame:
    """key, nll as of ``exponentials_nll``, for sequences that need not fit one row or task.

    Events are cut into blocks by ranges of key and time. Over a block the state of each exponential goes from s to
    decay * s + addend; the pairs (decay, addend) of a key's blocks are chained in their order, which gives the state each block is
    entered with, and then the blocks are folded on their own.
    """
    if not (nu > 0 and math.isfinite(nu)):
        return events.select(key).distinct().withColumn("nll", F.lit(INFEASIBLE))
    timed = events.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t")).filter("t is not null")
    parts = max(1, -(-timed.count() // block_events))
    pairs = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, rates)))
    dealt = timed.repartitionByRange(parts, "key", "t").withColumn("block", F.spark_partition_id())
    blocks = kept(dealt.groupBy("key", "block").agg(F.array_sort(F.collect_list("t")).alias("times")), "event-blocks")
    first, last = F.get("times", F.lit(0)), F.element_at("times", -1)
    addend = F.transform(pairs, lambda p: F.aggregate("times", F.lit(0.0), lambda s, t: s + F.exp((t - last) * p["b"])))
    chain = blocks.select("key", "block", first.alias("first"), last.alias("last"), addend.alias("addend")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "first", "last", "addend"))).alias("blocks"))
    none = F.array(*(F.lit(0.0) for _ in weights))
    start = F.struct(F.lit(None).cast("double").alias("last"), none.alias("state"), F.array().cast("array<struct<block:int,state:array<double>>>").alias("out"))

    def link(s: Column, b: Column) -> Column:
        decayed = lambda to: F.when(s["last"].isNull(), none).otherwise(F.zip_with(s["state"], pairs, lambda x, p: x * F.exp((s["last"] - to) * p["b"])))
        state = F.zip_with(decayed(b["last"]), b["addend"], lambda x, y: x + y)
        return F.struct(b["last"].alias("last"), state.alias("state"), F.concat(s["out"], F.array(F.struct(b["block"].alias("block"), decayed(b["first"]).alias("state")))).alias("out"))

    entered = chain.select(F.col("key").alias("of"), F.explode(F.aggregate("blocks", start, link, lambda s: s["out"])).alias("e")).select("of", F.col("e.block").alias("at"), F.col("e.state").alias("state"))
    joined = blocks.join(entered, F.col("key").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    begin = F.struct(F.lit(None).cast("double").alias("before"), F.col("state").alias("a"), F.lit(0.0).alias("total"))
    add = lambda u, v: u + v

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["before"].isNull(), s["a"]).otherwise(F.zip_with(s["a"], pairs, lambda x, p: F.exp((s["before"] - t) * p["b"]) * (1 + x)))
        excited = F.aggregate(F.zip_with(a, pairs, lambda x, p: x * p["w"]), F.lit(0.0), add)
        spent = F.aggregate(F.transform(pairs, lambda p: p["w"] / p["b"] * (1 - F.exp((t - horizon) * p["b"]))), F.lit(0.0), add)
        return F.struct(t.alias("before"), a.alias("a"), (s["total"] + F.log(F.lit(nu) + eta * excited) - eta * spent).alias("total"))

    parts_of = joined.select("key", F.aggregate("times", begin, step, lambda s: s["total"]).alias("part"))
    return parts_of.groupBy("key").agg((F.lit(nu * horizon) - F.sum("part")).alias("nll")).withColumnRenamed("key", key)


def exponential_nll_by_blocks(events: DataFrame, key: str, time: str, horizon: float, a0: float, eta: float, beta: float, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """key, nll as of ``exponential_nll``, in blocks."""
    if not (1e-6 < eta < 0.999 and 0.05 < beta < 30 and -20 < a0 < 20):
        return events.select(key).distinct().withColumn("nll", F.lit(INFEASIBLE))
    return exponentials_nll_by_blocks(events, key, time, horizon, math.exp(a0), eta, [beta], [beta], block_events)


# Kernels: a density of the lag, its integral from 0, and the lag beyond which the density is 0 in doubles.


def weibull(alpha: float, scale: float) -> tuple[Callable, Callable, float, bool]:
    def density(u):
        x = u / scale
        z = np.power(np.maximum(x, 1e-12), alpha)
        return np.where((x > 1e-12) & (z < 700), alpha / scale * np.power(np.maximum(x, 1e-12), alpha - 1) * np.exp(-np.minimum(z, 700)), 0.0)

    return density, lambda u: 1 - np.exp(-np.power(np.maximum(u, 0) / scale, alpha)), scale * 700 ** (1 / alpha), 0.05 < alpha < 20 and 1e-3 < scale < 1e3


def lomax(alpha: float, c: float) -> tuple[Callable, Callable, float, bool]:
    def density(u):
        return np.exp(math.log(alpha - 1) + (alpha - 1) * math.log(c) - alpha * np.log(u + c))

    return density, lambda u: 1 - np.power(c / (np.maximum(u, 0) + c), alpha - 1), math.inf, alpha > 1 and c > 0


def gamma(alpha: float, beta: float) -> tuple[Callable, Callable, float, bool]:
    front = alpha * math.log(beta) - math.lgamma(alpha) if alpha > 0 and beta > 0 else 0.0

    def density(u):
        return np.where(u > 1e-300, np.exp(front + (alpha - 1) * np.log(np.maximum(u, 1e-300)) - beta * u), 0.0)

    # exp(x) is 0 below x = -745.14. For any peak p the logarithm lies under its tangent, log u <= log p + u / p - 1, so with the slope
    # of half of beta, p = 2 (alpha - 1) / beta, the exponent is at most level - beta u / 2. A shape up to 1 has no peak: log u >= 0
    # from u = 1 on, where the power only lowers the exponent.
    if alpha > 1:
        level = front + (alpha - 1) * (math.log(2 * (alpha - 1) / beta) - 1)
        cutoff = (level + 745.2) / (beta / 2)
    else:
        cutoff = max(1.0, (front + 745.2) / beta)
    return density, lambda u: gamma_cdf_array(alpha, beta * np.asarray(u, float)), cutoff, 0.05 < alpha < 20 and 0.05 < beta < 30


def exponential(beta: float) -> tuple[Callable, Callable, float, bool]:
    return lambda u: beta * np.exp(-beta * u), lambda u: 1 - np.exp(-beta * np.maximum(u, 0)), math.inf, 0.05 < beta < 30


def custom(density: Callable, integral: Callable, cutoff: float = math.inf) -> tuple[Callable, Callable, float, bool]:
    return density, integral, cutoff, True


def poles(weights: list[complex], rates: list[complex]) -> tuple[Callable, Callable, float, bool]:
    """Sum of exponentials with complex rates, whose conjugates come in pairs; real parts count."""
    w, b = np.array(weights, complex), np.array(rates, complex)
    return (
        lambda u: (w * np.exp(-np.multiply.outer(u, b))).sum(-1).real,
        lambda u: (w / b * (1 - np.exp(-np.multiply.outer(np.maximum(u, 0), b)))).sum(-1).real,
        math.inf,
        bool((b.real > 0).all()),
    )


def split_gamma(alpha: float, beta: float, split: float, weights: list[complex], rates: list[complex]) -> tuple[Callable, Callable, float, bool]:
    """The gamma kernel up to ``split``, and a sum of exponentials in the lag beyond it."""
    near, near_integral, _, ok = gamma(alpha, beta)
    far, far_integral, _, stable = poles(weights, rates)
    return (
        lambda u: np.where(u <= split, near(np.minimum(u, split)), far(np.maximum(u - split, 0))),
        lambda u: np.where(u <= 0, 0.0, near_integral(np.clip(u, 0, split)) + np.where(u > split, far_integral(u - split), 0.0)),
        math.inf,
        ok and stable and split > 0,
    )


def constant(a0: float) -> tuple[Callable, Callable, bool]:
    nu = math.exp(a0) if abs(a0) < 700 else math.inf
    return lambda t, horizon: np.full(len(t), nu), lambda horizon: nu * horizon, -20 < a0 < 20


def sinusoidal(a0: float, a1: float, a2: float, a3: float, points: int = 2001) -> tuple[Callable, Callable, bool]:
    """A log-linear trend and a yearly wave; integrated over a grid by trapezoids."""

    def rate(t, horizon):
        wave = 2 * np.pi / YEAR_DAYS * t
        return np.exp(a0 + a1 * t / max(horizon, 1.0) + a2 * np.sin(wave) + a3 * np.cos(wave))

    def integral(horizon):
        grid = np.linspace(0, horizon, points)
        return float(np.trapezoid(rate(grid, horizon), grid))

    return rate, integral, -20 < a0 < 20


#: Lags whose densities are worked out at once.
LAGS_AT_ONCE = 1 << 16


def _excited(t: np.ndarray, first: np.ndarray, density: Callable) -> np.ndarray:
    """For each event the sum of the densities of its lags to the events from ``first`` on before it, many events at a time."""
    counts = np.arange(len(t)) - first
    ends, out, i = np.cumsum(counts), np.zeros(len(t)), 0
    while i < len(t):
        k = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + LAGS_AT_ONCE, "right")))
        own = counts[i:k]
        row = np.repeat(np.arange(k - i), own)
        at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[i:k], own)
        if len(row):
            out[i:k] = np.bincount(row, density(t[i:k][row] - t[at]), k - i)
        i = k
    return out


def sequence_nll(t: np.ndarray, horizon: float, baseline, eta: float, kernel, bounded: bool = True) -> float:
    """Negative log-likelihood of one sorted sequence. Events beyond the kernel's cutoff are left out, which is exact."""
    rate, rate_integral, fine = baseline
    density, integral, cutoff, feasible = kernel
    if not (fine and feasible) or bounded and not 1e-6 < eta < 0.999:
        return INFEASIBLE
    t = np.asarray(t, float)
    first = np.searchsorted(t, t - cutoff) if math.isfinite(cutoff) else np.zeros(len(t), np.int64)
    excited = _excited(t, first, density)
    lam = rate(t, horizon) + eta * excited
    if not np.isfinite(lam).all() or (lam <= 0).any():
        return INFEASIBLE
    spent = rate_integral(horizon) + eta * float(np.sum(integral(horizon - t))) if len(t) else rate_integral(horizon)
    return float(spent - np.log(lam).sum())


def split_gamma_nll_of(t: np.ndarray, horizon: float, a0: float, eta: float, alpha: float, beta: float, split: float, weights: list[complex], rates: list[complex]) -> float:
    """``sequence_nll`` with the ``split_gamma`` kernel: lags up to ``split`` are summed over a window whose two ends only move on; an event
    that leaves it enters the tail's sums, one complex number a pole. Time grows with the events times (the window plus the poles)."""
    _, _, feasible_rate = constant(a0)
    _, integral, _, feasible = split_gamma(alpha, beta, split, weights, rates)
    if not (feasible and feasible_rate and 1e-6 < eta < 0.999):
        return INFEASIBLE
    density = gamma(alpha, beta)[0]
    t, nu = np.asarray(t, float), math.exp(a0)
    w, b = np.array(weights, complex), np.array(rates, complex)
    first = np.searchsorted(t, t - split)  # lags beyond it are in the tail
    tail, gone, total = np.zeros(len(b), complex), 0, 0.0
    for i in range(len(t)):
        if i:
            tail *= np.exp(-b * (t[i] - t[i - 1]))
        if first[i] > gone:
            tail += np.exp(-np.multiply.outer(t[i] - split - t[gone : first[i]], b)).sum(0)
            gone = first[i]
        rate = nu + eta * (float((w * tail).sum().real) + float(density(t[i] - t[gone:i]).sum()))
        if not (rate > 0 and math.isfinite(rate)):
            return INFEASIBLE
        total += math.log(rate)
    return nu * horizon + eta * float(np.sum(integral(horizon - t))) - total


def split_gamma_nll(times: Column, horizon: float, a0: float, eta: float, alpha: float, beta: float, split: float, weights: list[complex], rates: list[complex]) -> Column:
    """As a column over arrays of times, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([split_gamma_nll_of(np.sort(t), horizon, a0, eta, alpha, beta, split, weights, rates) for t in batch])

    return run(times)


def nll(times: Column, horizon: float, baseline, eta: float, kernel, bounded: bool = True) -> Column:
    """As a column over arrays of times, in Arrow batches: these kernels have no fold that Spark could express."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([sequence_nll(np.sort(t), horizon, baseline, eta, kernel, bounded) for t in batch])

    return run(times)


def weibull_nll_by_join(events: DataFrame, key: str, time: str, event: str, horizon: float, a0: float, eta: float, alpha: float, scale: float) -> DataFrame:
    """key, nll with a Weibull kernel by the banded join alone: a key's events need not fit one row."""
    nu, cutoff = math.exp(a0), scale * 700 ** (1 / alpha)
    x = F.col("lag") / scale
    near = banded_pairs(events, key, time, event, cutoff).filter(x > 1e-12)
    excited = near.groupBy(key, "event").agg(F.sum(alpha / scale * F.pow(x, alpha - 1) * F.exp(-F.pow(x, F.lit(alpha)))).alias("s"))
    all_events = events.select(key, F.col(event).alias("event"), F.col(time).alias("t")).join(excited, [key, "event"], "left")
    lam = F.lit(nu) + eta * F.coalesce("s", F.lit(0.0))
    spent = eta * (1 - F.exp(-F.pow(F.greatest(F.lit(horizon) - F.col("t"), F.lit(0.0)) / scale, F.lit(alpha))))
    return all_events.groupBy(key).agg((F.lit(nu * horizon) + F.sum(spent) - F.sum(F.log(lam))).alias("nll"))
