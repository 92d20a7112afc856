"""Likelihoods that go over a sequence once, or in blocks, against sums over all pairs; the incomplete gamma against closed forms."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.functions import stats
from capstan.operators import events

WEIGHTS, RATES = [0.3 + 0.1j, 0.3 - 0.1j, 0.2], [0.8 + 0.5j, 0.8 - 0.5j, 1.3]


def drawn(seed, n, horizon=100.0):
    r = np.random.default_rng(seed)
    t = np.sort(r.uniform(0, horizon, n))
    t[5:8] = t[5] if n > 8 else t[5:8]  # events at one time excite each other in their order
    return t


def pairs(t, density):
    return np.array([density(t[i] - t[:i]).sum() if i else 0.0 for i in range(len(t))])


def column(spark, t, f):
    return spark.createDataFrame([(t.tolist(),)], "times array<double>").select(f(F.col("times"))).first()[0]


@pytest.mark.parametrize("n", [0, 1, 2, 200])
def test_poles_equal_all_pairs(spark, n):
    t = drawn(1, n)
    got = column(spark, t, lambda x: events.poles_nll(x, 100.0, 0.7, 0.4, WEIGHTS, RATES))
    want = events.sequence_nll(t, 100.0, events.constant(math.log(0.7)), 0.4, events.poles(WEIGHTS, RATES))
    assert got == pytest.approx(want, rel=1e-9)


def test_poles_with_a_rate_below_zero_or_that_grow_are_infeasible(spark):
    assert column(spark, drawn(2, 40), lambda x: events.poles_nll(x, 100.0, 0.01, 0.9, [-1.0], [0.5])) == events.INFEASIBLE
    assert column(spark, drawn(2, 40), lambda x: events.poles_nll(x, 100.0, 0.7, 0.4, [1.0], [-0.5])) == events.INFEASIBLE


@pytest.mark.parametrize("n", [0, 1, 200])
def test_wave_equals_all_pairs(spark, n):
    t, a = drawn(3, n), (-0.5, 0.3, 0.2, -0.4)
    got = column(spark, t, lambda x: events.exponential_wave_nll(x, 100.0, *a, 0.4, 0.9))
    assert got == pytest.approx(events.sequence_nll(t, 100.0, events.sinusoidal(*a), 0.4, events.exponential(0.9)), rel=1e-9)
    assert column(spark, t, lambda x: events.exponential_wave_nll(x, 100.0, *a, 1.4, 0.9)) == events.INFEASIBLE


@pytest.mark.parametrize("split", [0.5, 3.0, 500.0])
def test_window_and_tail_equal_all_pairs(spark, split):
    t = drawn(4, 300)
    args = (2.5, 1.1, split, [0.2 + 0.1j, 0.2 - 0.1j], [0.9 + 0.2j, 0.9 - 0.2j])
    want = events.sequence_nll(t, 100.0, events.constant(-0.5), 0.4, events.split_gamma(*args))
    assert events.split_gamma_nll_of(t, 100.0, -0.5, 0.4, *args) == pytest.approx(want, rel=1e-9)
    assert column(spark, t[::-1], lambda x: events.split_gamma_nll(x, 100.0, -0.5, 0.4, *args)) == pytest.approx(want, rel=1e-9)
    assert events.split_gamma_nll_of(t, 100.0, -0.5, 0.4, 2.5, 1.1, 0.0, [1.0], [1.0]) == events.INFEASIBLE


def test_time_grows_with_the_events(spark):
    def seconds(n):
        t, args = np.linspace(0, n / 2, n), (2.0, 1.0, 3.0, [0.1], [0.9])
        began = time.perf_counter()
        events.split_gamma_nll_of(t, n / 2 + 1, -0.5, 0.4, *args)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 12 * seconds(4_000)


@pytest.mark.parametrize("block", [3, 40, 100_000])
def test_blocks_equal_the_fold(spark, block):
    r = random.Random(5)
    rows = [(k, x) for k in (1, 2, None) for x in drawn(k or 7, 150 if k else 1).tolist()]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, t double").repartition(3)
    got = {x["key"]: x["nll"] for x in events.exponentials_nll_by_blocks(df, "key", "t", 100.0, 0.7, 0.4, [0.5, 0.2], [0.9, 0.2], block).collect()}
    fold = events.sequences(df, "key", "t").select("key", events.exponentials_nll(F.col("times"), 100.0, 0.7, 0.4, [0.5, 0.2], [0.9, 0.2]).alias("nll"))
    want = {x["key"]: x["nll"] for x in fold.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    one = {x["key"]: x["nll"] for x in events.exponential_nll_by_blocks(df, "key", "t", 100.0, -0.5, 0.4, 0.9, block).collect()}
    same = {x["key"]: x["nll"] for x in events.sequences(df, "key", "t").select("key", events.exponential_nll(F.col("times"), 100.0, -0.5, 0.4, 0.9).alias("nll")).collect()}
    assert all(one[k] == pytest.approx(same[k], rel=1e-9) for k in same)


def test_one_key_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), (F.col("id") / 10).alias("t"))
    got = events.exponentials_nll_by_blocks(df, "key", "t", 2001.0, 0.7, 0.4, [0.9], [0.9], 1000).first()["nll"]
    t = np.arange(20_000) / 10
    a, total = 0.0, 0.0
    for i in range(len(t)):
        a = math.exp(-0.9 * 0.1) * (1 + a) if i else 0.0
        total += math.log(0.7 + 0.4 * 0.9 * a) - 0.4 * (1 - math.exp(-0.9 * (2001 - t[i])))
    assert got == pytest.approx(0.7 * 2001 - total, rel=1e-9)
    assert events.exponentials_nll_by_blocks(df.limit(0), "key", "t", 10.0, 0.7, 0.4, [0.9], [0.9]).count() == 0


def test_gamma_cdf_equals_closed_forms(spark):
    x = np.concatenate([[0, -1, 1e-12, 1e-3, 700, 1e5, math.inf], np.random.default_rng(6).gamma(2, 8, 200)])
    exact = {
        1.0: lambda v: -math.expm1(-v), 0.5: lambda v: math.erf(math.sqrt(v)), 3.0: lambda v: 1 - math.exp(-v) * (1 + v + v * v / 2) if v > 1e-2 else v**3 / 6,
        20.0: lambda v: 1 - sum(math.exp(k * math.log(v) - v - math.lgamma(k + 1)) for k in range(20)) if v > 6 else None, 150.0: lambda v: None, 1000.0: lambda v: None, 0.05: lambda v: None,
    }
    rows = [(a, float(v)) for a in exact for v in [*x, a * 0.9, a, a + 0.999, a + 1, a * 1.1, a * 2]]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, x double").coalesce(1).select(stats.gamma_cdf_regularized(F.col("a"), F.col("x"))).collect()]
    for (a, v), p in zip(rows, got):
        want = 0.0 if v <= 0 else 1.0 if math.isinf(v) else exact[a](v)
        assert p == pytest.approx(stats.gamma_cdf(a, v), abs=1e-10)
        assert want is None or p == pytest.approx(want, abs=1e-10), (a, v)
    for a in (150.0, 1000.0, 20.0, 0.05):  # both sides of the place where the forms meet
        assert stats.gamma_cdf(a, a + 1 - 1e-9) == pytest.approx(stats.gamma_cdf(a, a + 1 + 1e-9), abs=1e-9)


def test_gamma_cdf_of_nothing(spark):
    got = spark.createDataFrame([(None, 1.0), (1.0, None), (math.nan, 1.0), (1.0, math.nan), (0.0, 1.0), (-2.0, 1.0)], "a double, x double").select(stats.gamma_cdf_regularized(F.col("a"), F.col("x"))).collect()
    assert all(math.isnan(r[0]) for r in got)
