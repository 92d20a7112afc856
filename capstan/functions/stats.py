"""Aggregates and scalar mathematics as column builders.

The aggregates are strict: a null or NaN among the inputs makes the result NaN, as does an empty input, unlike
SQL's own aggregates, which skip nulls.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit(float("nan"))


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def strict(value: Column, *inputs: Column | str) -> Column:
    """``value`` where no input of the group is null, else NaN."""
    whole = F.lit(True)
    for x in inputs:
        whole = whole & (F.count(_d(x)) == F.count(F.lit(1)))
    return F.when(whole, value).otherwise(_nan())


def core_mean(x: Column | str) -> Column:
    return strict(F.coalesce(F.avg(_d(x)), _nan()), x)


def core_var(x: Column | str) -> Column:
    """Sample variance; NaN for fewer than two values."""
    return strict(F.coalesce(F.var_samp(_d(x)), _nan()), x)


def core_std(x: Column | str, ddof: int = 1) -> Column:
    """Standard deviation for any ``ddof``; NaN where n <= ddof."""
    n = F.count(_d(x))
    spread = F.sqrt(F.var_pop(_d(x)) * n / F.nullif(n - ddof, F.lit(0)))
    return strict(F.when(n > ddof, spread).otherwise(_nan()), x)


def core_cor(x: Column | str, y: Column | str) -> Column:
    """Correlation from sums in one pass; NaN for fewer than two pairs or without spread on either side."""
    x, y = _d(x), _d(y)
    n, sx, sy = F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y)
    cross, xx, yy = n * F.sum(x * y) - sx * sy, n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    under = xx * yy
    return strict(F.when((n >= 2) & (xx > 0) & (yy > 0) & (under > 0), cross / F.sqrt(F.when(under > 0, under))).otherwise(_nan()), x, y)


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    total = F.sum(_d(w))
    return F.sum(_d(x) * _d(w)) / F.nullif(total, F.lit(0.0))


def weighted_var(x: Column | str, w: Column | str) -> Column:
    """Frequency-weighted variance with the unbiased denominator, sum of weights less one."""
    x, w = _d(x), _d(w)
    total = F.sum(w)
    return (F.sum(w * x * x) - F.pow(F.sum(w * x), 2) / F.nullif(total, F.lit(0.0))) / F.nullif(F.when(total > 1, total - 1), F.lit(0.0))


def normal_pdf(x: Column | str, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    x, mean, sd = _d(x), F.lit(mean) if isinstance(mean, (int, float)) else mean, F.lit(float(sd)) if isinstance(sd, (int, float)) else sd
    z = (x - mean) / F.nullif(sd, F.lit(0.0))
    return F.when(sd > 0, F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))).otherwise(_nan())


def normal_logpdf(x: Column | str, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    x, mean, sd = _d(x), F.lit(mean) if isinstance(mean, (int, float)) else mean, F.lit(float(sd)) if isinstance(sd, (int, float)) else sd
    z = (x - mean) / F.nullif(sd, F.lit(0.0))
    return F.when(sd > 0, -0.5 * z * z - F.log(F.when(sd > 0, sd)) - 0.5 * math.log(2 * math.pi)).otherwise(_nan())


def euclid_dist(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def trimmed_ipw_weights(treated: Column, score: Column, low: float, high: float) -> Column:
    """Inverse probability weights of scores clamped to [low, high]."""
    e = F.greatest(F.lit(low), F.least(F.lit(high), score))
    return F.when(treated == 1, 1 / e).otherwise(1 / (1 - e))


#: Lanczos' approximation of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
LANCZOS_SHIFT = 7.5


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Lanczos' sum at x + 1, which suits all of them."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + k)
    at = x + LANCZOS_SHIFT
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(at) - at + F.log(total) - F.log(x)


# The lower part is a series for x below shape + 1 and one minus a continued fraction from there on. Either needs a few dozen terms and some
# more with the root of the shape; that many are always taken, so both are plain sums over a known number of steps. The fraction is worked
# out from its far end.
_TERMS, _TERMS_BY_ROOT = 60, 10


def gamma_cdf_array(shape: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma of one shape, for all x at once; 0 up to x = 0, NaN for NaN."""
    x = np.asarray(x, float)
    steps = int(_TERMS + _TERMS_BY_ROOT * math.sqrt(shape))
    safe = np.where((x > 0) & np.isfinite(x), x, 1.0)
    front = np.exp(shape * np.log(safe) - safe - math.lgamma(shape))
    low, term = np.zeros(x.shape), np.full(x.shape, 1 / shape)
    near = np.minimum(safe, shape + 1)
    for k in range(1, steps + 1):
        low += term
        term *= near / (shape + k)
    far = np.maximum(safe, shape + 1)
    under = far + (2 * steps + 1 - shape)
    for k in range(steps, 0, -1):
        under = far + (2 * k - 1 - shape) - k * (k - shape) / under
    out = np.where(safe < shape + 1, front * low, 1 - front / under)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 0.0, np.where(np.isinf(x), 1.0, np.clip(out, 0, 1))))


def gamma_cdf(shape: float, x: float) -> float:
    return float(gamma_cdf_array(shape, np.array([x]))[0])


def gamma_cdf_regularized(shape: Column, x: Column) -> Column:
    """As a column, by folds over the steps; NaN where either is null or NaN, or the shape is not above 0."""
    a, x = shape.cast("double"), x.cast("double")
    steps = F.floor(_TERMS + _TERMS_BY_ROOT * F.sqrt(a)).cast("int")
    start = F.struct((1 / a).alias("term"), F.lit(0.0).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), steps), start, lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"]).alias("total")), lambda s: s["total"])
    under = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), x + 2 * steps + 1 - a, lambda v, k: x + 2 * k - 1 - a - k * (k - a) / v)
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    value = F.when(x < a + 1, front * series).otherwise(1 - front / under)
    unfit = a.isNull() | x.isNull() | F.isnan(a) | F.isnan(x) | (a <= 0)
    return F.when(unfit, _nan()).when(x <= 0, F.lit(0.0)).when(x == float("inf"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def hash_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on partitions: the first 52 bits of the MD5 of their texts, joined by
    colons. Other engines have the same hash, so what is drawn here can be drawn again elsewhere."""
    first = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)).cast("binary")), 1, 13)
    return F.conv(first, 16, 10).cast("double") / float(1 << 52)


#: The first dozen values of the distribution function of a Poisson number of mean 1; the rest is less than one in 10^9.
POISSON_ONE = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def bootstrap_means(df: DataFrame, x: str, key: str, replicates: int, seed: int) -> DataFrame:
    """replicate, mean: the Poisson bootstrap. Each row weighs by a Poisson(1) draw hashed from its key, so a
    replicate needs no shuffle of rows but one combined sum."""
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(key).alias("_key")).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = hash_uniform(F.col("_key"), F.col("replicate"), F.lit(seed))
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in POISSON_ONE), F.lit(0))
    return rows.withColumn("_w", weight).groupBy("replicate").agg((F.sum(F.col("_x") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))
