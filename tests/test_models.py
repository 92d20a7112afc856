"""Fits from summed matrices against fits to the rows in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.operators import models

FOLDS = 3


def made(n=3000):
    r = np.random.default_rng(11)
    x, z = r.normal(3, 2, n), r.integers(0, 4, n)
    d = (r.random(n) < 1 / (1 + np.exp(-(0.4 * (x - 3) + 0.3 * z - 0.5)))).astype(int)
    y = 0.7 * d + 0.5 * x - 0.2 * z + r.normal(0, 0.3, n)
    return [(int(i), float(a), f"z{b}", int(c), float(e), float(w)) for i, a, b, c, e, w in zip(range(n), x, z, d, y, r.integers(1, 4, n))]


SCHEMA = "id long, x double, z string, d int, y double, w double"


def plain(rows, fold):
    """ATE, ATTE and propensities by numpy over rows."""
    ids, x, z, d, y, w = (np.array(c) for c in zip(*rows))
    m = np.column_stack([np.ones(len(x)), x, *(z == k for k in sorted(set(z))[1:])]).astype(float)

    def logit(s):
        b = np.zeros(m.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-(m[s] @ b)))
            b = b + np.linalg.solve((m[s] * (w[s] * p * (1 - p))[:, None]).T @ m[s], m[s].T @ (w[s] * (d[s] - p)))
        return b

    def ols(s):
        return np.linalg.lstsq(m[s] * np.sqrt(w[s])[:, None], y[s] * np.sqrt(w[s]), rcond=None)[0]

    g0, g1, e = (np.zeros(len(x)) for _ in range(3))
    for k in range(FOLDS):
        out = fold == k
        g0[out], g1[out] = (m[out] @ ols(~out & (d == a)) for a in (0, 1))
        e[out] = 1 / (1 + np.exp(-(m[out] @ logit(~out))))
    ate = (w * (g1 - g0 + d * (y - g1) / e - (1 - d) * (y - g0) / (1 - e))).sum() / w.sum()
    atte = (w * (d * (y - g0) - e * (1 - d) * (y - g0) / (1 - e))).sum() / (w * d).sum()
    return ate, atte, 1 / (1 + np.exp(-(m @ logit(np.ones(len(x), bool)))))


@pytest.mark.parametrize("parts", [1, 7])
def test_effects_and_scores_equal_numpy_on_rows(spark, parts):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    ate, atte, score = plain(rows, np.arange(len(rows)) % FOLDS)
    e = models.double_ml(df, "d", "y", ["x", "z"], "id", F.col("w"), fold=F.col("id") % FOLDS)
    assert e.ate == pytest.approx(ate, abs=1e-8) and e.atte == pytest.approx(atte, abs=1e-8) and e.n == sum(r[5] for r in rows)
    got = [r["score"] for r in models.propensity(df, "d", ["x", "z"], F.col("w")).orderBy("id").collect()]
    assert np.abs(np.array(got) - score).max() < 1e-8
    assert abs(e.ate - 0.7) < 0.05


def test_clusters_stay_in_one_fold_and_nulls_go(spark):
    rows = made(400) + [(1000, None, "z1", 1, 0.0, 1.0), (1001, 1.0, None, 1, 0.0, 1.0), (1002, 1.0, "z1", None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("fold", "g", "what")})
    e = models.double_ml(df, "d", "y", ["x", "z"], "id")
    assert e.n == 400 and abs(e.ate - 0.7) < 0.2
    scored = models.propensity(df, "d", ["x", "z"]).filter("id >= 1000").orderBy("id").collect()
    assert scored[0]["score"] is None and scored[1]["score"] is None and 0 < scored[2]["score"] < 1
    none = models.double_ml(df.limit(0), "d", "y", ["x", "z"], "id")
    assert none.n == 0 and np.isnan(none.ate)


def test_too_many_levels_are_refused(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("z"))
    with pytest.raises(ValueError, match="levels"):
        models.design(df, ["z"])
