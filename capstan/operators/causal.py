"""Matching, double machine learning and count regression over tables with discrete covariates.

Rows are first counted by cell (covariates, treatment, outcome); the models are then fitted on the driver over
cells, whose number does not depend on the number of rows. The number is checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import Effects
from .shared import kept

#: Cells that may reach the driver.
MOST_CELLS = 500_000
#: Rows of one cell and arm that are numbered in one task.
BLOCK_ROWS = 1 << 17


def cells_of(df: DataFrame, columns: list[str], weight: Column | None = None) -> list:
    rows = df.groupBy(*columns).agg(F.sum(F.lit(1.0) if weight is None else weight.cast("double")).alias("_n")).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells; the covariates are not discrete: use matching.nearest_match and models.double_ml, which work on rows")
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in columns))


def design(rows: list, columns: list[str]) -> np.ndarray:
    """Intercept and indicators of all levels but the first of each column."""
    parts = [np.ones((len(rows), 1))]
    for c in columns:
        values = [str(r[c]) for r in rows]
        parts += [np.array([[v == level] for v in values], float) for level in sorted(set(values))[1:]]
    return np.hstack(parts) if rows else np.zeros((0, 1))


def logit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)))
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b


def _scores(rows: list, treat: str, covariates: list[str]) -> dict[tuple, float]:
    x = design(rows, covariates)
    b = logit(x, np.array([float(r[treat]) for r in rows]), np.array([r["_n"] for r in rows]))
    score = 1 / (1 + np.exp(-(x @ b)))
    return {tuple(r[c] for c in covariates): float(s) for r, s in zip(rows, score)}


def propensity_by_cell(df: DataFrame, treat: str, covariates: list[str], weight: Column | None = None) -> DataFrame:
    """Covariates with their propensity score; one row for each cell."""
    out = _scores(cells_of(df, [*covariates, treat], weight), treat, covariates)
    fields = [f for f in df.select(*covariates).schema.fields]
    return df.sparkSession.createDataFrame([(*k, v) for k, v in out.items()], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double")


def numbered_by(df: DataFrame, keys: list[str], order: list[str], out: str, blocks: int) -> DataFrame:
    """``df`` with ``out``, a number from 1 on for each row of equal ``keys``, by ``order``.

    With more than one of ``blocks`` the rows are dealt out by ranges of key and order, and numbered from the sums of the ranges
    before, so that no key is sorted in one task. The numbers are the same either way.
    """
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if blocks <= 1:
        return df.withColumn(out, inside)
    dealt = kept(df.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id()), "numbered")
    names = [f"_b_{i}" for i in range(len(keys))]
    counts = dealt.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("_block").alias("_at")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, "_at", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    met = F.col("_block") == F.col("_at")
    for k, n in zip(keys, names):
        met = met & F.col(k).eqNullSafe(F.col(n))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return dealt.withColumn(out, inside).join(offsets, met).withColumn(out, F.col(out) + F.col("_offset")).drop("_block", *names, "_at", "_offset")


def _blocks_for(most: float) -> int:
    return int(-(-most // BLOCK_ROWS))


def match_within_cells(df: DataFrame, treat: str, covariates: list[str], order: list[str]) -> DataFrame:
    """1:1 pairs inside equal cells, without replacement: ``df`` with pair, its number within cell and arm (see
    ``numbered_by``), for the rows that have a partner."""
    counts = df.groupBy(*covariates).agg(F.count_if(F.col(treat) == 1).alias("_t"), F.count_if(F.col(treat) == 0).alias("_c"))
    most = counts.agg(F.max(F.greatest("_t", "_c")).alias("n")).first()["n"] or 0
    numbered = numbered_by(df, [*covariates, treat], order, "pair", _blocks_for(most))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in covariates]
    keyed = counts.select(*(F.col(c).alias(f"_k_{c}") for c in covariates), F.least("_t", "_c").alias("_pairs"))
    met = same[0]
    for s in same[1:]:
        met = met & s
    return numbered.join(keyed, met).filter(F.col("pair") <= F.col("_pairs")).select(*df.columns, "pair")


def plan_matches(cells: list[tuple[float, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy nearest matching over cells of (score, treated, controls): (treated's cell, control's cell, pairs).

    Treated units are taken from the highest score down; each takes the nearest control that is left, which is one
    of its own cell while there is one.
    """
    left = [c for _, _, c in cells]
    out = []
    for i in sorted(range(len(cells)), key=lambda k: -cells[k][0]):
        need = cells[i][1]
        while need and any(left):
            j = min((k for k in range(len(cells)) if left[k]), key=lambda k: (abs(cells[k][0] - cells[i][0]), k))
            n = min(need, left[j])
            out.append((i, j, n))
            left[j] -= n
            need -= n
    return out


def nearest_match(df: DataFrame, treat: str, covariates: list[str], order: list[str]) -> DataFrame:
    """Nearest 1:1 matching on the propensity score without replacement: ``df`` with score and pair, for the matched
    rows. Scores are constant in a cell, so the greedy plan is made over cells and carried out by row numbers."""
    spark = df.sparkSession
    counts = cells_of(df, [*covariates, treat])
    score = _scores(counts, treat, covariates)
    keys = sorted(score, key=lambda k: tuple(map(str, k)))
    number = {(tuple(r[c] for c in covariates), int(r[treat])): int(r["_n"]) for r in counts}
    plan = plan_matches([(score[k], number.get((k, 1), 0), number.get((k, 0), 0)) for k in keys])
    taken, rows, pair = {}, [], 0
    for i, j, n in plan:  # a stretch of row numbers in either cell for each step
        for arm, cell in ((1, i), (0, j)):
            at = taken.get((arm, cell), 0)
            rows.append((*keys[cell], score[keys[cell]], arm, at, at + n, pair - at))
            taken[arm, cell] = at + n
        pair += n
    names = [f"_k_{c}" for c in covariates]
    kinds = [f.dataType.simpleString() for f in df.select(*covariates).schema.fields]
    stretches = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)) + ", score double, _arm int, _from bigint, _to bigint, _shift bigint")
    blocks = _blocks_for(max((r["_n"] for r in counts), default=0))
    numbered = numbered_by(df, [*covariates, treat], order, "_rn", blocks).withColumn("_rn", F.col("_rn") - 1)
    met = (F.col(treat) == F.col("_arm")) & (F.col("_rn") >= F.col("_from")) & (F.col("_rn") < F.col("_to"))
    for c, n in zip(covariates, names):
        met = met & F.col(c).eqNullSafe(F.col(n))
    return numbered.join(stretches, met).select(*df.columns, "score", (F.col("_rn") + F.col("_shift")).alias("pair"))


def double_ml(df: DataFrame, treat: str, outcome: str, covariates: list[str], cluster: str, weight: Column | None = None, folds: int = 3, trim: float = 1e-12) -> Effects:
    """Interactive regression: outcome by least squares in either arm, treatment by logistic regression, both cross
    fitted over folds of clusters; the effects are means of the orthogonal scores. ``weight`` stands for the
    number of equal rows, so rows need not be expanded."""
    return _double_ml(_folded(df, treat, outcome, covariates, cluster, weight, folds), treat, outcome, covariates, folds, trim)


def _folded(df: DataFrame, treat: str, outcome: str, covariates: list[str], cluster: str, weight: Column | None, folds: int) -> list:
    ready = df.dropna(subset=[treat, outcome, cluster, *covariates])
    keyed = ready.withColumn("_fold", F.pmod(F.xxhash64(F.col(cluster).cast("string")), F.lit(folds)).cast("int"))
    return cells_of(keyed, ["_fold", *covariates, treat, outcome], weight)


def _double_ml(rows: list, treat: str, outcome: str, covariates: list[str], folds: int = 3, trim: float = 1e-12) -> Effects:
    x, w = design(rows, covariates), np.array([r["_n"] for r in rows])
    d, y, fold = (np.array([float(r[c]) for r in rows]) for c in (treat, outcome, "_fold"))
    g0, g1, m = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for k in range(folds):
        out, fit = fold == k, fold != k
        for arm, g in ((0, g0), (1, g1)):
            s = fit & (d == arm)
            b = np.linalg.lstsq(x[s] * np.sqrt(w[s])[:, None], y[s] * np.sqrt(w[s]), rcond=None)[0]
            g[out] = x[out] @ b
        m[out] = 1 / (1 + np.exp(-np.clip(x[out] @ logit(x[fit], d[fit], w[fit]), -30, 30)))
    m = np.clip(m, trim, 1 - trim)
    total, share = w.sum(), (w * d).sum() / w.sum()
    ate = (w * (g1 - g0 + d * (y - g1) / m - (1 - d) * (y - g0) / (1 - m))).sum() / total
    atte = (w * (d * (y - g0) - m * (1 - d) * (y - g0) / (1 - m))).sum() / (total * share)
    return Effects(float(ate), float(atte), float(total))


def effects_table(df: DataFrame, treat: str, outcome: str, covariates: list[str], cluster: str, period: str, weight: Column | None = None) -> DataFrame:
    """scope, estimand, effect: pooled, and for each period without the period among the covariates. All fits are made
    from one count of the cells, in one pass over ``df``."""
    spark = df.sparkSession
    rows = _folded(df, treat, outcome, [*covariates, period], cluster, weight, 3)
    fits = [("pooled", _double_ml(rows, treat, outcome, [*covariates, period]))]
    for p in sorted({r[period] for r in rows}, key=str):
        fits.append((str(p), _double_ml([r for r in rows if r[period] == p], treat, outcome, covariates)))
    return spark.createDataFrame([(s, k, v) for s, e in fits for k, v in (("ATE", e.ate), ("ATTE", e.atte))], "scope string, estimand string, effect double")


@dataclass(frozen=True)
class CountModel:
    names: tuple[str, ...]
    estimate: np.ndarray
    std_error: np.ndarray
    dispersion: float
    group_sd: float
    log_likelihood: float
    converged: bool

    @property
    def aic(self) -> float:
        return 2 * (len(self.names) + 2) - 2 * self.log_likelihood

    def table(self) -> list[tuple[str, float, float, float, float, float]]:
        """term, estimate, std_error, z_value, p_value, irr (the rate ratio) of each coefficient."""
        out = []
        for name, b, se in zip(self.names, map(float, self.estimate), map(float, self.std_error)):
            z = b / se if se > 0 else float("nan")
            out.append((name, b, se, z, erfc(abs(z) / sqrt(2)), exp(b)))
        return out


def negative_binomial_mixed(df: DataFrame, outcome: str, treat: str, covariates: list[str], group: str, nodes: int = 15) -> CountModel:
    """Negative-binomial regression (variance mu + mu^2 / size) with a normal intercept for each group.

    The intercept is integrated out by Gauss-Hermite quadrature around each group's mode; the likelihood is maximised by
    BFGS over cell counts, standard errors come from its numerical Hessian. Without the original data no parity with
    other implementations is claimed.
    """
    from math import lgamma

    rows = cells_of(df, [group, *covariates, treat, outcome])
    x0 = design(rows, covariates)
    d = np.array([[float(r[treat])] for r in rows])
    x = np.hstack([x0[:, :1], d, x0[:, 1:]])
    y, w = np.array([float(r[outcome]) for r in rows]), np.array([r["_n"] for r in rows])
    labels = sorted({str(r[group]) for r in rows})
    g = np.array([labels.index(str(r[group])) for r in rows])
    z, q = np.polynomial.hermite_e.hermegauss(nodes)
    q = np.log(q / np.sqrt(2 * np.pi))
    lg = np.vectorize(lgamma, otypes=[float])
    log_y = lg(y + 1)

    def loss(p: np.ndarray) -> float:
        b, size, sd = p[:-2], np.exp(np.clip(p[-2], -15, 15)), np.exp(np.clip(p[-1], -15, 5))
        eta = (x @ b)[:, None] + sd * z[None]
        mu = np.exp(np.clip(eta, -30, 30))
        ll = (lg(y + size) - lgamma(size) - log_y)[:, None] + size * np.log(size / (size + mu)) + y[:, None] * np.log(mu / (size + mu))
        by_group = np.zeros((len(labels), nodes))
        np.add.at(by_group, g, w[:, None] * ll)
        return -float(np.logaddexp.reduce(by_group + q, 1).sum())

    def gradient(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p))
        for i in range(len(p)):
            h = 1e-5 * max(1, abs(p[i]))
            e = np.zeros(len(p))
            e[i] = h
            out[i] = (loss(p + e) - loss(p - e)) / (2 * h)
        return out

    p = np.zeros(x.shape[1] + 2)
    p[0], p[-1] = np.log(max(1e-6, (w * y).sum() / w.sum())), -1.0
    hess, f, gr, ok = np.eye(len(p)), loss(p), gradient(p), False
    for _ in range(200):
        if np.abs(gr).max() < 1e-4 * max(1, abs(f)) ** 0.5:
            ok = True
            break
        step, t = -hess @ gr, 1.0
        if step @ gr >= 0:
            hess, step = np.eye(len(p)), -gr
        while t > 1e-10 and not loss(p + t * step) <= f + 1e-4 * t * (step @ gr):
            t /= 2
        if t <= 1e-10:
            break
        newer = p + t * step
        g2 = gradient(newer)
        s, yv = newer - p, g2 - gr
        if s @ yv > 1e-12:
            r = 1 / (s @ yv)
            i = np.eye(len(p))
            hess = (i - r * np.outer(s, yv)) @ hess @ (i - r * np.outer(yv, s)) + r * np.outer(s, s)
        p, gr, f = newer, g2, loss(newer)
    full = np.array([(gradient(p + e) - gradient(p - e)) / (2e-4) for e in 1e-4 * np.eye(len(p))])
    full = (full + full.T) / 2
    positive = bool((np.linalg.eigvalsh(full) > 0).all())
    error = np.sqrt(np.clip(np.diag(np.linalg.pinv(full)), 0, None))
    k = x.shape[1]
    names = ("intercept", treat, *(f"covariate_{i}" for i in range(1, k - 1)))
    return CountModel(names, p[:k], error[:k], float(np.exp(p[-2])), float(np.exp(p[-1])), -f, ok and positive)
