"""Linear and logistic models over rows, from sums that Spark makes: covariates may be numbers as well as categories.

Least squares needs one pass, which sums the products of each row's regressors (the Gram matrix) by group; a logistic fit needs one pass a
Newton step. Every task adds up its rows in numpy and passes on one matrix for each group, so what is shuffled and what reaches the driver
depends on the number of regressors alone. The estimates are those of a fit on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .categories import levels_of, with_levels
from .shared import kept

#: Bounds of a linear predictor, steps of a fit, and when it has settled.
_FAR, _STEPS, _SETTLED = 30.0, 50, 1e-10


@dataclass(frozen=True)
class Design:
    """Regressors of a table: their names and columns, an intercept first."""

    names: tuple[str, ...]
    columns: tuple[Column, ...]

    @property
    def vector(self) -> Column:
        return F.array(*self.columns)


def design(df: DataFrame, covariates: list[str]) -> Design:
    """An intercept; each number less its mean, in standard deviations; an indicator of all levels but the first of everything else, in the
    order of the levels that a column carries (see ``categories``) or else of its values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in covariates if isinstance(kinds[c], T.NumericType)]
    names, columns = ["intercept"], [F.lit(1.0)]
    spread = df.agg(*(f(F.col(c).cast("double")) for c in numbers for f in (F.avg, F.stddev_pop))).first() if numbers else ()
    for i, c in enumerate(numbers):
        mean, sd = spread[2 * i] or 0.0, spread[2 * i + 1] or 1.0
        names.append(c)
        columns.append((F.col(c).cast("double") - F.lit(float(mean))) / F.lit(float(sd)))
    for c in covariates:
        if c in numbers:
            continue
        value = F.col(c).cast("string")
        levels = levels_of(df, c)
        for level in (levels_of(with_levels(df, c), c) if levels is None else levels)[1:]:
            names.append(f"{c}={level}")
            columns.append(value.eqNullSafe(F.lit(level)).cast("double"))
    return Design(tuple(names), tuple(columns))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sums(rows: DataFrame, measure: Callable[[dict[str, np.ndarray]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums over all ``rows`` of what ``measure`` makes of a batch (columns as arrays): a few vectors of fixed length by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own = {n: _matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
            for k, v in measure(own).items():
                total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.arange(n)), pa.array(v.astype(float))], names=["what", "at", "value"])

    found = rows.mapInArrow(run, "what long, at long, value double").groupBy("what", "at").agg(F.sum("value").alias("value")).collect()  # of fixed size
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["what"], np.zeros(1 + max(x["at"] for x in found if x["what"] == r["what"])))[r["at"]] = r["value"]
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -_FAR, _FAR)))


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares from the normal equations; of several solutions the shortest."""
    return np.linalg.lstsq(gram, right, rcond=1e-12)[0]


def least_squares(rows: DataFrame, groups: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gram matrix and right-hand side of each group of ``rows`` (x: regressors, y, w, g: 0 to ``groups`` - 1), in one pass."""

    def measure(b):
        out = {}
        for k in range(groups):
            s = b["g"] == k
            x, y, w = b["x"][s], b["y"][s], b["w"][s]
            if len(x):
                out[k] = np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ (w * y)])
        return out

    found = sums(rows.select("x", "y", "w", "g"), measure)
    out = {}
    for k, v in found.items():
        p = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        out[k] = (v[: p * p].reshape(p, p), v[p * p :])
    return out


def logistic(rows: DataFrame, left_out: tuple[int, ...] = (-1,)) -> list[np.ndarray]:
    """Coefficients of logistic fits to ``rows`` (x, d, w, fold), one for each fold of ``left_out``, from all other folds (-1: all rows).
    All fits step together, one pass a Newton step."""
    p = len(rows.select("x").first()["x"])
    found = [np.zeros(p) for _ in left_out]
    going = set(range(len(left_out)))
    for _ in range(_STEPS):
        beta = {i: found[i] for i in going}

        def measure(b, beta=beta):
            out = {}
            for i, c in beta.items():
                s = b["fold"] != left_out[i]
                x, w = b["x"][s], b["w"][s]
                if len(x):
                    m = _logistic(x @ c)
                    out[i] = np.concatenate([(x.T @ (x * (w * m * (1 - m))[:, None])).ravel(), x.T @ (w * (b["d"][s] - m))])
            return out

        parts = sums(rows.select("x", "d", "w", "fold"), measure)
        for i in sorted(going):
            if i not in parts:
                going.discard(i)
                continue
            step = np.linalg.solve(parts[i][: p * p].reshape(p, p) + 1e-9 * np.eye(p), parts[i][p * p :])
            found[i] = found[i] + step
            if np.abs(step).max() < _SETTLED:
                going.discard(i)
        if not going:
            break
    return found


def propensity(df: DataFrame, treat: str, covariates: list[str], weight: Column | None = None, name: str = "score") -> DataFrame:
    """``df`` with the probability of treatment of each row, by a logistic fit to all rows without nulls; null where a covariate is."""
    ready = df.dropna(subset=[treat, *covariates])
    d = design(ready, covariates)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = kept(ready.select(d.vector.alias("x"), F.col(treat).cast("double").alias("d"), w.alias("w"), F.lit(0).alias("fold")), "regressors")
    if rows.isEmpty():
        return df.withColumn(name, F.lit(None).cast("double"))
    [beta] = logistic(rows)
    z = sum((c * F.lit(float(b)) for c, b in zip(d.columns[1:], beta[1:])), F.lit(float(beta[0])))
    return df.withColumn(name, F.when(_no_null(covariates), 1 / (1 + F.exp(-F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), z))))))


def _no_null(covariates: list[str]) -> Column:
    out = F.lit(True)
    for c in covariates:
        out = out & F.col(c).isNotNull()
    return out


@dataclass(frozen=True)
class Effects:
    ate: float
    atte: float
    n: float


def double_ml(df: DataFrame, treat: str, outcome: str, covariates: list[str], cluster: str, weight: Column | None = None, folds: int = 3, trim: float = 1e-12, fold: Column | None = None) -> Effects:
    """Interactive regression over rows: outcome by least squares in either arm, treatment by logistic regression, both cross fitted over
    folds of clusters; the effects are means of the orthogonal scores. ``weight`` stands for the number of equal rows; ``fold`` (0 to
    ``folds`` - 1) for the hash of the cluster."""
    ready = df.dropna(subset=[treat, outcome, cluster, *covariates])
    d = design(ready, covariates)
    fold = (F.pmod(F.xxhash64(F.col(cluster).cast("string")), F.lit(folds)) if fold is None else fold).cast("int")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = kept(
        ready.select(d.vector.alias("x"), F.col(outcome).cast("double").alias("y"), F.col(treat).cast("double").alias("d"), w.alias("w"), fold.alias("fold")).filter("w > 0"), "regressors"
    )
    grams = least_squares(rows.withColumn("g", (2 * F.col("fold") + F.col("d")).cast("int")), 2 * folds)
    p = len(d.columns)
    if not grams:
        return Effects(float("nan"), float("nan"), 0.0)
    zero = (np.zeros((p, p)), np.zeros(p))
    arms = []
    for k in range(folds):
        others = [[grams.get(2 * j + arm, zero) for j in range(folds) if j != k] for arm in (0, 1)]
        arms.append([_solved(sum(g for g, _ in o), sum(r for _, r in o)) for o in others])
    chance = logistic(rows, tuple(range(folds)))

    def measure(b):
        x, y, t, w, at = b["x"], b["y"], b["d"], b["w"], b["fold"]
        if not len(x):
            return {}
        g0, g1, m = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for k in range(folds):
            s = at == k
            g0[s], g1[s], m[s] = x[s] @ arms[k][0], x[s] @ arms[k][1], _logistic(x[s] @ chance[k])
        m = np.clip(m, trim, 1 - trim)
        against = (1 - t) * (y - g0) / (1 - m)
        both = w * (g1 - g0 + t * (y - g1) / m - against), w * (t * (y - g0) - m * against)
        return {0: np.array([w.sum(), (w * t).sum(), both[0].sum(), both[1].sum()])}

    total, treated, ate, atte = sums(rows, measure)[0]
    return Effects(float(ate / total), float(atte / treated) if treated else float("nan"), float(total))
