"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Indicators are of word n-grams (one and two words, hashed) and of shape n-grams: every token has a shape (lower case, capital, all
capitals, digits, mark, run of symbols, the same word again), and a shape 3-gram counts once in the band of its share of the text's
tokens, so a text's length does not matter. How many of a text's word pairs are distinct gives one more banded indicator. Each
indicator weighs the logarithm of the ratio of its smoothed shares in either class. The hinge-loss model on these is fitted by dual
coordinate descent, one step a document and pass; margins of documents left out in turn are calibrated by a logistic curve.

It is fitted on at most ``per_label`` rows of each label, of texts of at most ``longest`` characters (documented parameters); only
their hashed indicators reach the driver. Every row is scored, over its whole text.

Defined results: null and empty texts have no indicators and get the score of the bias alone; repeated rows are scored alike; an
empty table gives an empty table, and labels of one class or none a model that gives 0.5 to all; texts of any length are scored whole; a score of
exactly 0.5 is predicted 1; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import fold, labelled_sample
from .staging import small_batches, table
from .textops import list_array, lower_ascii, mix64, schema_with, slice_hash, spans_where, text_chunks, with_columns

WORDS_LOG2 = 19
SHAPES, BANDS = 16, 12
#: Indicators: hashed words and word pairs, shape 3-grams by band, distinct pairs by eighth.
FIRST_SHAPE = 1 << WORDS_LOG2
FIRST_DISTINCT = FIRST_SHAPE + SHAPES**3 * BANDS
INDICATORS = FIRST_DISTINCT + 9
#: Indicators of fewer documents weigh nothing.
LEAST_DOCUMENTS = 3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Marks of ordinary sentences.
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()-")] = True


def _counts(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and of symbol runs, in order; the text of each, and whether it is a word."""
    w0, w1, first = spans_where(_WORD[data], offsets)
    s0, s1, first_s = spans_where(~_WORD[data] & ~_SPACE[data], offsets)
    starts, ends, word = np.concatenate([w0, s0]), np.concatenate([w1, s1]), np.repeat([True, False], [len(w0), len(s0)])
    text = np.concatenate([np.searchsorted(first, np.arange(len(w0)), side="right"), np.searchsorted(first_s, np.arange(len(s0)), side="right")]) - 1
    by = np.argsort(starts, kind="stable")
    return starts[by], ends[by], text[by], word[by]


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of every indicator of every text, once each, sorted."""
    texts = len(offsets) - 1
    starts, ends, text, word = tokens(data, offsets)
    n = len(starts)
    hashes = slice_hash(lower_ascii(data), starts, ends, 31)
    follows = np.zeros(n, bool)
    follows[1:] = text[1:] == text[:-1]
    pair = np.flatnonzero(follows)
    pairs = mix64(hashes[pair - 1] * np.uint64(3) ^ hashes[pair])
    # Word indicators.
    low = np.uint64(64 - WORDS_LOG2)
    single = np.unique((text << WORDS_LOG2) | (hashes >> low).astype(np.int64))
    every = np.unique((text[pair] << WORDS_LOG2) | (pairs >> low).astype(np.int64))
    words = np.unique(np.concatenate([single, every]))
    # Shapes.
    upper, lower = _counts((data >= 65) & (data <= 90)), _counts(((data >= 97) & (data <= 122)) | (data >= 128))
    digit, mark = _counts((data >= 48) & (data <= 57)), _counts(_MARKS[data])
    ups, lows, digits, marks = (c[ends] - c[starts] for c in (upper, lower, digit, mark))
    size = ends - starts
    shape = np.select(
        [~word & (marks == size) & (size == 1), ~word & (size == 1), ~word, digits > 0, (ups > 1) & (ups >= lows), ups == 0, (ups == 1) & (data[np.minimum(starts, len(data) - 1)] <= 90)],
        [5, 6, 7, 3, 2, 0, 1], 4,
    ) if n else np.zeros(0, np.int64)
    # The same word again: as the token before, or as the one before a mark.
    again = np.zeros(n, bool)
    again[1:] = follows[1:] & (hashes[1:] == hashes[:-1])
    again[2:] |= follows[2:] & follows[1:-1] & (hashes[2:] == hashes[:-2])
    shape = np.where(again & word, shape + 8, shape)
    run = np.flatnonzero(follows[2:] & follows[1:-1]) + 2
    grams = (shape[run - 2] * SHAPES + shape[run - 1]) * SHAPES + shape[run]
    found = np.bincount(text[run] * SHAPES**3 + grams, minlength=texts * SHAPES**3)
    at = np.flatnonzero(found)
    owner = at // SHAPES**3
    total = np.maximum(np.bincount(text[run], minlength=texts), 1)
    band = np.minimum(np.floor(-np.log2(found[at] / total[owner])).astype(np.int64), BANDS - 1)
    shapes = FIRST_SHAPE + (at % SHAPES**3) * BANDS + band
    # Distinct pairs of all pairs.
    many, few = np.bincount(text[pair], minlength=texts), np.bincount(every >> WORDS_LOG2, minlength=texts)
    some = np.flatnonzero(many)
    distinct = FIRST_DISTINCT + (8 * few[some]) // many[some]
    owners = np.concatenate([words >> WORDS_LOG2, owner, some])
    kinds = np.concatenate([words & (FIRST_SHAPE - 1), shapes, distinct])
    by = np.lexsort((kinds, owners))
    return owners[by], kinds[by]


@dataclass(frozen=True)
class QualityModel:
    """weights by indicator; bias; slope and level of the logistic curve over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, owners: np.ndarray, kinds: np.ndarray, texts: int) -> np.ndarray:
        return _scaled_sum(owners, kinds, self.weights, texts) + self.bias

    def scores(self, owners: np.ndarray, kinds: np.ndarray, texts: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(owners, kinds, texts) + self.level, -30, 30)))


def _block_scale(owners: np.ndarray, kinds: np.ndarray, texts: int) -> np.ndarray:
    """What each indicator of a text counts: one over the root of how many of its block the text has, so that long texts weigh no more."""
    word = kinds < FIRST_SHAPE
    many = [np.maximum(np.bincount(owners[b], minlength=texts), 1) for b in (word, ~word)]
    return 1 / np.sqrt(np.where(word, many[0][owners], many[1][owners]))


def _scaled_sum(owners: np.ndarray, kinds: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owners, weights[kinds] * _block_scale(owners, kinds, texts), texts) if len(owners) else np.zeros(texts)


def log_count_ratios(kinds: np.ndarray, labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Of every indicator: the logarithm of its smoothed share among the indicators of good documents over that of bad ones."""
    out = np.zeros(INDICATORS)
    good, bad = (np.bincount(kinds[labels == v], minlength=INDICATORS).astype(float) for v in (1, 0))
    often = good + bad >= LEAST_DOCUMENTS
    for block in (slice(0, FIRST_SHAPE), slice(FIRST_SHAPE, INDICATORS)):
        p, q = (np.where(often[block], c[block] + alpha, 0) for c in (good, bad))
        if p.sum() and q.sum():
            p, q = p / p.sum(), q / q.sum()
            out[block] = np.where(often[block], np.log(np.where(often[block], p, 1)) - np.log(np.where(often[block], q, 1)), 0)
    return out


def hinge(first: np.ndarray, kinds: np.ndarray, values: np.ndarray, labels: np.ndarray, cost: np.ndarray, passes: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model by dual coordinate descent. Document i has the indicators
    ``kinds[first[i]:first[i + 1]]`` with ``values``; ``cost`` bounds its dual variable; the bias is a constant indicator."""
    w, b, y = np.zeros(INDICATORS), 0.0, np.where(labels == 1, 1.0, -1.0)
    dual = np.zeros(len(labels))
    square = np.array([values[a:e] @ values[a:e] for a, e in zip(first[:-1], first[1:])]) + 1.0
    order = np.random.default_rng(5)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(labels)).tolist():
            own = slice(first[i], first[i + 1])
            slack = y[i] * (w[kinds[own]] @ values[own] + b) - 1
            moved = min(max(dual[i] - slack / square[i], 0.0), cost[i]) - dual[i]
            if moved:
                dual[i] += moved
                w[kinds[own]] += moved * y[i] * values[own]  # an indicator stands once in a document
                b += moved * y[i]
                most = max(most, abs(moved))
        if most < tolerance * cost.max():
            break
    return w, b


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton steps, with targets a little off 0 and 1."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, c = np.stack([margins, np.ones(len(margins))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(c[0], 1e-3)), float(c[1])


def train(documents: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0, parts: int = 3) -> QualityModel:
    """Fit on the indicators of ``documents`` and their ``labels`` (0 or 1)."""
    if not len(labels) or labels.min() == labels.max():
        return QualityModel(np.zeros(INDICATORS, np.float32), 0.0, 1.0, 0.0)
    first = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    owners, kinds = np.repeat(np.arange(len(documents)), np.diff(first)), np.concatenate(documents)
    scale = _block_scale(owners, kinds, len(documents))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)

    def fitted(use: np.ndarray) -> tuple[np.ndarray, float]:
        inside = use[owners]
        ratio = log_count_ratios(kinds[inside], labels[owners[inside]])
        ends = np.concatenate([[0], np.cumsum(np.diff(first)[use])])
        w, b = hinge(ends, kinds[inside], (ratio[kinds] * scale)[inside], labels[use], penalty * weight[use])
        return w * ratio, b

    part, left_out = np.arange(len(labels)) % parts, np.zeros(len(labels))
    for k in range(parts):
        rest = part != k
        if 0 < labels[rest].sum() < rest.sum():
            w, b = fitted(rest)
            left_out[~rest] = (_scaled_sum(owners, kinds, w, len(labels)) + b)[~rest]
    w, b = fitted(np.ones(len(labels), bool))
    return QualityModel(w.astype(np.float32), float(b), *logistic_curve(left_out, labels, weight))


def with_indicators(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by its indicators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                owners, kinds = indicators(data, offsets)
                yield with_columns(batch.slice(lo, hi - lo), {"indicators": list_array(kinds.astype(np.int32), np.bincount(owners, minlength=hi - lo), pa.int32())}, (text,))

    return docs.mapInArrow(run, schema_with(docs, [T.StructField("indicators", T.ArrayType(T.IntegerType()))], (text,)))


def fit(rows: DataFrame, per_label: int = 2500, longest: int = 20_000) -> QualityModel:
    """Learn from ``rows`` (doc_id, text, quality): at most ``per_label`` rows of each label that are no longer than
    ``longest`` characters; their indicators reach the driver."""
    small_batches(rows.sparkSession)
    usable = rows.filter(F.col("quality").isin(0, 1) & (F.length("text") <= longest))
    sample = labelled_sample(usable.select("doc_id", "text", "quality"), "quality", ("doc_id", "text"), per_label)
    got = with_indicators(sample.withColumn("key", F.xxhash64("doc_id", "text")).select("key", "quality", "text")).toArrow().sort_by([("key", "ascending"), ("quality", "ascending")])
    lists = got["indicators"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return train([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], got["quality"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: QualityModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with score and predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one weight for each of a fixed number of indicators
    drop = (text,) if drop_text else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                p = m.scores(*indicators(data, offsets), hi - lo)
                yield with_columns(batch.slice(lo, hi - lo), {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))}, drop)

    return docs.mapInArrow(run, schema_with(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], drop))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(F.col("doc_id"), 3) != 1)
    # Of each label about as many ids as are learned from, so that few texts are joined; ids with both labels count for neither.
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    rows = docs.join(F.broadcast(labelled_sample(agreed, "quality", ("doc_id",), 3000)), "doc_id")  # 3000 ids a label at most
    scored = score(docs, fit(rows), drop_text=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
