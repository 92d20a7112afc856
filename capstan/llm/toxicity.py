"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels.

A sentence's score is a logistic function of hashed weights of its words and their stems, and of nothing else in its text; a document
is toxic if at least one of its sentences is, so its score is one minus the product of (1 - sentence score), in training and
in scoring; a sentence with the words of an earlier one of its text is the same instance and counts once. More text can therefore only add to a document's score. Only document labels are needed for training, and the
sentence scores then say where the offence is.

Mild scores of many clean sentences would add up, so the slope and level of the logistic function are fitted apart, on sentences that the
weights were not learned from, under the same noisy-or over bags: single texts, and ten and a hundred texts together, all clean or one of
them toxic.

Defined results: null and empty texts have no sentence and score 0; repeated rows are scored alike; an empty
table gives an empty table, and a table without labels a model that scores everything near 0; very long texts are scored
whole; a score of exactly 0.5 is predicted 1; columns named like the outputs are replaced.
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
from .textops import code_points_before, lower_ascii, mix64, schema_with, slice_hash, spans_where, text_chunks, with_columns

ROWS_LOG2 = 19
#: The bytes that end a sentence.
SENTENCE_ENDS = b".!?\n"
#: How many texts are put together to fit the slope, with the weight of such bags, and how sure of a text's label that fit is.
BAGS, SURE = {1: 1.0, 10: 0.3, 100: 0.1}, 0.9
#: Steep enough that the mild scores of clean sentences do not add up.
SLOPES = (3.0, 4.0, 6.0)
#: Besides itself, a word counts by its first bytes, so that inflected forms share weights.
STEMS = (4, 5, 6)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(SENTENCE_ENDS)] = True


@dataclass(frozen=True)
class Sentences:
    """Features of texts: hashed words and stems with the sentence of each, sentences with the text of each."""

    words: np.ndarray
    sentence_of_word: np.ndarray
    text_of_sentence: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Not the same words as an earlier sentence of the text.
    fresh: np.ndarray


def sentences_of(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Sentences are runs without an end mark that hold a word; words are runs of letters, digits and apostrophes."""
    low = lower_ascii(data)
    starts, ends, first_of_text = spans_where(~_ENDS[data], offsets)
    w0, w1, _ = spans_where(_WORD[data], offsets)
    sentence = np.searchsorted(starts, w0, side="right") - 1
    used = np.unique(sentence)
    hashes, owners = [slice_hash(low, w0, w1, 11)], [sentence]
    for k in STEMS:
        long = np.flatnonzero(w1 - w0 > k)
        hashes.append(slice_hash(low, w0[long], w0[long] + k, 11) ^ np.uint64(k << 58))
        owners.append(sentence[long])
    hashed = (np.concatenate(hashes) >> np.uint64(64 - ROWS_LOG2)).astype(np.int64)
    # A sentence has a word once, however often it repeats it.
    pairs = np.unique((np.concatenate(owners) << ROWS_LOG2) | hashed)
    sentence, hashed = pairs >> ROWS_LOG2, pairs & ((1 << ROWS_LOG2) - 1)
    text = np.searchsorted(first_of_text, used, side="right") - 1
    own = np.searchsorted(used, sentence)
    fresh = np.zeros(len(used), bool)
    if len(used):
        mark = np.add.reduceat(mix64(hashed.astype(np.uint64) + np.uint64(1)), np.searchsorted(own, np.arange(len(used)))) ^ mix64(text.astype(np.uint64) + np.uint64(1))
        fresh[np.unique(mark, return_index=True)[1]] = True
    return Sentences(hashed, own, text, starts[used], ends[used], fresh)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class ToxicityModel:
    """weights by hashed word; bias; slope and level of the logistic function over their sum."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    level: float = 0.0

    def sums(self, s: Sentences) -> np.ndarray:
        return self.bias + np.bincount(s.sentence_of_word, self.weights[s.words], len(s.starts))

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        return _sigmoid(self.slope * (self.sums(s) - self.level))

    def text_scores(self, s: Sentences, texts: int) -> np.ndarray:
        """Noisy-or over all sentences, repeated ones once."""
        return -np.expm1(np.bincount(s.text_of_sentence, np.log1p(-self.sentence_scores(s)) * s.fresh, texts))


def _weights(words: np.ndarray, sentence: np.ndarray, text: np.ndarray, y: np.ndarray, rounds: int, rate: float, shrink: float, least_texts: int) -> tuple[np.ndarray, float]:
    """Gradient steps (Adam) on the noisy-or likelihood, both labels weighing alike, each followed by a shrinking of the weights."""
    size, n = 1 << ROWS_LOG2, len(text)
    # Words of fewer texts than least_texts keep weight 0.
    pairs = np.unique(words.astype(np.int64) * len(y) + text[sentence])
    often = np.bincount(pairs // len(y), minlength=size) >= least_texts
    sel = often[words]
    sentence = sentence[sel]
    columns, words = np.unique(words[sel], return_inverse=True)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(columns)), -3.0
    m = v = np.zeros(len(columns) + 1)
    for t in range(1, rounds + 1):
        p = _sigmoid(b + np.bincount(sentence, w[words], n))
        doc = np.clip(-np.expm1(np.bincount(text, np.log1p(-p), len(y))), 1e-9, 1 - 1e-9)
        g = np.where(y[text] == 1, -(1 - doc[text]) / doc[text], 1.0) * p * weight[text]
        grad = np.append(np.bincount(words, g[sentence], len(columns)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        moved = np.append(w, b) - pace * m / (1 - 0.9**t)
        w, b = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - pace[:-1] * shrink, 0), moved[-1]
    out = np.zeros(size, np.float32)
    out[columns] = w
    return out, float(b)


def _slope_and_level(z: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The likeliest pair of a grid for the sums ``z`` of sentences, under the noisy-or over bags of texts."""
    r, toxic, clean = np.random.default_rng(6), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    bags = [(r.choice(clean, (len(toxic), k)), np.hstack([toxic[:, None], r.choice(clean, (len(toxic), k - 1))])) for k in BAGS]

    def loss(slope: float, level: float) -> float:
        hazard = -np.bincount(text, np.log1p(-_sigmoid(slope * (z - level))), len(y))
        out = 0.0
        for share, (none, one) in zip(BAGS.values(), bags):
            p0, p1 = (SURE * -np.expm1(-hazard[x].sum(1)) + (1 - SURE) / 2 for x in (none, one))
            out -= share * (np.log(1 - p0).mean() + np.log(p1).mean())
        return out

    return min(((s, c) for s in SLOPES for c in np.arange(-4, 3.01, 0.5).tolist()), key=lambda x: loss(*x))


def train(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.1, shrink: float = 1e-4, least_texts: int = 3) -> ToxicityModel:
    """Weights from all texts; slope and level from halves whose weights the other half gave."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << ROWS_LOG2, np.float32), -12.0)
    parts, n_sent = [], 0
    for lo, hi, data, offsets in text_chunks(pa.array(texts, pa.large_string())):
        s = sentences_of(data, offsets)
        sel, number = s.fresh[s.sentence_of_word], np.cumsum(s.fresh) - 1
        parts.append((s.words[sel], number[s.sentence_of_word[sel]] + n_sent, s.text_of_sentence[s.fresh] + lo))
        n_sent += int(s.fresh.sum())
    words, sentence, text = (np.concatenate(x) for x in zip(*parts))
    half, z, whole = np.arange(len(y)) % 2, np.zeros(n_sent), True
    for k in (0, 1):
        use = half == k
        if y[use].min() == y[use].max() or y[~use].min() == y[~use].max():
            whole = False
            break
        own, number = use[text], np.cumsum(use) - 1
        sel = own[sentence]
        w, b = _weights(words[sel], (np.cumsum(own) - 1)[sentence[sel]], number[text[own]], y[use], rounds, rate, shrink, least_texts)
        z[~own] = (b + np.bincount(sentence, w[words], n_sent))[~own]
    return ToxicityModel(*_weights(words, sentence, text, y, rounds, rate, shrink, least_texts), *(_slope_and_level(z, text, y) if whole else (1.0, 0.0)))


def fit(rows: DataFrame, per_label: int = 2500, longest: int = 20_000) -> ToxicityModel:
    """Learn from ``rows`` (doc_id, text, toxic): at most ``per_label`` rows of each label that are no
    longer than ``longest`` characters reach the driver."""
    usable = rows.filter(F.col("toxic").isin(0, 1) & (F.length("text") <= longest))
    got = labelled_sample(usable.select("doc_id", "text", "toxic"), "toxic", ("doc_id", "text"), per_label).collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"], r["toxic"]))
    return train([r["text"] for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5, drop_text: bool = False) -> DataFrame:
    """``docs`` with score, predicted, and offending: the sentences (code points, end exclusive, with their
    score) that score ``least`` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one weight for each of a fixed number of hashed words
    drop = (text,) if drop_text else ()
    spot = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(spot))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                s = sentences_of(data, offsets)
                p, found = m.text_scores(s, hi - lo), m.sentence_scores(s)
                hit = np.flatnonzero(found >= least)
                owner, points = s.text_of_sentence[hit], code_points_before(data)
                begin = points[offsets[owner]]
                cells = [pa.array(points[s.starts[hit]] - begin), pa.array(points[s.ends[hit]] - begin), pa.array(found[hit])]
                spots = list_array_of(pa.StructArray.from_arrays(cells, ["start", "end", "score"]), np.bincount(owner, minlength=hi - lo))
                new = {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32)), "offending": spots}
                yield with_columns(batch.slice(lo, hi - lo), new, drop)

    return docs.mapInArrow(run, schema_with(docs, fields, drop))


def list_array_of(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold(F.col("doc_id"), 5) != 0)
    # Of each label about as many ids as are learned from, so that few texts are joined; ids with both labels count for neither.
    agreed = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    rows = docs.join(F.broadcast(labelled_sample(agreed, "toxic", ("doc_id",), 3000)), "doc_id")  # 3000 ids a label at most
    model = fit(rows)
    scored = score(docs, model, drop_text=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
