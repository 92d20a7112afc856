"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its character n-grams (whole text, lower case, hashed to a fixed
number of rows); a linear softmax over that mean gives the language. Both layers are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. A part of the sample is set aside to fit a
temperature and the confidence under which a prediction is rejected.

Defined results: null texts and texts without a letter get `und`, score 0 and are rejected; repeated rows are
scored alike; an empty table, or one without labels, gives `und` everywhere; columns named like the outputs
are replaced; very long texts are read whole; of labels with equal scores the first in order is taken.
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
from .textops import give_back, schema_with, with_columns

UNKNOWN = "und"
#: Rows of the embedding table (a power of two), their width, and the n-gram lengths.
ROWS_LOG2, WIDTH, ORDERS = 15, 12, (1, 2, 3)
#: Code points that are worked on at once.
CHUNK_POINTS = 1 << 19
#: The share of accepted predictions that shall be right.
SURE = 0.95
_GAP = "\0\0\0"


def _is_letter() -> np.ndarray:
    from .byte_bpe import LETTER, code_point_classes

    return code_point_classes() == LETTER


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all n-grams, text by text, and how many each text has.

    Code points that are no letters count as a space. An n-gram is taken where it begins with a letter, or
    with a space before a letter, so every letter of the text takes part.
    """
    lowered = [t.lower() for t in texts]
    joined = _GAP.join([*lowered, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    letter = _is_letter()[points]
    points = np.where(letter, points, np.uint32(32))
    n = len(points)
    begins = letter.copy()
    begins[:-1] |= letter[1:] & (points[:-1] == 32)
    at = np.flatnonzero(begins)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    firsts = np.cumsum(sizes + len(_GAP)) - (sizes + len(_GAP))
    # A gap's last code point can count as the space before the next text's first letter.
    cuts = np.searchsorted(at, np.append(np.maximum(firsts - 1, 0), n))
    padded = np.concatenate([points, np.full(len(_GAP), 32, np.uint32)])
    out, h = [], np.zeros(len(at), np.uint32)
    for k in range(max(ORDERS)):
        h = (h ^ padded[at + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out.append((h * np.uint32(0x85EBCA6B) + np.uint32(k)) >> np.uint32(32 - ROWS_LOG2))
    return np.stack(out, 1).ravel().astype(np.int64), np.diff(cuts) * len(out)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    rows: np.ndarray  # embedding table times the output layer: one row of scores for each n-gram row
    bias: np.ndarray
    temperature: float
    least_confidence: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label index (-1: no letter), calibrated confidence, and whether it is accepted."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if self.labels:
            ids, n = features(texts)
            full = np.flatnonzero(n)
            if len(full):
                firsts = (np.cumsum(n) - n)[full]
                # One column at a time: reduceat over a contiguous column is fast and needs little memory.
                mean = np.stack([np.add.reduceat(c[ids], firsts) for c in self.rows.T], 1) / n[full][:, None]
                p = softmax((mean + self.bias) / self.temperature)
                best[full], score[full] = p.argmax(1), p.max(1)
        return best, score, score >= max(self.least_confidence, 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pieces_of(texts: list[str], labels: list[int], words: int) -> tuple[list[str], np.ndarray]:
    """Whole texts cut into runs of ``words`` words: short examples from all parts of each text."""
    out, y = [], []
    for text, label in zip(texts, labels):
        parts = text.split()
        for i in range(0, max(1, len(parts)), words):
            out.append(" ".join(parts[i : i + words]))
            y.append(label)
    return out, np.array(y, np.int64)


def train(texts: list[str], langs: list[str], most_examples: int = 12_000, rounds: int = 3, rate: float = 0.6, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent on pieces of the texts; every eighth text only calibrates.

    At most ``most_examples`` pieces are used, the same number of each language where there are as many.
    """
    names = tuple(sorted(set(langs)))
    if not names:
        return LanguageModel((), np.zeros((1 << ROWS_LOG2, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y_all = [names.index(x) for x in langs]
    order = rng.permutation(len(texts))
    aside = set(order[::8].tolist()) if len(texts) >= 16 else set()
    fit = [i for i in range(len(texts)) if i not in aside]
    pieces, y = pieces_of([texts[i] for i in fit], [y_all[i] for i in fit], 24)
    # Each language's pieces in random order; what one language lacks goes to the others.
    shuffled = rng.permutation(len(pieces))
    turn = np.zeros(len(pieces), np.int64)
    for k in range(len(names)):
        own = shuffled[y[shuffled] == k]
        turn[own] = np.arange(len(own))
    pick = np.sort(np.lexsort((np.argsort(shuffled), turn))[:most_examples])
    pieces, y = [pieces[i] for i in pick], y[pick]
    ids, n = features(pieces)
    firsts = np.cumsum(n) - n
    table_ = rng.normal(0, 0.1, (1 << ROWS_LOG2, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    step, steps = 0, max(1, rounds * -(-len(pieces) // 64))
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(pieces)), max(1, len(pieces) // 64)):
            step += 1
            batch = batch[n[batch] > 0]
            if not len(batch):
                continue
            lr = rate * (1 - step / (steps + 1))
            here = np.concatenate([ids[firsts[b] : firsts[b] + n[b]] for b in batch])
            size, starts = n[batch], np.cumsum(n[batch]) - n[batch]
            mean = np.add.reduceat(table_[here], starts) / size[:, None]
            g = softmax(mean @ out + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            down = (g @ out.T / size[:, None]).astype(np.float32) * 40
            out -= lr * (mean.T @ g / len(batch) * 40).astype(np.float32)
            bias -= lr * g.mean(0).astype(np.float32)
            for c in range(WIDTH):  # a sum per row, then one step
                table_[:, c] -= lr * np.bincount(here, np.repeat(down[:, c], size), 1 << ROWS_LOG2).astype(np.float32) / len(batch)
    model = LanguageModel(names, (table_ @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if not aside:
        return model
    # Whole texts and short pieces, as both are predicted later.
    held_texts, held_labels = [texts[i] for i in sorted(aside)], [y_all[i] for i in sorted(aside)]
    held, truth = pieces_of(held_texts, held_labels, 24)
    held, truth = held + held_texts, np.concatenate([truth, held_labels])
    ids, n = features(held)
    full = np.flatnonzero(n)
    z = np.stack([np.add.reduceat(c[ids], (np.cumsum(n) - n)[full]) for c in model.rows.T], 1) / n[full][:, None] + bias
    truth = truth[full]
    losses = {t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in np.geomspace(0.02, 10, 40)}
    best = float(min(losses, key=losses.get))
    p = softmax(z / best)
    right = p.argmax(1) == truth
    # The lowest confidence from which on at least 19 of 20 examples set aside are right.
    order = np.argsort(-p.max(1), kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= SURE)
    least = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(names, model.rows, model.bias, best, least)


def fit(rows: DataFrame, per_language: int = 400, longest: int = 20_000, most_examples: int = 12_000) -> LanguageModel:
    """Learn from ``rows`` (doc_id, text, lang): at most ``per_language`` rows of each language that are no longer than
    ``longest`` characters reach the driver, and at most ``most_examples`` pieces of 24 words of them are learned from."""
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    got = labelled_sample(usable.select("doc_id", "text", "lang"), "lang", ("doc_id", "text"), per_language).collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got], most_examples)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of rows for each language
    drop = (text,) if drop_text else ()
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            parts, lo, size = [], 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size >= CHUNK_POINTS or hi == len(texts):
                    parts.append(m.predict(texts[lo:hi]))
                    lo, size = hi, 0
            best, score, ok = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else ((), (), ())))
            new = {"lang_pred": pa.array(names[best.astype(int)].tolist(), pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(ok.astype(bool))}
            yield with_columns(batch, new, drop)
        give_back()

    return docs.mapInArrow(run, schema_with(docs, fields, drop))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    scored = predict(docs.select("doc_id", "text"), model, drop_text=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
