"""Weak supervision of text quality: rules vote or abstain, expectation-maximisation learns how far to trust them.

Each rule looks at a few counts of a whole text and votes good (1), bad (-1) or abstains (0). The corpus is
reduced to the histogram of vote patterns (at most 3 ** rules rows whatever the corpus holds), over which
expectation-maximisation estimates each rule's accuracy and the share of good documents. A document's
posterior follows from its votes by a sum of log-odds, as a column expression.

Defined results: null or empty text has zero counts, fails the base rule and is not kept; repeated rows are
judged alike; an empty table gives an empty table and a model of the prior; very long texts are counted whole; a posterior
of exactly the threshold is kept; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import small_batches, staged, table
from .textops import WORD_BREAKS, schema_with, with_columns

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: What ends a sentence.
SENTENCE_ENDS = b".!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_digits", "top_word"]


def counts_of(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    raw = text.encode()
    words = raw.split()  # splits on WORD_BREAKS exactly
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            last = -1
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, last)
                    last = i + 3
    return (
        n,
        len(text) - (len(raw) - len(raw.translate(None, WORD_BREAKS))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, SENTENCE_ENDS)),
        len(raw) - len(raw.translate(None, b"0123456789")),
        max(Counter(words).values(), default=0),
    )


def with_counts(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with COUNTS as longs."""
    small_batches(docs.sparkSession)
    drop = (text,) if drop_text else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rows = np.array([counts_of(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(COUNTS))
            yield with_columns(batch, {c: pa.array(rows[:, i]) for i, c in enumerate(COUNTS)}, drop)

    return docs.mapInArrow(run, schema_with(docs, [T.StructField(c, T.LongType()) for c in COUNTS], drop))


def _per_word(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("n_words"), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule, over COUNTS. A rule abstains between its two thresholds."""
    mean_length = _per_word("word_chars")
    ends = _per_word("n_ends")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    plain = F.col("word_chars") - F.col("n_symbols") - F.col("n_digits") - F.col("n_ends")
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "word_length": _vote(mean_length.between(3, 10), (mean_length < 2) | (mean_length > 15)),
        "symbols": _vote(_per_word("n_symbols") < 0.05, _per_word("n_symbols") > 0.15),
        "repeated_lines": _vote(F.col("n_dup_lines") == 0, (lines > 0.4) & (F.col("n_lines") >= 4)),
        "repeated_words": _vote(_per_word("n_repeat_words") < 0.15, _per_word("n_repeat_words") > 0.35),
        "sentences": _vote(ends.between(0.02, 0.4), (ends < 0.005) | (ends > 1)),
        "letters": _vote(plain > 0.85 * F.col("word_chars"), plain < 0.75 * F.col("word_chars")),
        "top_word": _vote(_per_word("top_word") < 0.15, _per_word("top_word") > 0.3),
    }


@dataclass(frozen=True)
class LabelModel:
    """on_good, on_bad: how often a rule that votes is right on a good, on a bad document."""

    names: tuple[str, ...]
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    good_share: float
    rounds: int

    def log_odds(self) -> list[tuple[float, float]]:
        """What a vote for good, and a vote for bad, adds to the log-odds of good."""
        return [(float(np.log(g / (1 - b))), float(np.log((1 - g) / b))) for g, b in zip(self.on_good, self.on_bad)]

    def posterior(self, votes: dict[str, Column]) -> Column:
        score = F.lit(float(np.log(self.good_share / (1 - self.good_share))))
        for name, (good, bad) in zip(self.names, self.log_odds()):
            score = score + F.when(votes[name] == 1, good).when(votes[name] == -1, bad).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


#: Keeps logarithms finite; the votes decide whether a rule is to be believed, and which way.
BOUNDS = (0.001, 0.999)
#: Pseudo-votes right and wrong, on good and on bad documents.
PRIOR_GOOD, PRIOR_BAD = (19.0, 1.0), (2.0, 2.0)
#: Pseudo-documents, good and bad.
PRIOR_SHARE = (1.0, 1.0)


def estimate(patterns: np.ndarray, weights: np.ndarray, names: tuple[str, ...], most: int = 100, tolerance: float = 1e-6) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns (rows of -1, 0, 1) and how often each occurs.

    It starts from the belief that a document against which a rule votes is more likely bad.
    """
    up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)
    good = np.where(down.any(1), 0.2, 0.95)
    on_good = on_bad = np.full(len(names), 0.5)
    share, n = 0.5, 0
    for n in range(1, most + 1):
        g, b = (good * weights)[:, None], ((1 - good) * weights)[:, None]
        newer_good = np.clip(((up * g).sum(0) + PRIOR_GOOD[0]) / (((up + down) * g).sum(0) + sum(PRIOR_GOOD)), *BOUNDS)
        newer_bad = np.clip(((down * b).sum(0) + PRIOR_BAD[0]) / (((up + down) * b).sum(0) + sum(PRIOR_BAD)), *BOUNDS)
        moved = max(np.abs(newer_good - on_good).max(initial=0), np.abs(newer_bad - on_bad).max(initial=0))
        on_good, on_bad = newer_good, newer_bad
        share = float(np.clip((g.sum() + PRIOR_SHARE[0]) / (weights.sum() + sum(PRIOR_SHARE)), *BOUNDS))
        odds = np.log(share / (1 - share)) + up @ np.log(on_good / (1 - on_bad)) + down @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-odds))
        if moved < tolerance:
            break
    return LabelModel(names, tuple(map(float, on_good)), tuple(map(float, on_bad)), share, n)


def fit(counted: DataFrame) -> LabelModel:
    """Learn from the votes of every row; only the pattern histogram, bounded by 3 ** rules, reaches the driver."""
    votes = rules()
    names = tuple(votes)
    rows = counted.select(*(v.alias(k) for k, v in votes.items())).groupBy(*names).count().collect()
    patterns = np.array([[r[k] for k in names] for r in rows], float).reshape(-1, len(names))
    return estimate(patterns, np.array([r["count"] for r in rows], float), names)


def judge(counted: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """``counted`` with base_failed, posterior (of being good) and kept."""
    n = F.col("n_words")
    return counted.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).withColumn(
        "posterior", model.posterior(rules())
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = staged(with_counts(docs, drop_text=True), "quality-counts")
    judged = judge(counted, fit(counted))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")
