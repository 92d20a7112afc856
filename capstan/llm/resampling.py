"""Importance resampling towards a target: hashed n-gram counts of corpus and target weigh every document, and a Gumbel draw picks.

One scan of each text keeps the running CRC-32 states of the last starts in a ring. A word extends each state by a space and its
bytes and starts a new one, so every run of one to n words gets its hash without being built; the states are emitted as buckets,
which are written once and serve both the counts and the weights. Counts are combined within tasks and then by bucket; what reaches
the driver and the workers is one number for each bucket, whatever the size of the corpus. A document's weight is the floored mean
of its features' gains; with an independent Gumbel number from a hash of its id added, the highest scores are a draw without
replacement in proportion to the exponents. Ranks come from the counts of each distinct score and the order inside it, never from one
sorted task.

Defined results: null and empty texts have no features, weight 0 and too few words to be drawn; texts of any length are read whole, in
pieces; equal scores go by doc_id, null last; rows of one id have the same Gumbel number, equal ones follow each other in any
order; a null id is hashed as empty; an empty corpus gives an empty table, an empty target gains that are lower the more frequent
a bucket is; columns beside id and text take no part and are not returned.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches, staged, table
from .textops import list_array

#: Digits, lower-case letters and all bytes from 128 on make words; A-Z count as lower case.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are split into words at a time.
PIECE = 1 << 20
#: Gains and Gumbel numbers are whole thousandths.
SCALE = 1000


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; a piece ends between words."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_WORD_BYTES)
        at += len(piece)
        step = 128
        while at < len(text) and not piece.endswith(b" "):  # on to the end of the word
            step *= 2
            rest = text[at : at + step].translate(_WORD_BYTES)
            stop = rest.find(b" ")
            rest = rest if stop < 0 else rest[: stop + 1]
            piece += rest
            at += len(rest)
        yield piece.split()


def ring_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of every run of 1 to ``longest`` of them, repeats included."""
    words, out, ring = 0, [], []
    for piece in word_pieces(text):
        words += len(piece)
        states = array("L")
        if longest == 2:  # a ring of one state
            last = ring[0] if ring else None
            for word in piece:
                if last is not None:
                    states.append(crc32(word, crc32(b" ", last)))
                last = crc32(word)
                states.append(last)
            ring = [] if last is None else [last]
        else:
            for word in piece:
                ring = [crc32(word, crc32(b" ", s)) for s in islice(ring, max(0, len(ring) - longest + 1), None)] if longest > 1 else []
                ring.append(crc32(word))
                states.extend(ring)
        out.append((np.frombuffer(states, np.dtype("L")) % buckets).astype(np.int32))
    return words, np.concatenate(out) if out else np.zeros(0, np.int32)


def bucketed(docs: DataFrame, keep: tuple[str, ...], text: str, longest: int, buckets: int) -> DataFrame:
    """The ``keep`` columns, n_words and buckets of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held, counts, found = batch.column(len(keep)), 0, 0, [], []
            for k in range(batch.num_rows):
                body = texts[k].as_buffer() if texts[k].is_valid else None
                n, b = ring_buckets(body.to_pybytes() if body else b"", longest, buckets)
                counts.append(n)
                found.append(b)
                held += len(b)
                if held > PIECE or k + 1 == batch.num_rows:
                    lists = list_array(np.concatenate(found), np.array([len(x) for x in found]), pa.int32())
                    own = [batch.column(i).slice(first, len(found)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), lists], names=[*keep, "n_words", "buckets"])
                    first, held, counts, found = k + 1, 0, [], []

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text).mapInArrow(run, kinds + "n_words long, buckets array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, over all rows; one row a bucket and task is shuffled, one a bucket is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the corpus."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gains: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns, n_words, n_features and weight of every row of ``features``."""
    shared = features.sparkSession.sparkContext.broadcast(gains)  # one number for each of a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("buckets"))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(table[lists.flatten().to_numpy(zero_copy_only=False)])])
            n = np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            own = [batch.column(batch.schema.get_field_index(c)) for c in (*keep, "n_words")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(weight)], names=[*keep, "n_words", "n_features", "weight"])

    kinds = "".join(f"`{c}` {features.schema[c].dataType.simpleString()}, " for c in keep)
    return features.mapInArrow(run, kinds + "n_words long, n_features long, weight long")


def drawn(scored: DataFrame, eligible, percent: int, key: str = "doc_id") -> DataFrame:
    """``scored`` (with score, a whole number) and rank: 1, 2, 3... of the ``percent`` of the eligible rows with the highest scores,
    ties to the smaller ``key``; null for the others.

    Rows are counted by score, whose range does not grow with the corpus; sums over that small table say where each score's ranks
    begin, and only rows of equal score are ordered with each other.
    """
    counts = scored.filter(eligible).groupBy(F.col("score").alias("of")).agg(F.count("*").alias("rows")).collect()
    left = sum(r["rows"] for r in counts) * percent // 100
    at, begins = 0, []
    for r in sorted(counts, key=lambda r: -r["of"]):
        if at >= left:
            break
        begins.append((r["of"], at))
        at += r["rows"]
    spark = scored.sparkSession
    offsets = F.broadcast(spark.createDataFrame(begins, "of long, begin long"))  # at most one row for each score in reach
    inside = F.row_number().over(Window.partitionBy("eligible", "score").orderBy(F.asc_nulls_last(key)))
    ranked = scored.withColumn("eligible", eligible).join(offsets, F.col("eligible") & (F.col("score") == F.col("of")), "left")
    # Rows out of reach of the draw are not ordered.
    reached = ranked.filter("of is not null").withColumn("rank", F.col("begin") + inside).withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    rest = ranked.filter("of is null").withColumn("rank", F.lit(None).cast("long"))
    return reached.unionByName(rest).drop("eligible", "of", "begin")


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    features = staged(bucketed(docs, ("doc_id",), "text", longest, buckets), "buckets")
    gains = gains_of(bucket_counts(features, buckets), bucket_counts(bucketed(target, (), "text", longest, buckets), buckets))
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(F.lit(-float(SCALE)) * F.log(-F.log(unit))).cast("long")
    scored = staged(weighted(features, gains, ("doc_id",)).withColumn("score", F.col("weight") + gumbel), "scores")
    return drawn(scored, F.col("n_words") >= least_words, percent)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
