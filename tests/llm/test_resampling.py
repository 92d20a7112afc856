"""Importance resampling against a plain version."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from capstan.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for i in range(len(words)) for n in (1, 2) if i + n <= len(words)]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + 10000) / ((s[b] + 1) * (every_t + 10000))))
    out = []
    for k, text in docs:
        words, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def query(spark, tmp_path, docs, target, extra=()):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return sorted(map(tuple, resampling.op13_importance_resampling(spark, str(tmp_path)).collect()), key=repr)


def drawn_texts(seed, n):
    rng = random.Random(seed)
    some = ["Ab", "c9", "é", "ÀB", "x-y", "Z_z", "été", "9", "mot", "word\x7fword"]
    return [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_query_equals_plain_version(spark, tmp_path):
    docs = list(enumerate(drawn_texts(1, 300)))
    assert query(spark, tmp_path, docs, drawn_texts(2, 20)) == brute(docs, drawn_texts(2, 20))


def test_nulls_long_texts_clashing_columns(spark, tmp_path, monkeypatch):
    docs = [(1, None), (2, ""), (3, "!?"), (None, "a b c " * 9), (5, "One two. " * 40_000), (6, "w" * 70_000), *((k, "a b c d " * 6) for k in range(10, 60))]
    assert query(spark, tmp_path, docs, ["a b", None], extra=("rank", "score", "buckets", "of", "eligible")) == brute(docs, ["a b", None])


def test_repeated_rows(spark, tmp_path):
    docs = [(7, "a b c d " * 6)] * 40 + [(8, "e f g h " * 6)] * 2
    assert query(spark, tmp_path, docs, ["a b"]) == brute(docs, ["a b"])


def test_empty_tables(spark, tmp_path):
    assert query(spark, tmp_path, [], ["a b"]) == []
    docs = list(enumerate(drawn_texts(4, 30)))
    assert query(spark, tmp_path, docs, []) == brute(docs, [])


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_ring_of_any_size_over_pieces(monkeypatch, longest):
    monkeypatch.setattr(resampling, "PIECE", 50)
    for text in [*drawn_texts(5, 40), "x" * 1000 + " y", " " * 200 + "a", "a" * 50 + " b"]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        runs = Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 97 for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words))
        count, got = resampling.ring_buckets(text.encode(), longest, 97)
        assert count == len(words) and Counter(got.tolist()) == runs


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted(map(tuple, resampling.op13_importance_resampling(spark, d).collect()), key=repr) == brute(docs, target)
