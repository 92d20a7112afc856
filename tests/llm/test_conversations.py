"""Conversation repair against an enumeration of all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from capstan.llm import conversations
from capstan.llm.staging import staged

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(turns, fault, most_insertions=3):
    """(cost, audit, lines) of all edit sequences with few insertions whose result fits the grammar, least first."""
    found = []

    def go(i, cost, audit, said, lines, left):
        if i == len(turns) and GRAMMAR.fullmatch(said):
            found.append((cost, audit, lines))
        if left:
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", said + r[0], [*lines, r + ":"], left - 1)
        if i == len(turns):
            return
        _, _, role, text = turns[i]
        go(i + 1, cost + 2, audit + "D", said, lines, left)
        if fault[i] in ("blank", "duplicate"):
            return
        extra = 5 if fault[i] else 0
        go(i + 1, cost + extra, audit + "K", said + role[:1], [*lines, f"{role}:{text}"], left)
        for r in ("user", "assistant"):
            go(i + 1, cost + 1 + extra, audit + "R", said + r[0], [*lines, f"{r}:{text}"], left)

    go(0, 0, "", "", [], most_insertions)
    return min(found)


def brute(rows):
    """Every column of the query, for conversations of a few turns."""
    after, out = damage(rows), []
    for conv in dict.fromkeys(r[0] for r in rows):
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
        turns = sorted((r for r in after if r[0] == conv), key=key)
        fault, numbers = faults(turns), [t[1] for t in turns if t[1] is not None]
        cost, audit, lines = every_edit(turns, fault)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def query(spark, tmp_path, rows, schema=SCHEMA, extra=()):
    df = spark.createDataFrame(rows, schema)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    df.write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return conversations.op11_conversation_repair(spark, str(tmp_path))


def drawn(seed, conversations_, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \n", "", "Go on!  ", "ça va. x"]
    rows = []
    for c in range(conversations_):
        for t in range(rng.randint(0, turns)):
            rows.append((c, t + (t > 2), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(texts)))
    return rows


def test_query_equals_enumeration(spark, tmp_path):
    rows = drawn(1, 120, 5)
    assert sorted(map(tuple, query(spark, tmp_path, rows).collect()), key=repr) == brute(rows)


def test_nulls_ties_repeats_clashing_columns(spark, tmp_path):
    rows = [(None, 1, "user", "A."), (None, 2, "assistant", None), (1, None, None, "B."), (1, 2, "user", "B."), (1, 2, "user", "B."), (1, 2, "assistant", "C."), (2, None, "user", None)]
    rows += [(3, 1, "user", "Same."), (3, 1, "assistant", "Same."), (3, 2, "user", "x" * 300_000 + "."), (3, 3, "assistant", "Long? " * 50_000)]
    got = query(spark, tmp_path, rows, extra=("pos", "audit", "digest", "repaired_sha256"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_all_rows_dropped_and_empty_table(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    [row] = query(spark, tmp_path, [(gone, 0, "user", "A.")]).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert query(spark, tmp_path, []).count() == 0


def viterbi(codes):
    """(cost, audit) over codes, by a search in order of (cost, audit)."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes) and state in ("", "a"):
            return cost, audit
        follow = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, follow))
        if i < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if codes[i] >= 0:
                kind, extra = "suao"[codes[i] % 4], 5 * (codes[i] >= 4)
                if kind == "s" and not state:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, "s"))
                heapq.heappush(heap, (cost + extra + (kind != follow), audit + ("K" if kind == follow else "R"), i + 1, follow))
    raise AssertionError


def test_conversation_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["system", "user", "assistant", "assistant"]), rng.choice(["A.", "B", "C!", " "]) if t % 3 else f"{t}.") for t in range(150)]
    turns = sorted(damage(rows), key=lambda r: r[1])
    codes = [-1 if f in ("blank", "duplicate") else "sua".index(r[2][0]) + 4 * (f == "truncated") for r, f in zip(turns, faults(turns))]
    [row] = query(spark, tmp_path, rows).collect()
    assert (row["cost"], row["audit"]) == viterbi(codes)


def test_repair_gives_lines(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "One."), (1, 2, "user", "Two.")], SCHEMA)
    found, lines = conversations.repair(turns)
    assert [tuple(r) for r in found.select("cost", "audit").collect()] == [(3, "DKR")]
    assert all(GRAMMAR.fullmatch("".join(x[0] for r in rows for x in r["lines"])) for rows in [lines.orderBy("pos").collect()])
    assert staged(found, "t").count() == 1


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r for r in conversations.op11_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted((x for x in damage(rows) if x[0] == c), key=lambda x: x[1])
        codes = [-1 if f in ("blank", "duplicate") else "sua".index(x[2][0]) + 4 * (f == "truncated") for x, f in zip(turns, faults(turns))]
        assert (r["cost"], r["audit"]) == viterbi(codes)
