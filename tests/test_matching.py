"""Matching on a continuous score against a plain greedy."""

import random

import pytest
from pyspark.sql import functions as F

from capstan.operators import matching


def greedy(rows):
    """(treated id, control id) of (id, treat, score) rows."""
    order = sorted(rows, key=lambda r: (-r[2], -r[1], r[0]))
    place = {r[0]: k for k, r in enumerate(order)}
    left = [r for r in order if not r[1]]
    out = []
    for k, d, s in order:
        if d and left:
            # nearest; from below first; of equal scores the next in the order
            best = min(left, key=lambda c: (abs(c[2] - s), c[2] > s, abs(place[c[0]] - place[k])))
            left.remove(best)
            out.append((k, best[0]))
    return sorted(out)


def drawn(seed, n, share, spread):
    r = random.Random(seed)
    return [(k, int(r.random() < share), spread(r)) for k in range(n)]


CASES = {
    "few treated": drawn(1, 2000, 0.2, lambda r: r.random()),
    "as many": drawn(2, 2000, 0.5, lambda r: r.gauss(0, 1)),
    "more treated": drawn(3, 1200, 0.7, lambda r: r.random()),
    "treated above": [(k, int(s > 0.6), s) for k, _, s in drawn(4, 900, 0, lambda r: r.random())],
    "treated below": [(k, int(s < 0.4), s) for k, _, s in drawn(5, 900, 0, lambda r: r.random())],
    "ties": drawn(6, 1500, 0.4, lambda r: float(r.randint(0, 6))),
    "one score": drawn(7, 400, 0.4, lambda r: 0.5),
    "far apart": [(k, int(k % 3 == 0), round(s, 1) * (100 if k % 2 else 1)) for k, _, s in drawn(8, 900, 0, lambda r: r.random())],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [200, 100_000])
def test_matching_equals_a_plain_greedy(spark, name, size):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "id long, d int, s double").repartition(5)
    got = matching.nearest_by_score(df, "d", "s", ["id"], size).collect()
    by = {}
    for r in got:
        by.setdefault(r["pair"], [None, None])[1 - r["d"]] = r["id"]
    assert sorted(map(tuple, by.values())) == greedy(rows)


def test_nulls_clashing_columns_and_nothing(spark):
    rows = [(1, 1, 0.5), (2, 0, None), (3, None, 0.5), (4, 0, float("nan")), (5, 0, 0.9), (6, 1, 0.1)]
    df = spark.createDataFrame(rows, "place long, treated int, score double").withColumns({c: F.lit("x") for c in ("range", "row", "control", "key", "at")})
    got = matching.nearest_by_score(df, "treated", "score", ["place"]).collect()
    assert sorted(r["place"] for r in got) == [1, 5] and {r["row"] for r in got} == {"x"}
    assert matching.nearest_by_score(df.limit(0), "treated", "score", ["place"]).count() == 0


def test_few_rounds_settle_many_ranges(spark, monkeypatch):
    """What a range is reached by counts by content: a range that is swept again and leaves the same moves no other."""
    rows = drawn(9, 6000, 0.33, lambda r: r.random())
    rounds, swept = [], matching._swept
    monkeypatch.setattr(matching, "_swept", lambda *a: rounds.append(1) or swept(*a))
    df = spark.createDataFrame(rows, "id long, d int, s double")
    got = matching.nearest_by_score(df, "d", "s", ["id"], 200).collect()
    by = {}
    for r in got:
        by.setdefault(r["pair"], [None, None])[1 - r["d"]] = r["id"]
    assert sorted(map(tuple, by.values())) == greedy(rows)
    assert len(rounds) < 10  # of 30 ranges


def test_ranges_do_not_grow_with_the_rows_while_they_are_small():
    assert [matching.ranges_of(n, 400) for n in (0, 400, 2000, 900_000, 4_000_000)] == [1, 1, 5, 64, 64]
    assert matching.ranges_of(1 << 24, 400) == 1 << 8 and matching.ranges_of(1 << 24, 1 << 20) == 1 << 4
