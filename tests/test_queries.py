"""Every query against its SQL on the driver's tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from capstan.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 4) + 0.0
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert ours == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_effects_cover_every_ship_year(spark, duck):
    years = [str(y) for (y,) in duck.execute("SELECT DISTINCT year(l_shipdate) AS y FROM lineitem WHERE l_shipdate IS NOT NULL ORDER BY y").fetchall()]
    rows = catalogue.QUERIES["effect_estimates"](spark, DATA).collect()
    assert [(r["scope"], r["estimand"]) for r in rows] == [(s, k) for s in ("pooled", *years) for k in ("ATE", "ATTE")]
    assert all(math.isfinite(r["effect"]) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
