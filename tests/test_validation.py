"""Validation on the way to disk, ordered categories, renaming."""

import os
import warnings

import pytest
from pyspark.sql import functions as F

from capstan.operators import categories, models, panel, quality

EXPECTED = quality.Expected(("a", "b"), {"a": ["x", "y"], "b": [1, 2], "ghost": [1]}, 3, 5)


def frame(spark, n=6):
    return spark.createDataFrame([("x" if i % 3 else "z", i % 4 or None) for i in range(n)], "a string, b int")


def test_write_counts_what_is_outside(spark, tmp_path):
    df = frame(spark)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        w = quality.write_validated(df, EXPECTED, str(tmp_path / "t"))
    assert w.rows == 6 and w.unexpected == {"a": 2, "b": 3}
    assert [i[0] for i in w.issues] == ["row_count_high", "unexpected_a", "unexpected_b"] and len(said) == 3
    back = spark.read.parquet(w.path)
    assert back.count() == 6 and back.schema == df.schema
    assert {r["value"]: r["rows"] for r in quality.unexpected_values(back, "b", [1, 2]).collect()} == {"NA": 2, "3": 1}


def test_one_scan_and_no_set_in_one_row(spark):
    plan = quality.schema_facts(frame(spark).repartition(2), EXPECTED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "collect" not in plan
    whole = quality.validate_schema(frame(spark), EXPECTED)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Scan ExistingRDD") == 1 and "collect_set" not in whole


def test_fatal_values_leave_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(Exception, match="Column 'a' has unexpected values: z"):
        quality.write_validated(frame(spark), EXPECTED, target, fatal=("a",))
    assert not [f for f in os.listdir(target) if f.startswith("part") or f == "_SUCCESS"] if os.path.exists(target) else True
    with pytest.raises(ValueError, match="Missing required columns: b"):
        quality.write_validated(frame(spark).drop("b"), EXPECTED, target)
    assert quality.write_validated(frame(spark).filter("a = 'x'"), EXPECTED, str(tmp_path / "u"), fatal=("a",)).rows == 4


def test_validation_of_nothing(spark):
    rows = quality.validate_schema(frame(spark).limit(0), EXPECTED).collect()
    assert [r["issue"] for r in rows] == ["row_count_low"]
    assert quality.validate_schema(frame(spark), quality.Expected()).count() == 0


def test_levels_keep_their_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("q",), ("a",)], "k string")
    assert categories.levels_of(df, "k") is None
    plain = categories.with_levels(df, "k")
    assert categories.levels_of(plain, "k") == ["a", "b", "q"]
    own = categories.with_levels(df, "k", ["q", "none", "b"])
    rows = own.select("k", categories.level_index(own, "k").alias("i")).collect()
    assert {r["k"]: r["i"] for r in rows} == {"q": 1, "b": 3, None: None}
    some = categories.drop_unused(own.filter("k = 'b'"), "k")
    assert categories.levels_of(some, "k") == ["b"] and some.select(categories.level_index(some, "k")).first()[0] == 1
    assert [tuple(r) for r in categories.counts(own, "k").orderBy("index").collect()] == [("q", 1, 1), ("none", 2, 0), ("b", 3, 1)]
    assert models.design(own.filter("k is not null"), ["k"]).names == ("intercept", "k=none", "k=b")
    with pytest.raises(ValueError):
        categories.with_levels(df, "k", ["a", "a"])
    with pytest.raises(ValueError):
        categories.level_index(df, "k")


def test_columns_by_dictionary(spark):
    df = spark.createDataFrame([(1, "2", 3)], "`a.b` int, c string, d int")
    got = panel.selected(df, {"z": "c", "y": "a.b"}, {"z": "int"})
    assert got.columns == ["z", "y"] and tuple(got.first()) == (2, 1)
    with pytest.raises(ValueError, match="x1, x2"):
        panel.selected(df, {"z": "x1", "y": "x2"})
