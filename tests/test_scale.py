"""Steps whose cost must not grow faster than their input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.llm import decontaminate
from capstan.operators import events, panel, reports, shared
from capstan.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_a_report_field_searches_its_section_once(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(reports.incident_date(F.col("text"))).count("QIncident Narrative") == 1
    assert plan(reports.charges(F.col("text"))).count("QAnalysis and Director's Decision") == 1
    assert plan(reports.fields(F.col("text"))["date_of_incident_iso"]).count("QIncident Narrative") == 1


def test_narrow_rows_are_dealt_out_by_their_number(spark):
    assert shared.spread(spark.range(0, 1000, 1, 1), 100).rdd.getNumPartitions() == 10
    assert shared.spread(spark.range(0), 100).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["capsule_facts", "nearest_match"])
def test_the_panel_is_made_once(spark, monkeypatch, name):
    made, real = [], panel.person_period
    monkeypatch.setattr(panel, "person_period", lambda *a: made.append(1) or real(*a))
    out = catalogue.QUERIES[name](spark, DATA)
    assert len(made) == 1 and not any("lineitem" in f for f in out.inputFiles())


def test_seeds_are_compiled_code(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "x y c d e f g h i j k l m n o p q z z z")], "item_id long, text string")
    out = decontaminate.find_overlaps(docs, items)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, (size(hashes" in plan
    assert [(r["doc_id"], r["item_id"], r["agreeing"]) for r in out.collect()] == [(1, 7, 13)]


def test_densities_are_worked_out_for_many_events_at_once(monkeypatch):
    t, calls = np.sort(np.random.default_rng(1).uniform(0, 400, 300)), []
    kernel = events.custom(lambda u: calls.append(1) or np.exp(-u), lambda v: 1 - np.exp(-v))
    plain = np.array([np.exp(-(t[i] - t[:i])).sum() for i in range(300)])
    for lags in (1 << 16, 100, 1):
        monkeypatch.setattr(events, "LAGS_AT_ONCE", lags)
        assert np.allclose(events._excited(t, np.zeros(300, np.int64), kernel[0]), plain)
    calls.clear()
    monkeypatch.setattr(events, "LAGS_AT_ONCE", 1 << 16)
    events.sequence_nll(t, 400.0, events.constant(-0.5), 0.4, kernel)
    assert len(calls) == 1
