"""Operators against known values."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.functions import stats, text
from capstan.operators import causal, events, panel, quality, reports, synthetic
from capstan.sources import files, portals


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# Statistics.


def agg(spark, rows, column, kind="x double"):
    return spark.createDataFrame(rows, kind).agg(column.alias("y")).first()["y"]


def test_statistics(spark):
    x = [(float(v),) for v in (2, 4, 4, 4, 5, 5, 7, 9)]
    assert agg(spark, x, stats.core_mean("x")) == 5 and agg(spark, x, stats.core_var("x")) == pytest.approx(32 / 7)
    assert agg(spark, x, stats.core_std("x", 0)) == 2
    pairs = [(v, float((i + 1) ** 2)) for i, (v,) in enumerate(x)]
    assert agg(spark, pairs, stats.core_cor("x", "y"), "x double, y double") == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])
    assert math.isnan(agg(spark, x[:1], stats.core_var("x"))) and math.isnan(agg(spark, [], stats.core_mean("x")))
    assert math.isnan(agg(spark, [(1.0,), (None,)], stats.core_mean("x")))
    assert math.isnan(agg(spark, [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], stats.core_cor("x", "y"), "x double, y double"))


def test_weighted(spark):
    rows = [(1.0, 2.0), (3.0, 1.0), (5.0, 4.0)]
    full = np.repeat([1, 3, 5], [2, 1, 4])
    assert agg(spark, rows, stats.weighted_mean("x", "w"), "x double, w double") == pytest.approx(full.mean())
    assert agg(spark, rows, stats.weighted_var("x", "w"), "x double, w double") == pytest.approx(full.var(ddof=1))


def test_densities_and_gamma(spark):
    for v in (-1, 0, 1, 2.5):
        want = math.exp(-0.5 * ((v - 0.3) / 1.7) ** 2) / (1.7 * math.sqrt(2 * math.pi))
        assert one(spark, float(v), lambda c: stats.normal_pdf(c, 0.3, 1.7), "double") == pytest.approx(want)
        assert one(spark, float(v), lambda c: stats.normal_logpdf(c, 0.3, 1.7), "double") == pytest.approx(math.log(want))
    assert math.isnan(one(spark, 1.0, lambda c: stats.normal_pdf(c, 0, 0), "double"))
    assert stats.gamma_cdf(1, 2) == pytest.approx(1 - math.exp(-2)) and stats.gamma_cdf(3, 0) == 0
    assert stats.gamma_cdf(2, 10) == pytest.approx(1 - 11 * math.exp(-10)) and stats.gamma_cdf(2, 0.5) == pytest.approx(1 - 1.5 * math.exp(-0.5))


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("x"))
    a, b = (sorted((r["replicate"], round(r["mean"], 9)) for r in stats.bootstrap_means(df.repartition(n), "x", "id", 10, 3).collect()) for n in (1, 5))
    assert a == b and np.mean([m for _, m in a]) == pytest.approx(3, abs=0.2)


# Text.


@pytest.mark.parametrize("x, y", [("Ángela", "Angela"), ("Jürgen Straße", "Jurgen Strasse"), ("Łukasz Żak", "Lukasz Zak"), ("Œuvre Æon", "OEuvre AEon"), ("中x", "x")])
def test_fold(spark, x, y):
    assert one(spark, x, text.fold_latin) == y
    assert one(spark, x, lambda c: text.ascii_fallback(c)) == x and one(spark, x, lambda c: text.ascii_fallback(c, True)) == y


def test_to_ascii_and_null(spark):
    assert one(spark, "a\tb\né", text.to_ascii) == "abe" and one(spark, None, text.to_ascii) == "" and one(spark, None, text.ascii_fallback) is None


@pytest.mark.parametrize("x, y", [("January 5, 2023", "2023-01-05"), ("on february 31 1999 x", "1999-02-31"), ("2020-01-02", "2020-01-02"), ("junk", ""), ("Foo 3, 2020", ""), ("", "")])
def test_iso_date(spark, x, y):
    assert one(spark, x, text.to_iso_date) == y


@pytest.mark.parametrize("x", ["", "abc", "abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq"])
def test_sha256(spark, x):
    assert one(spark, x, text.sha256) == hashlib.sha256(x.encode()).hexdigest() and one(spark, None, text.sha256) is None


def test_small_text_functions(spark):
    assert one(spark, "a b&c", text.url_encode) == "a%20b%26c"
    assert one(spark, "SSL error: could not connect; timed out 403", text.download_causes) == ["tls", "dns", "timeout", "forbidden"]
    assert one(spark, "HTTP 429", text.download_causes) == ["rate_limited"]
    assert one(spark, "<b>a &amp; b</b>&nbsp; c", text.anchor_text) == "a & b c"
    assert one(spark, " a ,;: ", text.trimmed) == "a" and one(spark, "hello World", text.upper_first) == "Hello World"
    assert one(spark, "<p>a<br>b</p><script>x</p></script>&nbsp;c", text.html_to_text) == " a\nb\nc"
    assert one(spark, "xx12y3", lambda c: text.match_spans(c, r"\d+")) == [(2, 4), (5, 6)]


# Reports.

REPORT = """<html><body><h1>Report</h1><p>The Investigation</p>
<p>Notification of the SIU</p><p>On January 6, 2023, at 9 a.m., the Barrie Police Service notified the SIU of an injury in the City of
Barrie. The Barrie Police Service helped.</p><p>The Team</p>
<p>Number of SIU Investigators assigned: 3<br>Number of SIU Forensic Investigators assigned: 1</p>
<p>Subject Officials</p><p>SO #1 Interviewed</p><p>SO
#2 Declined</p><p>Witness Officials</p><p>WO #1 to WO #3 Interviewed</p>
<p>Civilian Witnesses</p><p>CW #1 and CW #2</p><p>Incident Narrative</p>
<p>On January 5, 2023, a 35-year-old man fell and was found with a fractured left arm.</p><p>Evidence</p><p>None.</p>
<p>Relevant Legislation</p><p>Section 25(1), Criminal Code - force
Section 265, Criminal Code - assault
Section 4, Mental Health Act
</p><p>Analysis and Director&rsquo;s Decision</p><p>There are no reasonable grounds. The file is closed.</p>
<p>Date: April 28, 2023</p><p>Joseph Martino<br>Director</p></body></html>"""


def test_report_fields(spark):
    r = reports.parse_reports(spark.createDataFrame([(1, REPORT)], "doc_id int, html string")).first()
    want = {
        "_language": "en", "police_service": "Barrie Police Service", "date_of_incident_iso": "2023-01-05", "date_siu_notified_iso": "2023-01-06", "date_of_director_decision_iso": "2023-04-28",
        "siu_investigators": "3", "siu_forensics_investigators": "1", "number_of_subject_officers": "2", "number_of_witness_officials": "3", "number_of_civilian_witnesses": "2",
        "age_affected": "35", "sex_gender_affected": "man", "charges_recommended": "FALSE", "directors_name": "Joseph Martino", "location_of_call": "City of Barrie",
        "relevant_legislation": "Criminal Code; Mental Health Act",
    }
    assert {k: r[k] for k in want} == want and "fractured left arm" in r["specific_injuries"]


def test_catalogue(spark):
    c = {r["name"]: r["is_count"] for r in reports.catalogue(spark).collect()}
    assert len(c) == 16 and sum(c.values()) == 5 and c["number_of_subject_officers"] and not c["directors_name"]


NOTE = "A witness officer is a police officer who, in the {} is involved in the incident but is not a subject officer in it. "


@pytest.mark.parametrize("body, n", [
    ("Subject Officials\nSO #1 Interviewed\nSO #2 Declined\nSO #3 Interviewed\n", 3),
    ("The SO was interviewed. A witness was not a subject official.", 1),
    ("No subject official was designated.", 0),
    ("Nothing here.", None),
    (NOTE.format("opinion of the SIU Director,") + "The SO was there.", 1),
    (NOTE.format("SIU Director’s opinion,") + "The SO was there.", 1),
    ("It was also 59 seconds. The SO ran.", 1),
    ("Then SO #7 came. The SO ran.", 1),
    ("SO #1 and SO #2 ran.", 2),
    ("Subject Officers\nSO #1 Interviewed\nSO #1 Declined interview\nWitness Officers\nWO #1\n", 2),
    ("Subject Officials\nSO #1 Interviewed\nSO #2 Interviewed\n", 2),
    ("The two subject officials ran.", 2),
    ("This information may include the SO of affected person. No subject officers were named.", 0),
])
def test_subject_officials(spark, body, n):
    r = one(spark, body, reports.subject_officials)
    assert r["count"] == n and r["reason"]


# Quality.


def capsule(folder, **changes):
    body = "id,year,value\n" + "".join(f"{i},{2024 + (i - 1) % 2},{i / 2}\n" for i in range(1, 7)) + changes.get("more", "")
    clean = "id,year,value\n" + "".join(f"{i},{2024 + (i - 1) % 2},{i / 2}\n" for i in range(1, 7))
    (folder / "data.csv").write_text(body)
    (folder / "data_provenance.json").write_text(json.dumps({
        "dataset": {"package_slug": "test-capsule", "publisher": "Test Publisher"},
        "resource": {"filename": "data.csv", "sha256": hashlib.sha256(clean.encode()).hexdigest(), "size_bytes": len(clean), "row_count_data_rows": 6},
        "schema": {"expected_columns": ["id", "year", "value"] + changes.get("columns", []), "structural_invariants": {"min_data_rows": 3}},
    }))
    m = quality.make_manifest({})
    quality.add_check(m, "mean", 1.75, 1.75)
    quality.add_check(m, "far", 1, 2)
    m["results"]["mean"]["status"] = changes.get("status", "PASS")
    files.write_manifest(m, str(folder / "manifest.json"))
    return str(folder)


def test_verify_capsule(spark, tmp_path):
    def ok(folder):
        return {r["check"]: r["ok"] for r in quality.verify_capsule(spark, folder, manifest_file="manifest.json").collect()}

    whole = ok(capsule(tmp_path))
    assert all(whole.values()) and list(whole) == ["provenance_readable", "data_present", "data_sha256", "data_size_bytes", "data_readable", "data_row_count", "schema_valid", "manifest_consistent"]
    bad = ok(capsule(tmp_path, more="7,2026,9.9\n"))
    assert not bad["data_sha256"] and not bad["data_row_count"] and bad["schema_valid"]
    assert not ok(capsule(tmp_path, status="DIFFER"))["manifest_consistent"] and not ok(capsule(tmp_path, columns=["ghost"]))["schema_valid"]
    capsule(tmp_path)
    (tmp_path / "analysis.R").write_text("x <- 1")
    stored = json.loads((tmp_path / "manifest.json").read_text())
    for pinned, want in ((hashlib.sha256(b"x <- 1").hexdigest(), True), ("0" * 64, False)):
        stored["meta"]["script_sha256"] = pinned
        files.write_manifest(stored, str(tmp_path / "manifest.json"))
        seen = {r["check"]: r["ok"] for r in quality.verify_capsule(spark, str(tmp_path), manifest_file="manifest.json", script_file="analysis.R").collect()}
        assert list(seen)[-1] == "script_sha256" and seen["script_sha256"] is want
    (tmp_path / "data.csv").unlink()
    assert ok(str(tmp_path))["data_present"] is False
    assert quality.all_ok(quality.verify_capsule(spark, str(tmp_path / "none"))).first()["ok"] is False


def test_validation(spark):
    df = spark.createDataFrame([(1, 2020.0), (2, None), (3, 2030.0)], "id int, year double")
    issues = {r["issue"]: r["message"] for r in quality.validate_schema(df, quality.Expected(("id", "value"), {"year": [2020.0, 2021.0]}, 5)).collect()}
    assert issues == {"missing_columns": "Missing required columns: value", "row_count_low": "Row count 3 below expected minimum 5", "unexpected_year": "Column 'year' has unexpected values: 2030.0, NA"}
    assert sorted(map(tuple, quality.unexpected_values(df, "year", [2020.0]).collect())) == [("2030.0", 1), ("NA", 1)]
    assert quality.validate_schema(df, quality.Expected.of(None)).count() == 0
    with pytest.raises(ValueError, match="Missing required columns"):
        quality.apply_schema_validation(df, quality.Expected(("ghost",)))
    with pytest.warns(UserWarning, match="below expected minimum"):
        assert not quality.apply_schema_validation(df, quality.Expected(("id",), {}, 5))
    assert quality.apply_schema_validation(df, quality.Expected(("id",)))


def test_record(spark):
    rows = [("a", "1.00004", "1", 1e-4, False, 1), ("b", "100", "250", 1e-4, False, 1), ("c", "5", "99", 1e-4, True, 1), ("d", "b01", "b01", 1e-4, False, 1), ("b", "1", "1", 1e-4, False, 2)]
    df = spark.createDataFrame(rows, "name string, observed string, expected string, tol double, synthetic boolean, at int")
    m = quality.record(df, "at")
    assert {r["name"]: r["status"] for r in m.collect()} == {"a": "PASS", "b": "PASS", "c": "INFO", "d": "INFO"}
    assert tuple(quality.summarise(m).first()) == (4, 2, 0, 0, 2)
    quality.audit_gate(m)
    with pytest.raises(ValueError):
        quality.audit_gate(quality.record(df.limit(2)))
    odd = spark.createDataFrame([("a", "NaN", "1", None), ("b", "Infinity", "1", None), ("c", "1", "NaN", None), ("d", "1", "1", "WARN"), ("e", "Infinity", "Infinity", None)], "name string, observed string, expected string, force_status string")
    odd = odd.withColumn("tol", F.lit(1e-4)).withColumn("synthetic", F.lit(False))
    assert {r["name"]: r["status"] for r in quality.record(odd, warn_not_finite=True).collect()} == {"a": "WARN", "b": "DIFFER", "c": "INFO", "d": "WARN", "e": "WARN"}
    assert {r["name"]: r["status"] for r in quality.record(odd).collect()} == {"a": "INFO", "b": "DIFFER", "c": "INFO", "d": "WARN", "e": "INFO"}
    held = quality.make_manifest({})
    for name, o, more in (("a", float("nan"), {"warn_not_finite": True}), ("b", 1, {"force_status": "WARN"}), ("c", float("nan"), {}), ("d", float("inf"), {"warn_not_finite": True})):
        quality.add_check(held, name, o, 1, **more)
    assert [c["status"] for c in held["results"].values()] == ["WARN", "WARN", "INFO", "DIFFER"]
    assert quality.version_drift({"a": "1", "b": "2"}, {"a": "1"}) == [{"package": "b", "pinned": "2", "used": "NA"}]


# Synthetic tables.


def test_synthetic_types(spark):
    def values(spec, n=200):
        return [r["c"] for r in synthetic.make_table(spark, {"columns": {"c": spec}}, rows=n, seed=1).collect()]

    assert set(values({"values": ["a", "b"]}, 50)) == {"a", "b"} and set(values({"type": "bernoulli", "p": 1}, 20)) == {"Yes"}
    assert min(values({"type": "poisson", "lambda": 2, "min": 1})) == 1 and sorted(values({"type": "sequence", "from": 5}, 3)) == [5, 6, 7]
    assert sorted(values({"type": "id_pattern", "pattern": "case-{seq:05d}"}, 3)) == ["case-00001", "case-00002", "case-00003"]
    with pytest.raises(ValueError):
        values({"type": "odd"})


def test_synthetic_is_repeatable_and_replicates(spark):
    recipe = {"columns": {"fy": {"values": [2024, 2025]}, "id": {"type": "id_pattern", "pattern": "{year}-{seq:05d}", "year_col": "fy"}, "alert": {"type": "bernoulli", "p_with_baserate": 0.3}}}
    first = sorted(map(tuple, synthetic.make_table(spark, recipe, rows=25, seed=42).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = synthetic.make_table(spark, recipe, rows=25, seed=42)
    assert sorted(map(tuple, again.repartition(3).collect())) == first and again.columns == ["fy", "id", "alert"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    twice = synthetic.make_table(spark, recipe | {"row_replication": {"values": [2], "weights": [1]}}, rows=10, seed=42).collect()
    assert len(twice) == 20 and len({r["id"] for r in twice}) == 20
    with pytest.raises(ValueError):
        synthetic.make_table(spark, {"columns": {"id": {"type": "id_pattern", "pattern": "{seq:05d}"}}, "row_replication": {"values": [2]}}, rows=2)


def test_synthetic_csv(spark, tmp_path):
    recipe = {"seed": 42, "n_rows": 25, "columns": {"fy": {"type": "sample", "values": [2024, 2025]}, "id": {"type": "id_pattern", "pattern": "{year}-{seq:05d}", "year_col": "fy"}, "alert": {"type": "bernoulli", "p": 0.4, "labels": ["Yes", "No"]}}}
    digests = []
    for name in ("a", "b"):
        info = synthetic.make_csv(spark, recipe, str(tmp_path / name))
        assert info == {"path": str(tmp_path / name), "rows": 25, "seed": 42}
        digests.append(files.file_digests(spark, str(tmp_path / name / "*.csv")).first()["sha256"])
    assert digests[0] == digests[1]
    people = {"seed": 7, "n_rows": 10, "row_replication": {"values": [2], "weights": [1]}, "columns": {"region": {"type": "sample", "values": ["East", "West"]}}}
    assert synthetic.make_csv(spark, people, str(tmp_path / "c"), one_file=False)["rows"] == 20
    ids = synthetic.make_table(spark, {"columns": {"id": {"type": "id_pattern"}}}, rows=2).collect()
    assert sorted(r["id"] for r in ids) == ["id-00001", "id-00002"]


def test_numbers_in_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3 == 0).alias("k"))
    seen = {}
    for r in synthetic.number_within(df, "k", "place", "n", block=64).orderBy("n").collect():
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["place"] == seen[r["k"]]
    for blocks in (1, 7):
        got = {}
        for r in causal.numbered_by(df, ["k"], ["n"], "place", blocks).orderBy("n").collect():
            got.setdefault(r["k"], []).append(r["place"])
        assert got == {k: list(range(1, n + 1)) for k, n in seen.items()}  # by order, however many blocks


# Events.


def test_likelihoods_agree(spark):
    r = np.random.default_rng(4)
    times = np.sort(r.uniform(0, 50, 40)).tolist()
    df = spark.createDataFrame([(1, times)], "k int, times array<double>")
    base = events.constant(-0.5)
    fold = df.select(events.exponential_nll(F.col("times"), 50.0, -0.5, 0.4, 0.9).alias("y"), events.exponentials_nll(F.col("times"), 50.0, math.exp(-0.5), 0.4, [0.9], [0.9]).alias("z")).first()
    udf = df.select(events.nll(F.col("times"), 50.0, base, 0.4, events.exponential(0.9)).alias("y")).first()["y"]
    assert fold["y"] == pytest.approx(udf) == fold["z"]
    t = np.array(times)

    def slow(density, integral):
        return math.exp(-0.5) * 50 + sum(0.4 * integral(50 - x) for x in t) - sum(math.log(math.exp(-0.5) + 0.4 * sum(density(x - y) for y in t[:i])) for i, x in enumerate(t))

    kernels = {
        events.weibull(1.5, 2.0): (lambda u: 0.75 * (u / 2) ** 0.5 * math.exp(-((u / 2) ** 1.5)), lambda u: 1 - math.exp(-((u / 2) ** 1.5))),
        events.lomax(2.5, 1.0): (lambda u: 1.5 / (u + 1) ** 2.5, lambda u: 1 - (1 / (u + 1)) ** 1.5),
        events.gamma(2.0, 1.0): (lambda u: u * math.exp(-u), lambda u: 1 - (1 + u) * math.exp(-u)),
        events.poles([0.9], [0.9]): (lambda u: 0.9 * math.exp(-0.9 * u), lambda u: 1 - math.exp(-0.9 * u)),
    }
    for k, (g, big) in kernels.items():
        assert events.sequence_nll(t, 50.0, base, 0.4, k) == pytest.approx(slow(g, big))
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(times)], "k int, e int, t double")
    joined = events.weibull_nll_by_join(rows, "k", "t", "e", 50.0, -0.5, 0.4, 1.5, 2.0).first()["nll"]
    assert joined == pytest.approx(events.sequence_nll(t, 50.0, base, 0.4, events.weibull(1.5, 2.0)))
    flat = events.sequence_nll(t, 50.0, events.sinusoidal(-0.5, 0, 0, 0), 0.4, events.gamma(2.0, 1.0))
    assert flat == pytest.approx(events.sequence_nll(t, 50.0, base, 0.4, events.gamma(2.0, 1.0)))
    assert events.sequence_nll(t, 50.0, base, 1.5, events.gamma(2.0, 1.0)) == events.INFEASIBLE


# Matching and models.


def test_match_plan_and_nearest(spark):
    assert causal.plan_matches([(0.1, 2, 1), (0.5, 1, 3)]) == [(1, 1, 1), (0, 0, 1), (0, 1, 1)]
    rows = [(i, "a" if i % 4 else "b", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, treat int")
    m = causal.nearest_match(df, "treat", ["g"], ["id"]).collect()
    assert len(m) == 40 and len({r["id"] for r in m}) == 40 and len({(r["pair"], r["treat"]) for r in m}) == 40


def test_double_ml_finds_the_effect(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        x, z = int(r.integers(0, 3)), int(r.integers(0, 2))
        d = int(r.random() < 0.2 + 0.2 * x)
        rows.append((i, str(x), str(z), d, float(0.5 * d + x + 0.3 * z + r.choice([-0.1, 0.1]))))
    e = causal.double_ml(spark.createDataFrame(rows, "id int, x string, z string, d int, y double"), "d", "y", ["x", "z"], "id")
    assert e.ate == pytest.approx(0.5, abs=0.02) and e.atte == pytest.approx(0.5, abs=0.02) and e.n == 6000


def test_negative_binomial_mixed(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(4000):
        g, d = int(r.integers(0, 8)), int(r.integers(0, 2))
        mu = math.exp(0.2 + 0.6 * d + 0.3 * ((g % 3) - 1))
        rows.append((f"g{g}", d, int(r.poisson(r.gamma(2.0, mu / 2.0)))))
    m = causal.negative_binomial_mixed(spark.createDataFrame(rows, "g string, d int, y int"), "y", "d", [], "g")
    row = m.table()[1]
    assert row[0] == "d" and row[5] == pytest.approx(math.exp(m.estimate[1])) and row[3] == pytest.approx(row[1] / row[2]) and row[4] < 1e-6
    assert m.estimate[1] == pytest.approx(0.6, abs=0.1) and 0 < m.std_error[1] < 0.1 and m.dispersion == pytest.approx(2, abs=0.6)


# Sources and sinks.

SHOW = json.dumps({"success": True, "result": {"resources": [{"name": "Other", "url": "u0"}, {"name": "Data 2014", "url": "u1"}, {"name": "data 2014 b", "url": "u2"}]}})
FOUND = json.dumps({"result": {"results": [{"resources": [{"name": "2014", "format": "XLSX", "url": "x"}]}, {"resources": [{"name": "2014", "format": "csv", "url": "c"}]}]}})


def test_portals(spark):
    assert one(spark, SHOW, lambda c: portals.package_show_url(c, "DATA 2014")) == "u1" and one(spark, SHOW, lambda c: portals.package_show_url(c, "2099")) is None
    assert one(spark, SHOW.replace("true", "false"), lambda c: portals.package_show_url(c, "2014")) is None
    assert one(spark, FOUND, lambda c: portals.package_search_url(c, "2014", "CSV")) == "c" and one(spark, FOUND, lambda c: portals.package_search_url(c, "2014")) == "x"
    assert one(spark, "https://p.org/api/3/action/package_show?id=x", lambda c: portals.search_address(c, F.lit("library stats"), F.lit(None))) == "https://p.org/api/3/action/package_search?q=library%20stats"
    assert one(spark, "", lambda c: portals.search_address(c, F.lit("x"), F.lit("y"))) is None
    closest = {"archived_snapshots": {"closest": {"available": True, "url": "http://web.archive.org/x"}}}
    assert one(spark, json.dumps(closest), portals.snapshot_url) == "https://web.archive.org/x" and one(spark, '{"archived_snapshots": {}}', portals.snapshot_url) is None
    assert one(spark, '{"id": "a"}', lambda c: portals.socrata_url(c, F.lit("h"), F.lit("d"))).startswith("https://h/api/views/d/") and one(spark, "{}", lambda c: portals.socrata_url(c, F.lit("h"), F.lit("d"))) is None
    assert one(spark, '{"name": "a"}', lambda c: portals.arcgis_url(c, F.lit("http://l//"))).startswith("http://l/query?") and one(spark, '{"name": "a", "error": 1}', lambda c: portals.arcgis_url(c, F.lit("l"))) is None
    assert one(spark, "648", portals.report_address).endswith("/en/directors_report_details.php?drid=648") and one(spark, "0", portals.report_address) is None


def test_fetch(tmp_path, spark):
    def get(url, timeout):
        if url.startswith("live"):
            raise OSError("HTTP 429")
        if "available" in url:
            return json.dumps({"archived_snapshots": {"closest": {"available": True, "url": "http://old"}}}).encode()
        return b"body"

    target = str(tmp_path / "f")
    assert portals.fetch("ok", target, get=get) == "live" and portals.fetch("live", target, "old", get=get) == "wayback"
    with pytest.raises(OSError):
        portals.fetch("live", target + "2", get=get)
    assert not (tmp_path / "f2").exists() and portals.friendly_download("live", target, get=get, say=lambda m: None) and not portals.friendly_download("live", target, "", get=get, say=lambda m: None)
    assert portals.lookup_snapshot("x", get=get) == "https://old"
    replies = {"show": SHOW.encode()}
    assert portals.resolve(spark, {"dataset": {"ckan_api_endpoint": "show"}, "resource": {"name_match_pattern": "2014", "direct_url": "d"}}, get=lambda u, t: replies[u]) == "u1"
    assert portals.resolve(spark, {"resource": {"direct_url": "d"}}, get=get) == "d"


def test_link_catalogue(spark):
    pages = spark.createDataFrame([(1, '<h2>Beds</h2><p><a href="/files/a.xlsx">Download</a> <a href="/files/b.csv">B &amp; b</a>'), (2, '<a href="/files/b.csv">again</a><a href="/c.zip"></a>')], "page int, html string")
    got = {r["url"]: (r["title"], r["format"], r["page"]) for r in portals.link_catalogue(pages, "page", "page").collect()}
    assert got == {"/files/a.xlsx": ("Beds", "xlsx", 1), "/files/b.csv": ("B & b", "csv", 1), "/c.zip": ("(untitled)", "zip", 2)}
    page = '<h2>Topic</h2><a href="/doc/files/a.csv">First</a> <a href="/doc/files/b.XLSX">Download</a><a href="/other/c.csv">C</a><h3>Old</h3>' + "x" * 1300 + '<a href="/doc/files/d.zip">download</a>'
    rows = [(0, page), (1, None), (2, page), (3, '<a href="/doc/files/late.csv">Late</a>')]
    listing = spark.createDataFrame(rows, "page int, html string")
    got = {r["url"]: r["title"] for r in portals.link_catalogue(listing, "page", "page", link=portals.FILE_LINK, until_dry=True).collect()}
    assert got == {"/doc/files/a.csv": "First", "/doc/files/b.XLSX": "Topic", "/doc/files/d.zip": "download"}
    assert portals.link_catalogue(listing, "page", "page", link=portals.FILE_LINK).count() == 4


def test_snapshots_and_reports_by_number(spark):
    def get(url, timeout):
        if "drid=7" in url or "gone" in url:
            raise OSError("HTTP 404")
        if "available" in url:
            return b'{"archived_snapshots": {"closest": {"available": true, "url": "http://old"}}}'
        return REPORT.encode()

    links = spark.createDataFrame([("https://x/a.csv",), ("https://x/gone.csv",), (None,)], "url string")
    assert {r["url"]: r["wayback_url"] for r in portals.with_snapshots(links, get=get).collect()} == {"https://x/a.csv": "https://old", "https://x/gone.csv": None, None: None}
    said = []
    assert portals.fetch_and_parse_report(spark, 648, get=get)["police_service"] == "Barrie Police Service"
    assert portals.fetch_and_parse_report(spark, 7, get=get, say=said.append) is None and portals.fetch_and_parse_report(spark, -1, get=get, say=said.append) is None
    assert len(said) == 2 and all("could not fetch" in m for m in said)


def test_files(spark, tmp_path):
    m = quality.make_manifest({"project": "p"}, quality.capture_environment(spark, ["pyspark", "ghost"]))
    quality.add_check(m, "x", 1.00004, 1)
    text_of = open(files.write_summary(m, str(tmp_path), {"output": str(tmp_path)}, "all", "me", "free")).read()
    assert "Total checks: 1" in text_of and "PASS:         1" in text_of and m["environment"]["packages"]["ghost"] == "NA"
    assert files.render("a {{x}} b", {"x": "1"}) == "a 1 b" and files.first_present([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    files.write_csv(spark.createDataFrame([(1, "a,b")], "i int, s string"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), "i int, s string").collect() == [(1, "a,b")]
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.file_digests(spark, str(tmp_path / "x.bin")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert files.html_of("<p>") == "<p>" and files.load_provenance(str(tmp_path / "none")) is None


def test_citation(spark):
    p = spark.createDataFrame([(("2026-02-03T00:00:00Z", ("test-capsule", "Test Publisher", None, "OGL"), ("Data", "https://x")),)], "p struct<captured_at_utc:string,dataset:struct<package_slug:string,publisher:string,doi:string,licence_short:string>,resource:struct<name:string,direct_url:string>>")
    c = p.select(files.citation(F.col("p")).alias("c")).first()["c"]
    assert c["text"] == "Test Publisher (2026). Data [Data set]. https://x Retrieved 2026-02-03. Licence: OGL." and c["bibtex"].startswith("@misc{testcapsule2026,")


def test_panel_pieces(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 1)], "id int, n int")
    assert sorted(r["id"] for r in panel.expand_by_count(df, "n").collect()) == [1, 1, 4]
    assert panel.complete_cases(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), ["x"]).count() == 1
