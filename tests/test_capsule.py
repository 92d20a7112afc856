"""A run from a CSV file to its archive, twice."""

import json
import os
import random
import zipfile

import pytest

from capstan.operators import panel, quality
from capstan.plans import capsule


def rows(n=4000):
    r = random.Random(8)
    yield "id,year,now,last,mh,sr,sw,count,sex,age"
    for i in range(n):
        flags = [r.random() < 0.4 for _ in range(3)]
        yield ",".join(map(str, [r.randint(1, 500), r.choice([2023, 2024, 2025]), r.choice("NESW"), r.choice("NESW"), *map(int, flags), r.randint(1, 4), r.choice(["Male", "Female"]), r.choice(["18 to 24", "25 to 49", "50+"])]))


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("capsule")
    (base / "data.csv").write_text("\n".join(rows()) + "\n")
    names = {"subject": "id", "period": "year", "place_now": "now", "place_last": "last", "flag_1": "mh", "flag_2": "sr", "flag_3": "sw", "n": "count", "gender": "sex", "age": "age", "y": "sr", "d": "mh"}
    casts = {"period": "int", "n": "int", "flag_1": "boolean", "flag_2": "boolean", "flag_3": "boolean", "y": "int", "d": "int"}
    expected = quality.Expected(("id", "year", "count"), {"sex": ["Male", "Female"], "now": ["N", "E", "S"]}, 1, 10_000)
    config = capsule.Config(
        "made", str(base / "data.csv"), str(base / "tables"), str(base / "results"), expected, names, casts, panel.Panel(carried=("gender", "age"), tie_break=("flag_1", "flag_2", "flag_3", "n")), ("age", "gender"),
        ("d", "y", ("gender", "age"), "subject"), {"person_year_n": (len({tuple(r.split(",")[:2]) for r in list(rows())[1:]}), 0), "D1_proportion_full": (0.9, 0.01), "no_such_fact": (1, 1)}, "A. Author", templates={"README.md": "# {{project}} by {{author}}: {{rows}} rows"},
    )
    with pytest.warns(UserWarning, match="unexpected_now"):
        return base, config, capsule.run(spark, config)


def test_every_step_is_recorded(spark, done):
    base, _, manifest = done
    results = manifest["results"]
    assert len(results) == 2 + 6 + 4 + 3 + 5 + 4 + 8 + 1  # pooled and three years, ATE and ATTE
    assert results["person_year_n"]["status"] == "PASS" and results["D1_proportion_full"]["status"] == "DIFFER" and results["no_such_fact"]["status"] == "INFO" and results["vm_full_unweighted_mean"]["status"] == "INFO"
    assert results["matched_D1_count"]["observed"] == results["matched_D0_count"]["observed"] == results["matched_sample_n"]["observed"] / 2
    assert manifest["meta"]["rows"] == 4000 and [i[0] for i in manifest["meta"]["issues"]] == ["unexpected_now"]
    assert spark.read.parquet(f"{base}/tables/matched").count() == results["matched_sample_n"]["observed"]
    assert all(abs(results[f"DML_{s}_{e}"]["observed"]) < 0.2 for s in ("pooled", 2023, 2024, 2025) for e in ("ATE", "ATTE"))  # the flags are drawn apart
    with pytest.raises(ValueError, match="1 of 33"):
        quality.audit_gate(quality.manifest_frame(spark, manifest))


def test_archive_and_files(done):
    base, _, manifest = done
    with zipfile.ZipFile(base / "results" / "bundle.zip") as z:
        assert z.namelist() == ["README.md", "SUMMARY.txt", "manifest.json"] and z.read("README.md").decode() == "# made by A. Author: 4000 rows"
        assert json.loads(z.read("manifest.json")) == json.loads(json.dumps(manifest))
    assert {"manifest.json", "SUMMARY.txt", "bundle.zip"} <= set(os.listdir(base / "results"))


def test_a_second_run_finds_the_same(spark, done):
    _, config, manifest = done
    with pytest.warns(UserWarning):
        again = capsule.run(spark, config)
    for name, r in manifest["results"].items():
        assert again["results"][name]["observed"] == pytest.approx(r["observed"], nan_ok=True), name
