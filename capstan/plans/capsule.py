"""A whole run: read, validate, build the panel, match, estimate, compare with what was published, write a manifest, a summary and an archive.

Tables go to ``Config.tables`` by Spark; the manifest, the summary and the archive are small files that the driver writes to
``Config.results``. Nothing is compared that has no reference: such facts are recorded as INFO.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import causal, panel, quality
from ..operators.shared import kept
from ..sources import bundle, files

FACTS = "grp string, name string, observed double"
#: Names of the summaries of a sample, by their columns in ``panel.descriptives``.
_FULL = {
    "descriptive_full": {"vm_full_unweighted_mean": "mean", "vm_full_unweighted_sd": "sd", "vm_full_unweighted_max": "max", "vm_full_np_weighted_mean": "w_mean", "vm_full_np_weighted_sd": "w_sd", "D1_proportion_full": "treated_share"},
    "bivariate_full": {"vm_full_unweighted_D1_mean": "mean_1", "vm_full_unweighted_D0_mean": "mean_0", "vm_full_npweighted_D1_mean": "w_mean_1", "vm_full_npweighted_D0_mean": "w_mean_0"},
}
_MATCHED = {
    "descriptive_matched": {"vm_matched_unweighted_mean": "mean", "vm_matched_unweighted_sd": "sd", "vm_matched_unweighted_max": "max", "vm_matched_npweighted_mean": "w_mean", "vm_matched_npweighted_sd": "w_sd"},
    "bivariate_matched": {"vm_matched_unweighted_D1_mean": "mean_1", "vm_matched_unweighted_D0_mean": "mean_0", "vm_matched_npweighted_D1_mean": "w_mean_1", "vm_matched_npweighted_D0_mean": "w_mean_0"},
}


@dataclass(frozen=True)
class Config:
    """What a run needs: names, where the data are and go, their pinned schema, how columns are called, and the published values."""

    name: str
    data: str
    tables: str
    results: str
    expected: quality.Expected = quality.Expected()
    columns: dict[str, str] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)
    panel: panel.Panel = panel.Panel()
    match_on: tuple[str, ...] = ()
    #: Treatment, outcome, covariates and cluster of the effects over rows; none are estimated without.
    effects: tuple[str, str, tuple[str, ...], str] | None = None
    references: dict[str, tuple[float, float]] = field(default_factory=dict)
    author: str = "(unknown)"
    synthetic: bool = False
    templates: dict[str, str] = field(default_factory=dict)


def _long(one: DataFrame, groups: dict[str, dict[str, str]]) -> DataFrame:
    entries = [F.struct(F.lit(g).alias("grp"), F.lit(n).alias("name"), F.col(c).cast("double").alias("observed")) for g, names in groups.items() for n, c in names.items()]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def facts_of(persons: DataFrame, matched: DataFrame | None) -> DataFrame:
    """grp, name, observed: counts and summaries of the panel and of its matched sample, from one aggregate each."""
    full = panel.descriptives(persons)
    out = _long(full, {"structural": {"person_year_n": "n", "total_placements_sum": "total"}} | _FULL)
    if matched is None:
        return out
    counts = matched.agg(F.count("*").alias("n"), F.count_if(F.col("treat") == 1).alias("d1"), F.count_if(F.col("treat") == 0).alias("d0"))
    out = out.unionByName(_long(counts, {"matched": {"matched_sample_n": "n", "matched_D1_count": "d1", "matched_D0_count": "d0"}}))
    return out.unionByName(_long(panel.descriptives(matched), _MATCHED))


def effect_facts(effects: DataFrame) -> DataFrame:
    """The rows of ``causal.effects_table`` as facts."""
    return effects.select(F.lit("DML").alias("grp"), F.concat_ws("_", F.lit("DML"), "scope", "estimand").alias("name"), F.col("effect").alias("observed"))


def checked(facts: DataFrame, references: dict[str, tuple[float, float]], synthetic: bool = False) -> DataFrame:
    """``facts`` against their references (value and tolerance by name), as ``quality.record`` gives them. Facts without one are INFO."""
    spark = facts.sparkSession
    known = spark.createDataFrame([(k, float(v), float(tol)) for k, (v, tol) in references.items()] or [(None, None, None)], "name string, expected double, tol double").filter("name is not null")
    both = facts.join(F.broadcast(known), "name", "full").withColumn("tol", F.coalesce("tol", F.lit(quality.TOLERANCE)))  # as many as there are checks
    return quality.record(both.withColumn("synthetic", F.lit(synthetic)), warn_not_finite=True)


def run(spark: SparkSession, config: Config) -> dict:
    """The manifest of the run. Raises where the data lack a column; checks that differ do not stop it (see ``quality.audit_gate``)."""
    os.makedirs(config.results, exist_ok=True)
    raw = files.read_csv(spark, config.data) if config.data.lower().endswith(".csv") else spark.read.parquet(config.data)
    written = quality.write_validated(raw, config.expected, f"{config.tables}/data", mode="overwrite")
    source = spark.read.parquet(written.path)
    if config.columns:
        source = panel.selected(source, config.columns, config.casts)
    p = config.panel
    persons = kept(panel.person_period(source, p), "persons")
    persons.write.mode("overwrite").parquet(f"{config.tables}/person_period")
    matched = None
    if config.match_on:
        matched = kept(causal.nearest_match(persons, "treat", list(config.match_on), [p.subject, p.period]), "matched")
        matched.write.mode("overwrite").parquet(f"{config.tables}/matched")
    facts = facts_of(persons, matched)
    if config.effects:
        treat, outcome, covariates, cluster = config.effects
        found = causal.effects_table(source, treat, outcome, list(covariates), cluster, p.period, F.col(p.count))
        found.write.mode("overwrite").parquet(f"{config.tables}/effects")
        facts = facts.unionByName(effect_facts(found))
    manifest = quality.make_manifest(
        {"project": config.name, "author": config.author, "synthetic": config.synthetic, "rows": written.rows, "issues": [list(i) for i in written.issues]}, quality.capture_environment(spark, ["pyspark", "numpy", "pyarrow"])
    )
    for r in checked(facts, config.references, config.synthetic).orderBy("grp", "name").collect():  # one row a check
        manifest["results"][r["name"]] = {"group": r["grp"] or "", "observed": r["observed"], "expected": r["expected"], "diff": r["diff"], "status": r["status"], "tol": r["tol"], "note": "synthetic data" if config.synthetic else ""}
    files.write_manifest(manifest, os.path.join(config.results, "manifest.json"))
    summary = files.write_summary(manifest, config.results, {"data": config.data, "tables": config.tables, "results": config.results})
    with open(summary, encoding="utf-8") as f:
        content = {"SUMMARY.txt": f.read(), "manifest.json": json.dumps(manifest, indent=2, ensure_ascii=False), **config.templates}
    values = {"project": config.name, "author": config.author, "rows": str(written.rows)}
    df = spark.createDataFrame(list(content.items()), "name string, template string")
    templates = F.when(F.col("name").isin("SUMMARY.txt", "manifest.json"), F.col("template")).otherwise(bundle.rendered(F.col("template"), values))
    bundle.write_bundle(df.select("name", templates.alias("content")), "file://" + os.path.abspath(os.path.join(config.results, "bundle.zip")))
    return manifest
