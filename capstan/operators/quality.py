"""Schema validation, cross-checks with tolerances, capsule verification."""

from __future__ import annotations

import hashlib
import json
import math
import os
import platform
import warnings
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-4
# Names and messages of the issues.
MISSING, LOW, HIGH, UNEXPECTED = "missing_columns", "row_count_low", "row_count_high", "unexpected_"
MISSING_TEXT, LOW_TEXT, HIGH_TEXT, UNEXPECTED_TEXT = "Missing required columns: ", "Row count %d below expected minimum {}", "Row count %d above expected maximum {}", "Column '{}' has unexpected values: "
ISSUES, CHECKS = "issue string, severity string, message string", "check string, ok boolean, detail string"


@dataclass(frozen=True)
class Expected:
    """A pinned schema: columns, allowed values (as text; a missing value is `NA`) and bounds on the row count."""

    columns: tuple[str, ...] = ()
    value_sets: dict[str, list] = field(default_factory=dict)
    least_rows: int | None = None
    most_rows: int | None = None

    @staticmethod
    def of(provenance: dict | None) -> "Expected":
        schema = (provenance or {}).get("schema") or {}
        bounds = schema.get("structural_invariants") or {}
        return Expected(tuple(schema.get("expected_columns") or ()), schema.get("expected_value_sets") or {}, bounds.get("min_data_rows"), bounds.get("max_data_rows"))


def as_value(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("NA"))


def _present(df: DataFrame, expected: Expected) -> dict[str, list]:
    return {c: v for c, v in expected.value_sets.items() if c in df.columns}


def _outside(column: str, allowed: list) -> Column:
    """The value (as text) of a column where it is outside its set, else null."""
    value = as_value(F.col(column))
    return F.when(~value.isin(*map(_text, allowed)), value)


def schema_facts(df: DataFrame, expected: Expected) -> DataFrame:
    """column, value, rows: the row count (column null), and every distinct value outside its column's set with its rows.

    One scan: rows are counted by what they have outside the sets, which is nothing for most, before the shuffle; only these counts are
    taken apart by column. The values stay distributed, however many there are.
    """
    present = _present(df, expected)
    names = [f"_odd_{i}" for i in range(len(present))]
    counted = df.select(*(_outside(c, v).alias(n) for n, (c, v) in zip(names, present.items()))).groupBy(*names).agg(F.count("*").alias("rows"))
    entry = lambda name, value: F.struct(F.lit(name).cast("string").alias("column"), value.cast("string").alias("value"))
    every = F.array(entry(None, F.lit(None)), *(entry(c, F.col(n)) for n, c in zip(names, present)))
    apart = counted.select(F.explode(F.filter(every, lambda e: e["column"].isNull() | e["value"].isNotNull())).alias("e"), "rows")
    return apart.groupBy("e.column", "e.value").agg(F.sum("rows").alias("rows"))


def validate_schema(df: DataFrame, expected: Expected) -> DataFrame:
    """issue, severity, message; no rows for a table that meets ``expected``.

    From ``schema_facts``: one scan, and values are made distinct before they meet in a message, which lists all of them. For a
    column that may hold very many use ``unexpected_values`` or ``schema_facts``, which leave them distributed.
    """
    spark = df.sparkSession
    present = _present(df, expected)
    issues = []
    missing = [c for c in expected.columns if c not in df.columns]
    if missing:
        issues.append(F.struct(F.lit(MISSING).alias("issue"), F.lit("fatal").alias("severity"), F.lit(MISSING_TEXT + ", ".join(missing)).alias("message")))

    def issue(name: str, met: Column, message: Column) -> Column:
        return F.when(met, F.struct(F.lit(name).alias("issue"), F.lit("warning").alias("severity"), message.alias("message")))

    if expected.least_rows is not None:
        issues.append(issue(LOW, F.col("n") < expected.least_rows, F.format_string(LOW_TEXT.format(expected.least_rows), "n")))
    if expected.most_rows is not None:
        issues.append(issue(HIGH, F.col("n") > expected.most_rows, F.format_string(HIGH_TEXT.format(expected.most_rows), "n")))
    for i, c in enumerate(present):
        issues.append(issue(UNEXPECTED + c, F.size(f"odd_{i}") > 0, F.concat(F.lit(UNEXPECTED_TEXT.format(c)), F.array_join(f"odd_{i}", ", "))))
    if not issues:
        return spark.createDataFrame([], ISSUES)
    odd = (F.array_sort(F.collect_list(F.when(F.col("column") == c, F.col("value")))).alias(f"odd_{i}") for i, c in enumerate(present))
    facts = schema_facts(df, expected).agg(F.coalesce(F.sum(F.when(F.col("column").isNull(), F.col("rows"))), F.lit(0)).alias("n"), *odd)
    return facts.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")


@dataclass(frozen=True)
class Written:
    """What a checked write has found: rows, and for each column with values outside its set how many rows have one."""

    path: str
    rows: int
    unexpected: dict[str, int]
    issues: list[tuple[str, str, str]]


def write_validated(df: DataFrame, expected: Expected, path: str, fatal: tuple[str, ...] = (), mode: str = "errorifexists") -> Written:
    """Write ``df`` as Parquet and validate it on the way: one scan of the data for both.

    Missing columns stop it before anything is read. Rows and values outside their sets are counted by an observation that rides on
    the write. A value outside the set of a column of ``fatal`` raises in the plan, so the write fails as a whole and leaves
    nothing. Other issues are warnings; the values themselves are left where they are, see ``unexpected_values``.
    """
    from pyspark.sql import Observation

    missing = [c for c in expected.columns if c not in df.columns]
    if missing:
        raise ValueError(MISSING_TEXT + ", ".join(missing))
    present = _present(df, expected)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(_outside(c, v)).alias(f"odd_{i}") for i, (c, v) in enumerate(present.items())))
    for c in fatal:
        if c in present:
            value = _outside(c, present[c])
            counted = counted.withColumn(c, F.when(value.isNotNull(), F.raise_error(F.concat(F.lit(UNEXPECTED_TEXT.format(c)), value)).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    counted.write.mode(mode).parquet(path)
    found = seen.get
    rows, odd = found["rows"], {c: found[f"odd_{i}"] for i, c in enumerate(present)}
    issues = []
    if expected.least_rows is not None and rows < expected.least_rows:
        issues.append((LOW, "warning", LOW_TEXT.format(expected.least_rows) % rows))
    if expected.most_rows is not None and rows > expected.most_rows:
        issues.append((HIGH, "warning", HIGH_TEXT.format(expected.most_rows) % rows))
    issues += [(UNEXPECTED + c, "warning", f"Column '{c}' has unexpected values in {n} rows") for c, n in odd.items() if n]
    for name, _, message in issues:
        warnings.warn(f"{name}: {message}", stacklevel=2)
    return Written(path, rows, {c: n for c, n in odd.items() if n}, issues)


def unexpected_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """The distinct values (as text) of a column outside its set, with their rows: value, rows."""
    odd = df.select(as_value(F.col(column)).alias("value")).filter(~F.col("value").isin(*map(_text, allowed)))
    return odd.groupBy("value").agg(F.count("*").alias("rows"))


def _text(v) -> str:
    return "NA" if v is None else str(v)


def apply_schema_validation(df: DataFrame, expected: Expected) -> bool:
    """Raise on a fatal issue, warn of others; True if there is none."""
    rows = validate_schema(df, expected).collect()  # a row for each column at most
    fatal = [r["message"] for r in rows if r["severity"] == "fatal"]
    if fatal:
        raise ValueError("; ".join(fatal))
    for r in rows:
        warnings.warn(f"{r['issue']}: {r['message']}", stacklevel=2)
    return not rows


def status_of(observed: Column, expected: Column, tolerance: Column | float = TOLERANCE, synthetic: Column | bool = False, warn_not_finite: bool = False) -> Column:
    """INFO for synthetic data or values that are no numbers, else PASS within the tolerance and DIFFER beyond. With
    ``warn_not_finite`` WARN where there is no difference because what was observed is not finite."""
    tolerance = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance
    synthetic = F.lit(synthetic) if isinstance(synthetic, bool) else synthetic
    o, e = observed.try_cast("double"), expected.try_cast("double")
    none = o.isNull() | e.isNull() | F.isnan(o - e)
    out = F.when(synthetic, "INFO")
    if warn_not_finite:
        endless = F.abs(o) == float("inf")
        out = out.when(o.isNotNull() & e.isNotNull() & F.isnan(o - e) & (F.isnan(o) | endless), "WARN")
    return out.when(none, "INFO").when(F.abs(o - e) <= tolerance, "PASS").otherwise("DIFFER")


def record(checks: DataFrame, order: str | None = None, warn_not_finite: bool = False) -> DataFrame:
    """``checks`` (name, observed, expected, tol, synthetic) with diff and status; of one name the last by ``order``.
    A column force_status, where it is not null, is the status."""
    if order:
        last = checks.groupBy("name").agg(F.max(F.col(order)).alias("_last"))
        checks = checks.join(last, "name").filter(F.col(order) == F.col("_last")).drop("_last")
    o, e = F.col("observed").try_cast("double"), F.col("expected").try_cast("double")
    number = o.isNotNull() & e.isNotNull() & ~F.isnan(o) & ~F.isnan(e)
    status = status_of(F.col("observed"), F.col("expected"), F.col("tol"), F.col("synthetic"), warn_not_finite)
    if "force_status" in checks.columns:
        status = F.coalesce("force_status", status)
    return checks.withColumn("diff", F.when(number, F.abs(o - e))).withColumn("status", status)


def summarise(manifest: DataFrame) -> DataFrame:
    """One row: total, pass, differ, warn, info; zeros where there is none."""
    return manifest.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "DIFFER", "WARN", "INFO")))


def stale(manifest: DataFrame) -> DataFrame:
    """Names whose stored status is not what the stored numbers give."""
    o, e = F.col("observed").try_cast("double"), F.col("expected").try_cast("double")
    again = F.when(F.abs(o - e) <= F.col("tol"), "PASS").otherwise("DIFFER")
    return manifest.filter(F.col("status").isin("PASS", "DIFFER") & o.isNotNull() & e.isNotNull() & (F.col("status") != again)).select("name", "status", again.alias("recomputed"))


def within_tolerance(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Both sides' ``value`` by key, with diff and ok; a key on one side alone is not ok."""
    a, b = left.select(key, F.col("value").alias("observed")), right.select(key, F.col("value").alias("expected"))
    diff = F.abs(F.col("observed") - F.col("expected"))
    return a.join(b, key, "full").withColumn("diff", diff).withColumn("ok", F.coalesce(diff <= tolerance, F.lit(False)))


def capture_environment(spark: SparkSession, packages: list[str]) -> dict:
    """Versions of what the run used; NA for packages that are absent."""
    from importlib.metadata import PackageNotFoundError, version

    def of(p: str) -> str:
        try:
            return version(p)
        except PackageNotFoundError:
            return "NA"

    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "packages": {p: of(p) for p in sorted(set(packages))}}


def version_drift(pinned: dict, used: dict) -> list[dict]:
    """Packages whose version differs from the pinned one."""
    return [{"package": p, "pinned": v, "used": used.get(p, "NA")} for p, v in sorted(pinned.items()) if used.get(p, "NA") != v]


def make_manifest(meta: dict, environment: dict | None = None) -> dict:
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"meta": {"created_utc": stamp} | meta, "results": {}} | ({"environment": environment} if environment else {})


def add_check(manifest: dict, name: str, observed, expected, tol: float = TOLERANCE, group: str = "", synthetic: bool = False, note: str = "", force_status: str | None = None, warn_not_finite: bool = False) -> dict:
    """One check on the driver, for results that are single values; the last of a name stays. See ``status_of``."""
    typed = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (observed, expected))
    diff = abs(observed - expected) if typed and observed - expected == observed - expected else None
    lost = warn_not_finite and typed and diff is None and not math.isfinite(observed)
    status = force_status or ("INFO" if synthetic else "WARN" if lost else "INFO" if diff is None else "PASS" if diff <= tol else "DIFFER")
    manifest["results"][name] = {"group": group, "observed": observed, "expected": expected, "diff": diff, "status": status, "tol": tol, "note": note or ("synthetic data" if synthetic else "")}
    return manifest


def manifest_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    def number(v) -> float | None:
        return float(v) if isinstance(v, (int, float)) else None

    rows = [(n, c.get("group"), _nullable(c.get("observed")), _nullable(c.get("expected")), number(c.get("diff")), c.get("status"), number(c.get("tol")), c.get("note")) for n, c in manifest.get("results", {}).items()]
    return spark.createDataFrame(rows, "name string, group string, observed string, expected string, diff double, status string, tol double, note string")


def _nullable(v) -> str | None:
    return None if v is None else repr(v) if isinstance(v, float) else str(v)


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_sha256(path: str, expected: str) -> dict:
    actual = sha256_file(path)
    return {"actual": actual, "expected": expected, "match": actual == expected}


def verify_capsule(spark: SparkSession, folder: str, provenance_file: str = "data_provenance.json", data_file: str | None = None, manifest_file: str | None = None, script_file: str | None = None) -> DataFrame:
    """Checks of a stored capsule in order: check, ok, detail. A check whose input is absent is left out.

    The data are scanned once by Spark, for the row count and the value sets.
    """
    out: list[tuple[str, bool, str]] = []

    def done() -> DataFrame:
        return spark.createDataFrame(out, CHECKS)

    at = os.path.join(folder, provenance_file)
    try:
        with open(at) as f:
            provenance = json.load(f)
    except (OSError, ValueError) as e:
        out.append(("provenance_readable", False, str(e)))
        return done()
    out.append(("provenance_readable", True, at))
    resource = provenance.get("resource") or {}
    data = os.path.join(folder, data_file or resource.get("filename") or "data.csv")
    if not os.path.isfile(data):
        out.append(("data_present", False, data))
    else:
        out.append(("data_present", True, data))
        if resource.get("sha256"):
            found = verify_sha256(data, resource["sha256"])
            out.append(("data_sha256", found["match"], found["actual"]))
        if resource.get("size_bytes") is not None:
            size = os.path.getsize(data)
            out.append(("data_size_bytes", size == resource["size_bytes"], str(size)))
        if data.lower().endswith(".csv"):
            try:
                table = spark.read.option("header", True).csv(data)
                n = table.count()
                out.append(("data_readable", True, f"{len(table.columns)} columns"))
            except Exception as e:  # noqa: BLE001  any reader's error is the finding
                out.append(("data_readable", False, str(e)[:200]))
            else:
                if resource.get("row_count_data_rows") is not None:
                    out.append(("data_row_count", n == resource["row_count_data_rows"], str(n)))
                if provenance.get("schema"):
                    bad = [r["message"] for r in validate_schema(table, Expected.of(provenance)).collect() if r["severity"] == "fatal"]
                    out.append(("schema_valid", not bad, "; ".join(bad)))
    pinned = (provenance.get("script") or {}).get("sha256")
    if manifest_file and os.path.isfile(at := os.path.join(folder, manifest_file)):
        with open(at) as f:
            manifest = json.load(f)
        rows = stale(manifest_frame(spark, manifest)).collect()
        out.append(("manifest_consistent", not rows, ", ".join(r["name"] for r in rows) or f"{len(manifest.get('results') or {})} results re-checked"))
        pinned = (manifest.get("meta") or {}).get("script_sha256") or pinned  # the manifest's comes first
    if script_file and pinned and os.path.isfile(at := os.path.join(folder, script_file)):
        found = verify_sha256(at, pinned)
        out.append(("script_sha256", found["match"], found["actual"]))
    return done()


def all_ok(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"))


def audit_gate(manifest: DataFrame) -> None:
    """Raise if any check differs; warnings pass."""
    counts = summarise(manifest).first()
    if counts["differ"]:
        raise ValueError(f"{counts['differ']} of {counts['total']} checks differ")
