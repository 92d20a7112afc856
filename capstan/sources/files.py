"""Reading and writing tables, provenance, manifests and summaries."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_provenance(path: str) -> dict | None:
    """Nested JSON; None if there is no file."""
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table with a header line. Without a schema all columns stay text; with one, a bad row is an error."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.option("mode", "FAILFAST").schema(schema).csv(path) if schema else reader.csv(path)


def read_workspace(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Prepared tables of a folder, by name, from Parquet."""
    return {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in names}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def html_of(source: str) -> str:
    """The text of a file that ``source`` names, unless it is markup itself."""
    if "<" not in source and os.path.isfile(source):
        with open(source, encoding="utf-8", errors="replace") as f:
            return f.read()
    return source


def first_present(paths: Iterable[str]) -> str | None:
    return next((p for p in paths if os.path.exists(p)), None)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of many files; the executors hash them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def csv_field(x: Column) -> Column:
    """Quoted only where it holds a comma, a quote or a line end."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def write_manifest(manifest: dict, path: str) -> None:
    """Pretty JSON with whole doubles, so a check can be derived again from what is stored."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2, ensure_ascii=False)


def plain(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def write_text(text: str, path: str) -> None:
    """UTF-8, or ASCII where that cannot be written."""
    try:
        data = text.encode()
    except UnicodeEncodeError:
        data = plain(text).encode()
    with open(path, "wb") as f:
        f.write(data)


def render(template: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", v)
    return template


def write_summary(manifest: dict, folder: str, paths: dict[str, str], done: str | None = None, contact: str | None = None, licence: str | None = None) -> str:
    """A run's SUMMARY.txt: what it is, paths, counts by status, files, versions, notes."""
    meta, status = manifest.get("meta", {}), [c["status"] for c in manifest.get("results", {}).values()]

    def block(title: str) -> list[str]:
        return ["", "-" * 60, f"  {title}", "-" * 60]

    out = ["Reproducibility run", "", f"Project:   {meta.get('project', '(unnamed)')}", f"Author:    {meta.get('author', '(unknown)')}", f"When:      {meta.get('run_at', meta.get('created_utc', ''))}"]
    out.append("Mode:      " + ("SYNTHETIC (a check of the pipeline only)" if meta.get("synthetic") else "real data"))
    out += block("PATHS") + [f"{k[:1].upper() + k[1:] + ':':<15} {v}" for k, v in paths.items()]
    out += block("RESULT COUNTS") + [f"{'Total checks:':<14}{len(status)}"] + [f"{s + ':':<14}{status.count(s)}" for s in ("PASS", "DIFFER", "WARN", "INFO")]
    out += block("FILES") + [f"  {n}" for n in sorted(os.listdir(folder))]
    versions = (manifest.get("environment") or {}).get("packages")
    if versions:
        out += block("VERSIONS") + [f"  {k:<12} {v}" for k, v in versions.items()]
    if done:
        out += block("WHAT WAS DONE") + [done]
    out += [""] * bool(contact) + [f"Contact: {contact}"] * bool(contact) + [f"Licence: {licence}"] * bool(licence)
    target = os.path.join(folder, "SUMMARY.txt")
    write_text("\n".join(out) + "\n", target)
    return target


def citation(p: Column, today: str = "") -> Column:
    """Text and BibTeX from a provenance struct (captured_at_utc, dataset, resource); a DOI goes before an address."""
    d, r = p["dataset"], p["resource"]
    stamp = F.coalesce(p["captured_at_utc"], F.lit(""))
    year = F.coalesce(F.nullif(F.substring(stamp, 1, 4), F.lit("")), F.lit(today[:4]) if today else F.year(F.current_date()).cast("string"))
    publisher, title = F.coalesce(d["publisher"], F.lit("Unknown publisher")), F.coalesce(r["name"], d["package_slug"], F.lit("Untitled dataset"))
    url, day = F.coalesce(r["direct_url"], F.lit("")), F.substring(stamp, 1, 10)

    def some(met: Column, *parts) -> Column:
        return F.when(met, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")

    has_doi, has_licence = d["doi"].isNotNull(), d["licence_short"].isNotNull()
    text = F.concat(
        publisher, F.lit(" ("), year, F.lit("). "), title, F.lit(" [Data set]."),
        F.when(has_doi, F.concat(F.lit(" https://doi.org/"), d["doi"])).otherwise(some(url != "", " ", url)),
        some(day != "", " Retrieved ", day, "."), some(has_licence, " Licence: ", d["licence_short"], "."),
    )
    key = F.concat(F.regexp_replace(F.coalesce(d["package_slug"], F.lit("dataset")), "[^A-Za-z0-9]", ""), year)
    bibtex = F.concat(
        F.lit("@misc{"), key, F.lit(",\n  author = {{"), publisher, F.lit("}},\n  title = {"), title, F.lit("},\n  year = {"), year, F.lit("},"),
        some(has_doi, "\n  doi = {", d["doi"], "},"), some(url != "", "\n  url = {", url, "},"),
        some(day != "", "\n  note = {Retrieved ", day, some(has_licence, "; licence: ", d["licence_short"]), "},"), F.lit("\n}"),
    )
    return F.struct(text.alias("text"), bibtex.alias("bibtex"))
