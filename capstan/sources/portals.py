"""Addresses of open-data resources from the metadata of their portals, as columns over JSON text, and fetching with
a fallback to an archived copy.

A column that resolves to nothing is null. What is fetched here is fetched on the driver, for single files, or looked up on the workers;
the transport is a parameter. Many pages are fetched by ``fetching``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DOWNLOAD_CAUSES, anchor_text, file_extension, match_spans, url_encode, words_only
from ..operators.reports import parse_reports

RESOURCE = "struct<name:string,format:string,url:string>"
SHOW = f"struct<success:boolean,result:struct<resources:array<{RESOURCE}>>>"
SEARCH = f"struct<result:struct<results:array<struct<resources:array<{RESOURCE}>>>>>"
SNAPSHOT = "struct<archived_snapshots:struct<closest:struct<available:boolean,url:string>>>"
#: Seconds: for a download, for a lookup.
DOWNLOAD_TIMEOUT, LOOKUP_TIMEOUT = 120, 30
#: Links of any kind, and those to data files (a fixed value: the path and the file types that count as data).
ANY_LINK = r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
FILE_LINK = r'(?i)<a\b[^>]*href="([^"]+/files/[^"]+\.(?:xlsx|xls|zip|csv))"[^>]*>(.*?)</a>'
#: Characters before a link in which its heading is looked for.
HEADING_REACH = 1200


def _named(resource: Column, pattern: str) -> Column:
    return F.coalesce(resource["name"], F.lit("")).rlike("(?i)" + pattern)


def package_show_url(body: Column, pattern: str) -> Column:
    """Address of the first resource whose name matches, from a package_show reply that reports success."""
    reply = F.from_json(body, SHOW)
    found = F.filter(reply["result"]["resources"], lambda r: _named(r, pattern))
    return F.when(reply["success"], F.get(found, F.lit(0))["url"])


def package_search_url(body: Column, pattern: str, wanted: str | None = None) -> Column:
    """First match across all packages of a package_search reply. CSV is always accepted, other formats if wanted."""
    every = F.flatten(F.filter(F.transform(F.from_json(body, SEARCH)["result"]["results"], lambda p: p["resources"]), lambda r: r.isNotNull()))
    fits = (lambda f: F.lit(True)) if wanted is None else (lambda f: f.isin("CSV", wanted.upper()))
    found = F.filter(every, lambda r: _named(r, pattern) & fits(F.upper(F.coalesce(r["format"], F.lit("")))))
    return F.get(found, F.lit(0))["url"]


def search_address(endpoint: Column, query: Column, pattern: Column) -> Column:
    """The package_search request: portal base from the package_show endpoint, query or else the pattern's words."""
    asked = F.coalesce(F.nullif(query, F.lit("")), F.nullif(words_only(F.coalesce(pattern, F.lit(""))), F.lit("")))
    base = F.nullif(F.regexp_replace(F.coalesce(endpoint, F.lit("")), r"/api/3/.*$", ""), F.lit(""))
    return F.concat(base, F.lit("/api/3/action/package_search?q="), url_encode(asked))


def socrata_url(body: Column, host: Column, dataset: Column) -> Column:
    """CSV export of a dataset whose metadata has an id."""
    return F.when(F.get_json_object(body, "$.id").isNotNull(), F.concat(F.lit("https://"), host, F.lit("/api/views/"), dataset, F.lit("/rows.csv?accessType=DOWNLOAD")))


def arcgis_url(body: Column, layer: Column) -> Column:
    """GeoJSON query of a layer whose metadata has a name and no error."""
    sound = F.get_json_object(body, "$.name").isNotNull() & F.get_json_object(body, "$.error").isNull()
    return F.when(sound, F.concat(F.regexp_replace(layer, "/+$", ""), F.lit("/query?where=1%3D1&outFields=*&f=geojson")))


def snapshot_address(url: Column, stamp: Column | None = None) -> Column:
    out = F.concat(F.lit("https://archive.org/wayback/available?url="), url_encode(url))
    return out if stamp is None else F.when(F.coalesce(stamp, F.lit("")) == "", out).otherwise(F.concat(out, F.lit("&timestamp="), stamp))


def snapshot_url(body: Column) -> Column:
    """Address of the closest archived copy, always https, if there is one."""
    closest = F.from_json(body, SNAPSHOT)["archived_snapshots"]["closest"]
    return F.when(closest["available"], F.regexp_replace(closest["url"], "^http://", "https://"))


def report_address(number: Column, language: str = "en", base: str = "https://www.siu.on.ca") -> Column:
    """Address of a report page; null for numbers that are not positive."""
    if language not in ("en", "fr"):
        raise ValueError(f"unknown language {language!r}")
    n = number.try_cast("int")
    return F.when(n > 0, F.format_string(f"{base}/{language}/directors_report_details.php?drid=%d", n))


def link_catalogue(pages: DataFrame, key: str, order: str, html: str = "html", link: str = ANY_LINK, untold: tuple[str, ...] = ("", "download", "data tables"), until_dry: bool = False) -> DataFrame:
    """Links of paged listings, each address once, at its first page and place: url, title, format, page.

    A link without a telling text is named by the nearest heading before it, other links between them or not. Addresses
    are made unique by a minimum that is combined before the shuffle. ``until_dry`` stops the listing where a page after
    the first gives no new address; a page that could not be fetched (null) does not stop it.
    """
    heading = r"(?is)<h[2-4][^>]*>(.*?)</h[2-4]>"
    page = F.col(html)
    hits = F.regexp_extract_all(page, F.lit(link), F.lit(0))
    before = F.transform(match_spans(page, link), lambda s: F.substr(page, F.greatest(s["start"] - HEADING_REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(HEADING_REACH))))
    rows = pages.select(F.col(key).alias("page"), F.col(order).alias("_order"), F.posexplode(F.arrays_zip(hits.alias("hit"), before.alias("before"))).alias("place", "l"))
    url, text = F.regexp_extract("l.hit", link, 1), anchor_text(F.regexp_extract("l.hit", link, 2))
    near = F.regexp_extract_all(F.col("l.before"), F.lit(heading), F.lit(1))
    head = F.when(F.size(near) > 0, anchor_text(F.element_at(near, -1)))
    title = F.when(F.lower(text).isin(*untold), F.coalesce(F.nullif(head, F.lit("")), F.nullif(text, F.lit("")), F.lit("(untitled)"))).otherwise(text)
    found = rows.select(url.alias("url"), title.alias("title"), file_extension(url).alias("format"), "page", "_order", "place")
    first = found.groupBy("url").agg(F.min(F.struct("_order", "place", "title", "format", "page")).alias("f"))
    if until_dry:
        listed = pages.filter(page.isNotNull()).select(F.col(order).alias("_order"))
        new = first.select(F.col("f._order").alias("_order")).distinct()
        start = pages.agg(F.min(order).alias("_start"))
        dry = listed.join(new, "_order", "left_anti").join(F.broadcast(start), F.col("_order") > F.col("_start")).agg(F.min("_order").alias("_stop"))
        first = first.join(F.broadcast(dry), F.col("_stop").isNull() | (F.col("f._order") < F.col("_stop")))  # one row
    return first.select("url", "f.title", "f.format", "f.page")


def with_snapshots(links: DataFrame, url: str = "url", get: Callable[[str, float], bytes] | None = None, pause: float = 1.0) -> DataFrame:
    """``links`` with wayback_url, the archived copy of each address, looked up on the workers and once more where none came.

    Each distinct address is looked up once. A task waits ``pause`` seconds between requests; how many tasks ask at a time is the number
    of partitions of the addresses, at most eight.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = float("-inf")

        def paced(address: str, timeout: float) -> bytes:
            nonlocal last
            time.sleep(max(0.0, last + pause - time.monotonic()))
            last = time.monotonic()
            return (get or http_get)(address, timeout)

        for b in batches:
            yield b.assign(wayback_url=[lookup_snapshot(a, get=paced) or lookup_snapshot(a, get=paced) for a in b["_url"]])

    addresses = links.select(F.col(url).alias("_url")).filter("_url is not null and _url != ''").distinct().repartition(8, "_url")
    found = addresses.mapInPandas(look, "_url string, wayback_url string")
    return links.join(found, F.col(url) == F.col("_url"), "left").drop("_url")


def absolute(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).otherwise(url)


# On the driver.

Get = Callable[[str, float], bytes]


def http_get(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # raises for anything but success
        return reply.read()


def fetch(url: str, target: str, archived: str | None = "", timeout: float = DOWNLOAD_TIMEOUT, get: Get = http_get) -> str:
    """Write the live copy, else the archived one; tells which. Nothing is left behind by a failure."""
    failed: Exception | None = None
    for source, address in (("live", url), ("wayback", archived)):
        if not address:
            continue
        try:
            body = get(address, timeout)
        except Exception as e:  # noqa: BLE001  any failure leads to the next source
            failed = e
            continue
        with open(target + ".part", "wb") as f:
            f.write(body)
        os.replace(target + ".part", target)
        return source
    raise OSError(f"neither {url} nor an archived copy could be fetched") from failed


def lookup_snapshot(url: str, stamp: str | None = None, get: Get = http_get) -> str | None:
    address = "https://archive.org/wayback/available?url=" + quote(url, safe="") + (f"&timestamp={stamp}" if stamp else "")
    try:
        closest = json.loads(get(address, LOOKUP_TIMEOUT))["archived_snapshots"]["closest"]
    except Exception:  # noqa: BLE001  no answer is no snapshot
        return None
    return "https://" + closest["url"].removeprefix("http://").removeprefix("https://") if closest.get("available") is True else None


def causes(message: str) -> list[str]:
    import re

    return [c for c, p in DOWNLOAD_CAUSES if re.search(p, message, re.I)]


def friendly_download(url: str, target: str, archived: str | None = None, get: Get = http_get, say: Callable[[str], None] = print) -> bool:
    """Download, tell likely causes of a failure, and try the archive. None looks a snapshot up, "" tries none."""
    try:
        fetch(url, target, "", get=get)
        return True
    except OSError as e:
        reason = str(e.__cause__ or e)
    say(f"download of {url} failed: {reason}; likely causes: {', '.join(causes(reason)) or 'unknown'}")
    archived = lookup_snapshot(url, get=get) if archived is None else archived
    if not archived:
        return False
    try:
        fetch(archived, target, "", get=get)
        return True
    except OSError:
        return False


def fetch_report(number, target: str, language: str = "en", archived: str = "", get: Get = http_get, base: str = "https://www.siu.on.ca") -> str:
    if language not in ("en", "fr") or int(number) <= 0:
        raise ValueError("a report has a positive number and a language, en or fr")
    return fetch(f"{base}/{language}/directors_report_details.php?drid={int(number)}", target, archived, get=get)


def fetch_and_parse_report(spark: SparkSession, number, language: str = "en", get: Get = http_get, say: Callable[[str], None] = print) -> Row | None:
    """The fields of one report by its number; None, with a message, where it cannot be fetched."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own, for one page
        target = os.path.join(folder, "report.html")
        try:
            fetch_report(number, target, language, get=get)
        except (OSError, ValueError) as e:
            say(f"could not fetch report {number}: {e}")
            return None
        with open(target, encoding="utf-8", errors="replace") as f:
            page = spark.createDataFrame([(f.read(),)], "html string")
    return parse_reports(page).drop("html").first()


def resolve(spark: SparkSession, provenance: dict | None, get: Get = http_get) -> str | None:
    """package_show, then package_search, then the pinned address."""
    data, resource = ((provenance or {}).get(k) or {} for k in ("dataset", "resource"))
    endpoint, pattern = data.get("ckan_api_endpoint"), resource.get("name_match_pattern")

    def ask(address: str | None, column: Callable[[Column], Column]) -> str | None:
        if not address:
            return None
        try:
            body = get(address, LOOKUP_TIMEOUT).decode()
        except Exception:  # noqa: BLE001
            return None
        return spark.createDataFrame([(body,)], "body string").select(column(F.col("body")).alias("url")).first()["url"]

    if endpoint and pattern:
        if found := ask(endpoint, lambda b: package_show_url(b, pattern)):
            return found
        row = spark.createDataFrame([(endpoint, resource.get("search_query"), pattern)], "e string, q string, p string")
        if found := ask(row.select(search_address(F.col("e"), F.col("q"), F.col("p"))).first()[0], lambda b: package_search_url(b, pattern, resource.get("format"))):
            return found
    return resource.get("direct_url")
