"""Fetching many addresses on the workers, as a data source of its own and as a step on a table.

Addresses are dealt out by host, and a host's addresses are fetched one after the other with a pause between requests, so no host meets more
than one request at a time however many tasks run. What cannot be fetched live is taken from an archived copy: the one given, or the
closest one that the archive knows. ``status`` tells which: `live`, `wayback`, or null where neither was to be had, with the
last error. A task that is run again fetches its hosts again.

    spark.dataSource.register(Addresses)
    spark.read.format("addresses").option("addresses", json.dumps([url, [url, archived], ...])).load()
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .portals import DOWNLOAD_TIMEOUT, LOOKUP_TIMEOUT, http_get

SCHEMA = "url string, archived string, status string, body binary, error string"
#: Seconds between two requests to one host.
PAUSE = 1.0
#: Fixed value: where the archive tells of its closest copy.
LOOKUP = "https://archive.org/wayback/available?url="
Get = Callable[[str, float], bytes]
Found = tuple[str, str | None, str | None, bytes | None, str | None]


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


class _Paced:
    """A transport that waits before a host is asked again, and tries a failed request again."""

    def __init__(self, get: Get, pause: float, tries: int):
        self.get, self.pause, self.tries, self.last = get, pause, tries, {}

    def __call__(self, url: str, timeout: float) -> bytes:
        host = host_of(url)
        for left in range(self.tries - 1, -1, -1):
            wait = self.last.get(host, float("-inf")) + self.pause - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            self.last[host] = time.monotonic()
            try:
                return self.get(url, timeout)
            except Exception:  # noqa: BLE001  the last failure is the caller's
                if not left:
                    raise
        raise ValueError("no tries")


def _closest(url: str, lookup: str, get: Get) -> str | None:
    """The archive's closest copy, over https unless the archive itself is not."""
    try:
        found = json.loads(get(lookup + quote(url, safe=""), LOOKUP_TIMEOUT))["archived_snapshots"]["closest"]
    except Exception:  # noqa: BLE001  no answer is no copy
        return None
    if found.get("available") is not True:
        return None
    return "https://" + found["url"].removeprefix("http://").removeprefix("https://") if lookup.startswith("https://") else found["url"]


def fetch_group(addresses: Iterable[tuple[str | None, str | None]], pause: float = PAUSE, tries: int = 1, lookup: str = LOOKUP, get: Get = http_get) -> Iterator[Found]:
    """One row for each (url, archived): archived null looks a copy up, empty tries none."""
    paced = _Paced(get, pause, tries)
    for url, archived in addresses:
        if not url:
            yield (url, archived, None, None, "no address")
            continue
        try:
            yield (url, archived, "live", paced(url, DOWNLOAD_TIMEOUT), None)
            continue
        except Exception as e:  # noqa: BLE001  any failure leads to the archive
            error = f"{type(e).__name__}: {e}"
        copy = _closest(url, lookup, paced) if archived is None else archived
        if copy:
            try:
                yield (url, copy, "wayback", paced(copy, DOWNLOAD_TIMEOUT), None)
                continue
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        yield (url, copy or archived, None, None, error)


@dataclass
class _Group(InputPartition):
    addresses: list[tuple[str | None, str | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = json.loads(options.get("addresses", "[]"))
        self.addresses = [(a, None) if a is None or isinstance(a, str) else (a[0], a[1]) for a in given]
        self.groups = int(options.get("groups", "0"))
        self.pause, self.tries, self.lookup = float(options.get("pause", PAUSE)), int(options.get("tries", "1")), options.get("lookup", LOOKUP)

    def partitions(self) -> list[InputPartition]:
        """One for each host, or as many as asked for; a host is never split."""
        hosts: dict[str, list] = {}
        for a in self.addresses:
            hosts.setdefault(host_of(a[0]), []).append(a)
        groups: list[list] = [[] for _ in range(min(self.groups or len(hosts), len(hosts)) or 1)]
        for own in sorted(hosts.values(), key=len, reverse=True):  # the largest first, each to the group with the fewest
            min(groups, key=len).extend(own)
        return [_Group(g) for g in groups]

    def read(self, partition: _Group) -> Iterator[Found]:
        yield from fetch_group(partition.addresses, self.pause, self.tries, self.lookup)


class Addresses(DataSource):
    """Options: addresses (JSON: addresses, or pairs with an archived copy), groups, pause, tries, lookup."""

    @classmethod
    def name(cls) -> str:
        return "addresses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(df: DataFrame, url: str, archived: str | None = None, pause: float = PAUSE, tries: int = 1, lookup: str = LOOKUP, get: Get = http_get) -> DataFrame:
    """url, archived, status, body, error for the distinct addresses of ``df``, however many: each is fetched once, a host by one task."""
    copy = F.max(archived) if archived else F.max(F.lit(None).cast("string"))
    each = df.groupBy(F.col(url).alias("url")).agg(copy.alias("archived"))
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for row in fetch_group(pairs, pause, tries, lookup, get):  # one page at a time
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return each.repartition(host).mapInArrow(run, SCHEMA)
