"""Fetching on the workers from a server of our own, and archives that are read back."""

import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from capstan.sources import bundle, fetching


class Pages(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        Pages.asked.append((self.path, time.monotonic()))
        base = f"http://127.0.0.1:{self.server.server_port}"
        if self.path.startswith("/ok"):
            code, body = 200, b"page \xff" + self.path.encode()
        elif self.path.startswith("/copy"):
            code, body = 200, b"archived"
        elif self.path.startswith("/lookup"):
            known = "known" in self.path
            code, body = 200, json.dumps({"archived_snapshots": {"closest": {"available": known, "url": f"{base}/copy"}} if known else {}}).encode()
        else:
            code, body = 404, b"gone"
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_source_has_live_archived_and_missing_pages(spark, base):
    spark.dataSource.register(fetching.Addresses)
    given = [f"{base}/ok/1", [f"{base}/gone/2", f"{base}/copy/2"], f"{base}/known/3", f"{base}/gone/4", [f"{base}/gone/5", ""], None, "no address at all"]
    df = spark.read.format("addresses").options(addresses=json.dumps(given), pause="0", lookup=f"{base}/lookup?url=").load()
    rows = df.collect()
    got = {r["url"]: (r["status"], r["body"] and bytes(r["body"])) for r in rows}
    assert got[f"{base}/ok/1"] == ("live", b"page \xff/ok/1")
    assert got[f"{base}/gone/2"] == ("wayback", b"archived") == got[f"{base}/known/3"]
    assert [got[k] for k in (f"{base}/gone/4", f"{base}/gone/5", None, "no address at all")] == [(None, None)] * 4
    assert all((r["error"] is None) == (r["status"] is not None) for r in rows) and len(rows) == 7


def test_hosts_are_not_split_and_wait(base):
    port = base.rsplit(":", 1)[1]
    hosts = [f"http://{h}:{port}/ok/{i}" for i in range(3) for h in ("127.0.0.1", "localhost")]
    reader = fetching._Reader({"addresses": json.dumps(hosts), "groups": "9", "pause": "0"})
    parts = reader.partitions()
    assert sorted(len(p.addresses) for p in parts) == [3, 3] and all(len({fetching.host_of(a) for a, _ in p.addresses}) == 1 for p in parts)
    assert [r[2] for r in reader.read(parts[0])] == ["live"] * 3
    times = []
    assert len(list(fetching.fetch_group(parts[0].addresses, 0.1, get=lambda url, timeout: times.append(time.monotonic()) or b""))) == 3
    assert all(b - a >= 0.099 for a, b in zip(times, times[1:]))
    assert len(fetching._Reader({}).partitions()) == 1


def test_table_of_addresses(spark, base):
    urls = [f"{base}/ok/{i % 5}" for i in range(40)] + [f"{base}/gone/x"]
    Pages.asked.clear()
    df = spark.createDataFrame([(u,) for u in urls], "link string")
    rows = fetching.fetched(df, "link", pause=0.0, tries=2, lookup=f"{base}/lookup?url=").collect()
    assert sorted(r["status"] or "" for r in rows) == [""] + ["live"] * 5
    asked = [p for p, _ in Pages.asked if p.startswith("/gone")]
    assert len(asked) == 2  # once more, and no other page twice
    assert len([p for p, _ in Pages.asked if p.startswith("/ok")]) == 5
    assert fetching.fetched(df.limit(0), "link").count() == 0


def test_bundle_is_read_back(spark, tmp_path):
    files = [("b/readme.txt", "Hello {{who}}, {{unknown}} {{who}} é\n\ttab"), ("a.txt", ""), ("ü.md", "{{who}}" * 5000)]
    df = spark.createDataFrame(files, "name string, template string").select("name", bundle.rendered(F.col("template"), {"who": "Ånn {{who}}"}).alias("content")).repartition(3)
    path = str(tmp_path / "out.zip")
    assert bundle.write_bundle(df, path) == 3
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "b/readme.txt", "ü.md"]
        assert z.read("b/readme.txt").decode() == "Hello Ånn {{who}}, {{unknown}} Ånn {{who}} é\n\ttab" and z.read("ü.md").decode() == "Ånn {{who}}" * 5000
    first = open(path, "rb").read()
    bundle.write_bundle(df.repartition(1), path)
    assert open(path, "rb").read() == first  # the same files, the same archive
    with pytest.raises(ValueError, match="twice"):
        bundle.write_bundle(df.union(df), path)
    assert open(path, "rb").read() == first
    plain = df.sparkSession.createDataFrame([("é{{x}}\n\tß",)], "t string").select(bundle.rendered(F.col("t"), {"x": "Ω"}, ascii_only=True)).first()[0]
    assert plain == "eO\n\tss"
    assert bundle.write_bundle(df.limit(0), str(tmp_path / "none.zip")) == 0 and zipfile.ZipFile(tmp_path / "none.zip").namelist() == []
