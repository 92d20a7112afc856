"""A reproducible archive of files: templates filled in, entries packed on the workers, written in order through Hadoop's file systems."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_ascii

#: Marks and sizes of the archive format; entries carry its first date, so that equal files make equal archives.
_LOCAL, _CENTRAL, _END = 0x04034B50, 0x02014B50, 0x06054B50
_DATE, _TIME, _UTF8, _DEFLATED = 33, 0, 1 << 11, 8
_MOST_BYTES, _MOST_FILES = (1 << 32) - 1, (1 << 16) - 1


def rendered(template: Column, values: dict[str, str], ascii_only: bool = False) -> Column:
    """``template`` with every `{{name}}` of ``values`` filled in; as ASCII if asked for. Values are not filled in again."""
    names = F.regexp_extract_all(template, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))
    parts = F.split(template, r"\{\{[^{}]*\}\}", -1)
    known = F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else None
    filled = F.transform(names, lambda n: F.coalesce(table[n] if table is not None else known, F.concat(F.lit("{{"), n, F.lit("}}"))))
    out = F.array_join(F.zip_with(parts, filled, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    if not ascii_only:
        return out
    return F.array_join(F.transform(F.split(out, "\n", -1), lambda line: F.array_join(F.transform(F.split(line, "\t", -1), to_ascii), "\t")), "\n")


def _packed(files: DataFrame) -> DataFrame:
    """name, crc, size, packed: the workers compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = content or b""
                squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = squeeze.compress(raw) + squeeze.flush()
                yield pa.RecordBatch.from_pydict({"name": [name], "crc": pa.array([zlib.crc32(raw)], pa.int64()), "size": pa.array([len(raw)], pa.int64()), "packed": pa.array([body], pa.binary())})

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, crc long, size long, packed binary")


def _header(mark: int, name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<IHHHHHIIIHH", mark, 20, _UTF8, _DEFLATED, _TIME, _DATE, crc, packed, size, len(name), 0)


def write_bundle(files: DataFrame, path: str) -> int:
    """Write the rows of ``files`` (name, content: text or bytes) as one zip archive at ``path``, in order of their names; how many.

    The driver passes on one partition of packed entries at a time. Names must differ and not be null, files stay under 4 GB and 65,536:
    what does not fit raises, and nothing is left at ``path``.
    """
    spark = files.sparkSession
    odd = files.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1 or name is null").limit(1).collect()
    if odd:
        raise ValueError(f"name {odd[0]['name']!r} is missing or given twice")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    system = target.getFileSystem(conf)
    out, at, central, count = system.create(part, True), 0, [], 0
    done = False
    try:
        for row in _packed(files).orderBy("name").toLocalIterator():
            name, body = row["name"].encode(), bytes(row["packed"])
            if row["size"] > _MOST_BYTES or at + len(body) > _MOST_BYTES or count == _MOST_FILES:
                raise ValueError("more or larger files than the format holds")
            head = _header(_LOCAL, name, row["crc"], len(body), row["size"]) + name
            entry = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 20, 20, _UTF8, _DEFLATED, _TIME, _DATE, row["crc"], len(body), row["size"], len(name), 0, 0, 0, 0, 0, at)
            central.append(entry + name)
            out.write(bytearray(head + body))
            at, count = at + len(head) + len(body), count + 1
        listing = b"".join(central)
        out.write(bytearray(listing + struct.pack("<IHHHHIIH", _END, 0, 0, count, count, len(listing), at, 0)))
        done = True
    finally:
        out.close()
        if not done:
            system.delete(part, False)
    system.delete(target, False)
    system.rename(part, target)
    return count
