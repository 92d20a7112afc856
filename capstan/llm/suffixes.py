"""Removal of repeated byte strings with per-shard suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus (at a smaller
id, or earlier in the same text). The corpus is not sorted whole. Every window of LENGTH bytes has an anchor, its
least gram of GRAM bytes by hash, so equal windows have equal anchors, and the stretch of windows that share an
anchor's place is one segment:

1. Segments that are equal byte for byte are settled by hash, first within each task and then per anchor: all
   but the earliest go. An anchor with a single segment left needs nothing more.
2. The other segments are dealt to shards by anchor; those of an anchor with very many are cut again by a second
   one. A shard's segments are laid end to end and their suffix array is built by Larsson-Sadakane refinement (ranks
   by 8 bytes, then by doubling, touching only groups that still tie) and Kasai's common prefixes (in parallel
   lanes, cut off at LENGTH). Windows whose suffixes share LENGTH bytes stand together; all but the earliest go.
3. Of anchors that fill more than a shard, each shard passes on the earliest of every distinct window. These are range partitioned,
   which finds each window's place among the bounds by binary search, and merged in sorted order.
4. Each text is joined with its runs of removed windows.

Defined results: null counts as an empty text; texts shorter than LENGTH bytes stay whole; of rows that repeat
with one id none is earlier than the other: their runs are found once a task and joined to each as a set. Rows that share an id are told apart by 64 bits of their text; null ids
come before all others and are one id; equal windows of equal id and start are ties and stay; very long texts are worked on
in blocks; an empty table gives an empty table; extra columns of the table are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import small_batches, staged, table
from .textops import mix64, ranges, slice_hash, text_chunks, window_hash

LENGTH, GRAM = 100, 24
#: Grams in a window.
SPREAD = LENGTH - GRAM + 1
#: Rows a task compares before it passes them on; bytes of a shard; segments of one anchor from which on it is split.
TASK_ROWS, SHARD_BYTES, MANY_SEGMENTS = 1 << 20, 1 << 21, 1 << 10
#: Windows of a very long text that are worked on at once.
BLOCK = 1 << 20
_PLACE_BITS = 22
#: The least number of one byte, of two and so on.
_POWERS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
#: Bits of the filter that tells which texts have segments to compare; a full filter only lets more pass.
FILTER_BITS_LOG2 = 22
NO_ID = -(1 << 63)


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments_of(data: np.ndarray, offsets: np.ndarray, seed: int = 8) -> dict[str, np.ndarray]:
    """Segments of a chunk of texts: text, start (of its first window), windows, anchor and content hashes.

    ``seed`` chooses the order in which a gram is least.
    """
    starts, sizes = offsets[:-1], np.diff(offsets)
    texts = np.flatnonzero(sizes >= LENGTH)
    cols: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "windows", "anchor", "content")}
    if len(texts):
        lo, hi = int(starts[texts[0]]), int(offsets[texts[-1] + 1])
        for at in range(lo, hi - LENGTH + 1, BLOCK):  # one block, but for very long texts
            part = data[at : min(hi, at + BLOCK + LENGTH - 1)]
            gram = window_hash(part, GRAM, seed)
            n = len(gram)
            low = np.uint64((1 << _PLACE_BITS) - 1)
            order = (gram & ~low) | np.arange(n, dtype=np.uint64)
            place = (_least_in(order, SPREAD) & low).astype(np.int64)  # the anchor of each window
            w = np.arange(len(place)) + at
            owner = np.searchsorted(offsets, w, side="right") - 1
            inside = w + LENGTH <= offsets[owner + 1]
            first = inside.copy()
            first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(first)
            if not len(begin):
                continue
            # A segment ends where the next begins, or where its text's windows end.
            stop = np.minimum(np.append(begin[1:], len(place)), offsets[owner[begin] + 1] - LENGTH + 1 - at)
            anchor = place[begin]
            content = slice_hash(part, begin, stop + LENGTH - 1, 9) ^ mix64((anchor - begin).astype(np.uint64) + np.uint64(7))
            for k, v in (("text", owner[begin]), ("start", begin + at - offsets[owner[begin]]), ("windows", stop - begin), ("anchor", gram[anchor]), ("content", content)):
                cols[k].append(v)
    kinds = {"text": np.int64, "start": np.int64, "windows": np.int64, "anchor": np.uint64, "content": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in cols.items()}


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement; a suffix that ends first comes first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _words(data)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    if not data.all():  # zero bytes and the end look alike in a word; the bytes that are left tell them apart
        left = np.minimum(n - np.arange(n), 8)
        order = np.lexsort((left, key))
        head[1:] |= left[order][1:] != left[order][:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 8
    # Places of the array whose suffix still shares its group.
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        suffix = order[open_]
        beyond = suffix + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = rank[suffix] * (n + 1) + second  # group and next rank as one number
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[open_] = suffix
        head = np.ones(len(by), bool)
        head[1:] = both[1:] != both[:-1]
        rank[suffix] = open_[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        open_ = open_[~(head & np.append(head[1:], True))]
        step *= 2
    return order, rank


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """How many bytes, up to ``most``, each suffix shares with its predecessor in the array (Kasai).

    Suffixes are visited in text order; what one shares, less one, the next shares at least. The text is cut
    into lanes which advance together.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = np.concatenate([_words(data), np.zeros(most + 8, np.uint64)])
    length = -(-n // min(lanes, n))
    at = np.arange(0, n, length)
    known = np.zeros(len(at), np.int64)
    for k in range(length):
        i = at + k
        live = i < n
        if not live.all():
            at, known, i = at[live], known[live], i[live]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        limit = np.where(r > 0, np.minimum(n - np.maximum(i, j), most), 0)
        h = np.minimum(np.maximum(known - 1, 0), limit)
        go = np.flatnonzero(h < limit)
        while len(go):
            a, b = words[i[go] + h[go]], words[j[go] + h[go]]
            x = a ^ b
            same = 8 - np.searchsorted(_POWERS, x, side="right")  # leading equal bytes
            h[go] = np.minimum(h[go] + same, limit[go])
            go = go[(same == 8) & (h[go] < limit[go])]
        out[r] = h
        known = h
    return out


def repeated_windows(bodies: list[bytes], windows: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the segments: its segment, its place there, and whether an equal one is earlier."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    firsts = np.cumsum(sizes) - sizes
    order, rank = suffix_array(data)
    shared = common_prefixes(data, order, rank, LENGTH)
    kind = np.cumsum(shared < LENGTH)  # suffixes with the same LENGTH bytes, in array order
    segment = np.repeat(np.arange(len(bodies)), windows)
    place = ranges(np.zeros(len(bodies), np.int64), windows)
    own = kind[rank[firsts[segment] + place]]
    doc, start = ids[segment], starts[segment] + place
    gone = np.zeros(len(own), bool)
    some = np.flatnonzero(np.bincount(own)[own] > 1)  # the windows that have an equal one
    by = some[np.lexsort((start[some], doc[some], own[some]))]
    head = np.ones(len(by), bool)
    head[1:] = own[by][1:] != own[by][:-1]
    lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    gone[by] = (doc[by] != doc[lead]) | (start[by] != start[lead])
    return segment, place, gone


_PLACE = ("id", "row", "start", "windows")
_RUNS = "id long, row long, start long, windows long"
_SEGMENTS = f"later boolean, anchor long, content long, {_RUNS}"


def _settled(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest segment of each content, and of those that are later."""
    order = np.lexsort((c["start"], c["id"], c["content"], c["anchor"]))
    head = np.ones(len(order), bool)
    head[1:] = (c["anchor"][order][1:] != c["anchor"][order][:-1]) | (c["content"][order][1:] != c["content"][order][:-1])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = (c["id"][order] != c["id"][lead]) | (c["start"][order] != c["start"][lead])
    return np.sort(order[~later]), np.sort(order[later])


def _merged(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs (_PLACE) with those of one text that follow each other as one."""
    order = np.lexsort((c["start"], c["row"], c["id"]))
    c = {k: c[k][order] for k in _PLACE}
    head = np.ones(len(order), bool)
    head[1:] = (c["id"][1:] != c["id"][:-1]) | (c["row"][1:] != c["row"][:-1]) | (c["start"][1:] != (c["start"] + c["windows"])[:-1])
    heads = np.flatnonzero(head)
    return {k: v[heads] for k, v in c.items()} | {"windows": np.add.reduceat(c["windows"], heads) if len(heads) else c["windows"][:0]}


def _task_segments(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (id, row, text): the earliest of each content in a task, and the later ones as merged runs."""

    def flush(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([p[k] for p in parts]) for k in ("anchor", "content", *_PLACE)}
        kept, gone = _settled(c)
        none = np.zeros(0, np.int64)
        runs = _merged({k: c[k][gone] for k in _PLACE})
        for later, x in ((False, {k: v[kept] for k, v in c.items()}), (True, {"anchor": none, "content": none} | runs)):
            n = len(x["id"])
            nulls = {k: pa.nulls(n, pa.int64()) for k in ("anchor", "content")} if later else {k: x[k].view(np.int64) for k in ("anchor", "content")}
            yield pa.RecordBatch.from_pydict({"later": np.full(n, later)} | nulls | {k: x[k] for k in _PLACE})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()
        for batch in batches:
            # Rows that repeat id and text have the same runs: a task works them out once.
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [not (k in seen or seen.add(k)) for k in own]
            batch = batch if all(fresh) else batch.filter(pa.array(fresh))
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column(2)):
                s = segments_of(data, offsets)
                t = s.pop("text") + lo
                parts.append(s | {"id": ids[t], "row": rows[t]})
                size += len(t)
                if size >= TASK_ROWS:
                    yield from flush(parts)
                    parts, size, seen = [], 0, set(own)
        if parts:
            yield from flush(parts)

    return docs.mapInArrow(run, _SEGMENTS)


def _per_anchor(segments: DataFrame) -> DataFrame:
    """Rows by kind: later segments (kind 0), and those to be compared (1; 2 where the anchor has very many).

    What is later already is dealt out by its own place, so copies fill no anchor's task.
    """
    columns = ("anchor", "content", *_PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # the last anchor of a batch may go on in the next

        def settle(c):
            """All rows of whole anchors, sorted by anchor, content, id and start."""
            a, n = c["anchor"], len(c["anchor"])
            first = np.ones(n, bool)
            first[1:] = (a[1:] != a[:-1]) | (c["content"][1:] != c["content"][:-1])
            lead = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            later = (c["id"] != c["id"][lead]) | (c["start"] != c["start"][lead])
            heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            number = np.cumsum(first)  # distinct segments so far
            sizes = np.diff(np.append(heads, n))
            total = np.repeat(np.append(number[heads[1:]] - 1, number[-1]) - (number[heads] - 1), sizes)  # of its anchor
            kind = np.where(later, 0, np.where(total > MANY_SEGMENTS, 2, 1))
            keep = later | (total > 1)
            return pa.RecordBatch.from_pydict({"kind": kind[keep].astype(np.int32), "anchor": a[keep]} | {k: c[k][keep] for k in _PLACE})

        for batch in batches:
            later = batch.column(0)
            done = batch.filter(later)
            if done.num_rows:
                zero = np.zeros(done.num_rows, np.int32)
                yield pa.RecordBatch.from_pydict({"kind": zero, "anchor": zero.astype(np.int64)} | {k: done.column(done.schema.get_field_index(k)) for k in _PLACE})
            batch = batch.filter(pc.invert(later))
            if not batch.num_rows:
                continue
            c = {k: batch.column(i + 1).to_numpy() for i, k in enumerate(columns)}
            if held:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            last = int(np.searchsorted(c["anchor"], c["anchor"][-1]))
            if last:
                yield settle({k: v[:last] for k, v in c.items()})
            held = {k: v[last:] for k, v in c.items()}
        if held and len(held["anchor"]):
            yield settle(held)

    dealt = segments.repartition(F.coalesce("anchor", F.xxhash64("id", "start"))).sortWithinPartitions("later", "anchor", "content", "id", "start")
    return dealt.mapInArrow(run, f"kind int, anchor long, {_RUNS}")


def _squeezed(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``docs`` with its text compressed, for moving it; only those that ``wanted`` may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(_may_hold(shared.value, batch.column(0).to_numpy())))
            if batch.num_rows:
                raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0), "row": batch.column(1), "size": pa.array([len(r) for r in raw], pa.int64()), "packed": pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())}
                )

    return docs.mapInArrow(run, "id long, row long, size long, packed binary")


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS_LOG2)


def _may_hold(cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = _bit_of(ids)
    return ((cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each id; of a fixed size. Combined within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << (FILTER_BITS_LOG2 - 6), np.uint64)
        for batch in batches:
            bit = _bit_of(batch.column(0).to_numpy())
            np.bitwise_or.at(cells, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "word": cells[at].view(np.int64)})

    out = np.zeros(1 << (FILTER_BITS_LOG2 - 6), np.uint64)
    for r in ids.mapInArrow(run, "cell int, word long").groupBy("cell").agg(F.bit_or("word").alias("word")).collect():  # at most one for each 64 bits
        out[r["cell"]] = np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _cut_segments(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes of segments: anchor, id, row, start, windows, body.

    A segment whose anchor has very many is cut again by a second anchor, the least gram in another order; equal windows
    agree in both, so the two together deal them out.
    """
    lists = places.groupBy("id", "row").agg(F.collect_set(F.struct("kind", "anchor", "start", "windows")).alias("cuts"))
    joined = _squeezed(docs, _filter_of(places.select("id"))).dropDuplicates(["id", "row"]).join(lists, ["id", "row"]).select("id", "row", "size", "packed", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            ids, rows, sizes, packed, cuts = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                raw = codec.decompress(packed[k].as_buffer(), sizes[k].as_py(), asbytes=True)
                own = cuts[k].values
                kind, anchor, start, windows = (own.field(n).to_numpy() for n in ("kind", "anchor", "start", "windows"))
                many = np.flatnonzero(kind == 2)
                if len(many):
                    data = np.frombuffer(raw, np.uint8)
                    length = windows[many] + LENGTH - 1
                    s = segments_of(data[ranges(start[many], length)], np.concatenate([[0], np.cumsum(length)]), seed=10)
                    few, at = np.flatnonzero(kind != 2), many[s["text"]]
                    second = mix64(anchor[at].view(np.uint64) ^ mix64(s["anchor"])).view(np.int64)
                    anchor, start, windows = (np.concatenate(x) for x in ((anchor[few], second), (start[few], start[at] + s["start"]), (windows[few], s["windows"])))
                body = [raw[a:b] for a, b in zip(start.tolist(), (start + windows + LENGTH - 1).tolist())]
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "id": np.full(len(start), ids[k].as_py(), np.int64), "row": np.full(len(start), rows[k].as_py(), np.int64), "start": start, "windows": windows, "body": pa.array(body, pa.binary())})

    return joined.mapInArrow(run, f"anchor long, {_RUNS}, body binary")


def _compare(segments: DataFrame) -> DataFrame:
    """Runs of later windows (window null), and, where an anchor's segments fill more than a shard, the earliest of each
    distinct window of a shard with its bytes."""

    def settle(rows: list[tuple], spread: int | None) -> pa.RecordBatch:
        """``spread``: the anchor of the last rows, if more of its segments stand in other shards."""
        anchor, ids, row, start, windows = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        bodies = [r[5] for r in rows]
        segment, at, gone = repeated_windows(bodies, windows, ids, start)
        run_at = np.flatnonzero(gone)
        head = np.ones(len(run_at), bool)
        if len(run_at):
            head[1:] = (np.diff(run_at) != 1) | (segment[run_at][1:] != segment[run_at][:-1])
        heads = run_at[head]
        n = np.diff(np.append(np.flatnonzero(head), len(run_at)))
        up = np.flatnonzero(~gone & (anchor[segment] == spread)) if spread is not None else run_at[:0]
        every = np.concatenate([heads, up])
        size = np.concatenate([n, np.ones(len(up), np.int64)])
        window = [None] * len(heads) + [bodies[s][p : p + LENGTH] for s, p in zip(segment[up].tolist(), at[up].tolist())]
        s = segment[every]
        return pa.RecordBatch.from_pydict({"id": ids[s], "row": row[s], "start": start[s] + at[every], "windows": size, "window": pa.array(window, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, spread = [], 0, None
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for row in zip(c["anchor"], c["id"], c["row"], c["start"], c["windows"], c["body"]):
                if spread is not None and row[0] != spread:  # the last part of a spread anchor
                    yield settle(rows, spread)
                    rows, size, spread = [], 0, None
                if size >= SHARD_BYTES:
                    if row[0] == rows[-1][0]:
                        spread = row[0]
                    yield settle(rows, spread)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield settle(rows, spread)

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _RUNS + ", window binary")


def _merge_spread(tops: DataFrame) -> DataFrame:
    """Of equal windows from different shards, all but the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = []
            for w, i, s, r in zip(c["window"], c["id"], c["start"], c["row"]):
                if w != last:
                    last, first = w, (i, s)
                elif (i, s) != first:
                    out.append((i, r, s, 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "row", "start", "windows"])

    return tops.repartitionByRange("window").sortWithinPartitions("window", "id", "start").mapInArrow(run, _RUNS)


def removals(docs: DataFrame) -> DataFrame:
    """Runs of windows to remove: id, row, start, windows. ``docs`` has id, row (a 64-bit hash of the text) and text."""
    settled = staged(_per_anchor(_task_segments(docs)), "segments")
    compared = staged(_compare(_cut_segments(docs, settled.filter("kind > 0"))), "compared")
    merged = _merge_spread(compared.filter("window is not null"))
    later = settled.filter("kind = 0").select(*_PLACE)
    return later.unionByName(compared.filter("window is null").drop("window")).unionByName(merged)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, removed (start and end of each maximal run, in bytes) and
    kept (the bytes that remain)."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    runs = removals(keyed).groupBy("id", "row").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    joined = _squeezed(keyed).join(runs, ["id", "row"], "left").select("id", "size", "packed", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            ids, sizes, packed, lists = (batch.column(k) for k in range(4))
            cuts, kept = [], []
            for k in range(batch.num_rows):
                raw = codec.decompress(packed[k].as_buffer(), sizes[k].as_py(), asbytes=True) if sizes[k].as_py() else b""
                spans = []
                if lists[k].is_valid:
                    own = lists[k].values
                    start = own.field("start").to_numpy()
                    end = start + own.field("windows").to_numpy() + LENGTH - 1
                    by = np.argsort(start, kind="stable")
                    start, far = start[by], np.maximum.accumulate(end[by])
                    head = np.concatenate([[True], start[1:] > far[:-1]])
                    spans = list(zip(start[head].tolist(), far[np.append(np.flatnonzero(head)[1:] - 1, len(far) - 1)].tolist()))
                cuts.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)])))
            yield pa.RecordBatch.from_pydict({"id": ids, "n_bytes": sizes, "removed": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    out = joined.mapInArrow(run, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", id_column)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
