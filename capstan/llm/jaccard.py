"""N-gram Jaccard join: texts whose sets of word n-grams overlap by a given share or more, and the classes they form.

1. Equal sets (128 bits) become one node, whatever the number of copies.
2. A count sketch of fixed size over the grams of all texts gives the common order: rare grams first, ties by hash.
   (Any order that all sets share is exact; the sketch only decides how well it tells rare from frequent.) Two sets
   that link share a gram among the first ``n - ceil(share * n) + 1`` of either: the prefix filter.
3. One shuffle deals the prefix grams out by gram, those that the sketch calls frequent by gram and salt. In each group
   the nodes are compared with a leader, the one whose grams are the most frequent on average (the original of a group
   of copies); the salts' leaders are then compared with each other. A group of k nodes gives fewer than 2 k
   candidates. They pass the length and positional filters, then the suffix filter: counts of the hashes by range
   bound the overlap from above. What is left is verified once, word by word.
4. Groups whose nodes are still in different components are finished: every node outside a group's main component
   is held against all nodes of the group, in blocks of bounded size, through the length and suffix filters and, but for very
   large sets, 16 bits of each gram, so hardly a pair that does not link leaves a block. Pairs that were
   settled before are left out, and pairs inside one component need no comparison, as the result is the components. So no
   link between components is lost.

Defined results: null texts and texts without words have no grams and link with nothing; a text of fewer words than a gram
has is one gram; repeated rows belong together; an empty table gives an empty table; rows that share an id are told apart
by their texts; a null id counts as no id (its component takes the least other id); equal counts in the order are decided by
hash, equal leaders by node, so ties change no result; very long texts are read whole, a text at a time; columns of the
table named like the outputs are replaced, and no other name meets a helper's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .staging import discard, small_batches, staged, table
from .textops import give_back, list_array, lower_ascii, mix64, same_bytes, slice_hash, text_chunks, words
from .textops import ranges as all_ranges

GRAM, PERCENT = 4, 85
#: Cells of the sketch, and of a slice in which it travels. Fixed: 4 MB on the driver and in a worker.
SKETCH_LOG2, SLICE_LOG2 = 22, 16
#: Steps of the sketch's counts in a doubling.
STEPS = 8
#: A gram with so many more texts than the median cell is dealt out by salt, so many to a salt.
HOT = 512
#: Block sizes for the groups that leaders leave open.
SMALL_GROUP, QUERY_BLOCK, BASE_BLOCK = 512, 256, 2048
#: Small groups are compared so many rows and pairs at a time, first by few ranges, then by more.
ROWS_AT_ONCE, PAIRS_AT_ONCE, TIERS = 1 << 14, 1 << 19, (64, 256)
#: Bits of the filters that tell which nodes and texts a step needs; a full filter only lets more pass.
FILTER_BITS_LOG2 = 22
#: In open groups, sets of so many grams or fewer are compared by marks of 16 bits a gram, larger ones by so many ranges (a power of two).
MARKED = 1024
#: Set keys a task remembers, so that copies do not carry their prefix again.
SEEN = 1 << 18


def gram_hashes(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash of the gram at each word, and each text's first word and number of grams."""
    low = lower_ascii(data)
    starts, ends, first = words(low, offsets)
    w = slice_hash(low, starts, ends, 3)
    n = np.diff(first)
    padded = np.concatenate([w, np.zeros(gram, np.uint64)])
    full = mix64(w ^ np.uint64(gram))
    for j in range(1, gram):
        full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(w)])
    for i in np.flatnonzero((n > 0) & (n < gram)).tolist():  # the whole text is one gram
        a, k = int(first[i]), int(n[i])
        h = mix64(w[a : a + 1] ^ np.uint64(k))
        for j in range(1, k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[a + j : a + j + 1])
        full[a] = h[0]
    return full, first[:-1], np.where(n >= gram, n - gram + 1, np.minimum(n, 1))


def gram_sets(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Each text's distinct gram hashes, sorted."""
    full, first, n = gram_hashes(data, offsets, gram)
    return [np.unique(full[a : a + k]) for a, k in zip(first.tolist(), n.tolist())]


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    one = np.fromiter(((mix64(s).sum(dtype=np.uint64) if len(s) else 0) for s in sets), np.uint64, len(sets))
    two = np.fromiter(((mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0) for s in sets), np.uint64, len(sets))
    return mix64(one).view(np.int64), mix64(two + np.uint64(1)).view(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def range_counts(grams: np.ndarray) -> np.ndarray:
    """Counts of the hashes by range; the number of ranges is a power of two that leaves one or two in each.

    Counts are bytes. Should one not fit, all are made 255, which rules nothing out.
    """
    bits = max(0, len(grams).bit_length() - 1)
    counts = np.bincount((grams >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if not len(counts) or counts.max() <= 255 else np.full(len(counts), 255, np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """At most so many hashes are common to both sets."""
    size = min(len(a), len(b))
    a, b = (x.reshape(size, -1).sum(1, dtype=np.int64) for x in (a, b))
    return int(np.minimum(a, b).sum())


def needed_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    return -(-percent * (n + m) // (100 + percent))


def _cell(grams: np.ndarray) -> np.ndarray:
    return (mix64(grams) >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)


def gram_levels(docs: DataFrame, text: str, gram: int = GRAM) -> np.ndarray:
    """A level for each cell of the sketch: STEPS * log2(1 + the number of (text, gram) pairs that fall into it)."""
    slices, width = 1 << (SKETCH_LOG2 - SLICE_LOG2), 1 << SLICE_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, codec = np.zeros(1 << SKETCH_LOG2, np.uint32), pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                sets = gram_sets(data, offsets, gram)
                at, n = np.unique(_cell(np.concatenate([np.zeros(0, np.uint64), *sets])), return_counts=True)
                cells[at] += n.astype(np.uint32)
        parts = cells.reshape(slices, width)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(used.astype(np.int32)), "cells": pa.array([codec.compress(parts[i].tobytes(), asbytes=True) for i in used.tolist()], pa.binary())})
        del cells, parts
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(codec.decompress(packed.as_buffer(), 4 * width), np.uint32)
                sums[i] = sums.get(i, 0) + more.astype(np.uint64)
        levels = [np.minimum(np.round(STEPS * np.log2(1.0 + s)), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([*sums], pa.int32()), "levels": pa.array(levels, pa.binary())})

    dealt = docs.select(text).mapInArrow(count, "slice int, cells binary").repartition("slice")
    out = np.zeros(1 << SKETCH_LOG2, np.uint8)
    for r in dealt.mapInArrow(merge, "slice int, levels binary").collect():  # a fixed number of slices
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


_NODE_FIELDS = (("n_shingles", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("rank", T.DoubleType()), ("prefix", T.ArrayType(T.LongType(), False)), ("salts", T.ArrayType(T.IntegerType(), False)), ("ranges", T.BinaryType()))


def described(docs: DataFrame, text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` (row, text) without the text but with n_shingles, k1 and k2 (the set's key), rank, and, once for each set and
    task, prefix (rare first), salts and ranges."""
    levels = gram_levels(docs, text, gram)
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # of a fixed size
    floor = 2.0 ** (float(np.median(levels[levels > 0])) / STEPS) if levels.any() else 0.0
    salts_of = np.clip(np.ceil((2.0 ** (np.arange(256) / STEPS) - floor) / HOT), 1, 1 << 24).astype(np.int32)
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = shared.value, set()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                sets = gram_sets(data, offsets, gram)
                one, two = set_keys(sets)
                prefixes, salts, counts, rank, new = [], [], [], [], []
                for s, key in zip(sets, zip(one.tolist(), two.tolist())):
                    known = not len(s) or key in seen
                    new.append(not known)
                    if known:
                        rank.append(0.0)
                        continue
                    seen.add(key)
                    level = level_of[_cell(s)]
                    first = np.lexsort((s, level))[: prefix_length(len(s), percent)]
                    prefixes.append(s[first])
                    salts.append(salts_of[level[first]])
                    rank.append(float(level.mean()))
                if len(seen) > SEEN:
                    seen.clear()
                new = np.array(new, bool)
                sizes = np.zeros(len(sets), np.int64)
                sizes[new] = [len(p) for p in prefixes]
                cells = {
                    "n_shingles": pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
                    "k1": pa.array(one),
                    "k2": pa.array(two),
                    "rank": pa.array(rank, pa.float64()),
                    "prefix": _lists(np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64), sizes, new, pa.int64()),
                    "salts": _lists(np.concatenate([np.zeros(0, np.int32), *salts]), sizes, new, pa.int32()),
                    "ranges": pa.array([range_counts(s).tobytes() if k else None for s, k in zip(sets, new.tolist())], pa.binary()),
                }
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict({f.name: part.column(part.schema.get_field_index(f.name)) for f in kept} | cells)
        give_back()

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in _NODE_FIELDS)]))


def _lists(values: np.ndarray, sizes: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each size, null where not valid."""
    whole = list_array(values, sizes, kind)
    return pa.ListArray.from_arrays(whole.offsets, whole.values, mask=pa.array(~valid))


def _filters(n, m, i, j, percent: int):
    """Length and positional filters, for a gram at places i and j of the ordered sets."""
    length = (100 * F.least(n, m)) >= (percent * F.greatest(n, m))
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return length & ((100 + percent) * most >= percent * (n + m))


def _bit(mixed: Column) -> Column:
    return F.shiftrightunsigned(mixed, 64 - FILTER_BITS_LOG2)


def _bits_of(keys: DataFrame, mixed: Column) -> np.ndarray:
    """A bit for each value of a mixed long; of a fixed size. Combined before the shuffle."""
    cells = keys.select(_bit(mixed).alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(1 << (FILTER_BITS_LOG2 - 6), np.uint64)
    for r in cells.collect():  # at most one for each 64 bits
        out[r["cell"]] = np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _is_set(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.view(np.uint64)
    return ((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _only_wanted(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose node may be among ``keys``."""
    mixed = F.xxhash64("node")
    shared = nodes.sparkSession.sparkContext.broadcast(_bits_of(keys, mixed))
    marked = nodes.withColumn("bit", _bit(mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_is_set(shared.value, batch.column(batch.num_columns - 1).to_numpy())))

    return marked.mapInArrow(run, marked.schema).drop("bit")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Drop the pairs (src, dst) whose range counts rule the overlap out."""
    some = staged(_only_wanted(nodes.select("node", "n", "ranges"), _ends(pairs)), "ranges")
    a = some.select(F.col("node").alias("src"), F.col("n").alias("n1"), F.col("ranges").alias("r1"))
    b = some.select(F.col("node").alias("dst"), F.col("n").alias("n2"), F.col("ranges").alias("r2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for n, m, r, s in zip(c["n1"].to_pylist(), c["n2"].to_pylist(), c["r1"], c["r2"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (r, s))
                keep.append(overlap_bound(x, y) >= needed_overlap(n, m, percent))
            yield pa.RecordBatch.from_arrays([c["src"], c["dst"]], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    out = staged(pairs.join(b, "dst").join(a, "src").mapInArrow(run, "src long, dst long"), "likely")
    discard(some)
    return out


def _texts_of(docs: DataFrame, keys: DataFrame, text: str, gram: int, marks: bool = False) -> DataFrame:
    """node, text for the nodes of ``keys`` (node, k1, k2): one of the texts that have the node's set. With ``marks``, the upper
    16 bits of its sorted gram hashes instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits_of(keys, F.col("k1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                sets = gram_sets(data, offsets, gram)
                one, two = set_keys(sets)
                keep = []
                for i in np.flatnonzero(_is_set(shared.value, one.view(np.uint64) >> np.uint64(64 - FILTER_BITS_LOG2))).tolist():
                    key = (int(one[i]), int(two[i]))
                    if key not in seen:
                        seen.add(key)
                        keep.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if keep:
                    if marks:
                        body = pa.array([(sets[i] >> np.uint64(48)).astype(np.uint16).tobytes() for i in keep], pa.binary())
                    else:
                        body = batch.column(0).slice(lo, hi - lo).take(pa.array(keep)).fill_null("").cast(pa.string())
                    yield pa.RecordBatch.from_pydict({"k1": one[keep], "k2": two[keep], "body": body})
        give_back()

    found = docs.select(text).mapInArrow(run, f"k1 long, k2 long, body {'binary' if marks else 'string'}")
    # Copies have equal sets though not equal texts; any one will do.
    return found.join(keys, ["k1", "k2"]).groupBy("node").agg(F.min("body").alias("marks" if marks else "text"))


def _common_marks(a: np.ndarray | None, b: np.ndarray | None, most: int) -> int:
    """At most so many grams are common to two sets, by their marks (too many where grams share 16 bits); ``most`` without."""
    if a is None or b is None:
        return most
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _few_ranges(nodes: DataFrame) -> DataFrame:
    """node, marks (null) and ranges of ``nodes``, folded to MARKED ranges at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                r = np.frombuffer(x.as_buffer(), np.uint8)
                sums = r.reshape(MARKED, -1).sum(1, dtype=np.int64) if len(r) > MARKED else r
                out.append((sums.astype(np.uint8) if sums.max() <= 255 else np.full(len(sums), 255, np.uint8)).tobytes())
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "marks": pa.nulls(len(out), pa.binary()), "ranges": pa.array(out, pa.binary())})

    return nodes.select("node", "ranges").mapInArrow(run, "node long, marks binary, ranges binary")


def _marks_and_ranges(marks: list[bytes | None], ranges: list[bytes | None]) -> tuple[list, list]:
    """Arrays of both; a set with marks gets its ranges from them."""
    own = [None if m is None else np.frombuffer(m, np.uint16) for m in marks]
    return own, [np.frombuffer(r, np.uint8) if m is None else range_counts(m.astype(np.uint64) << np.uint64(48)) for m, r in zip(own, ranges)]


def _word_grams(text: str, gram: int) -> set[tuple[bytes, ...]]:
    w = text.encode().lower().split()  # A to Z only, and the breaks of words exactly
    return set(zip(*(w[k:] for k in range(gram)))) if len(w) >= gram else {tuple(w)} if w else set()


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, gram: int, percent: int) -> DataFrame:
    """The pairs that link, by the sets of their texts: first by hashes, then word by word."""
    keys = staged(_only_wanted(nodes.select("node", "k1", "k2"), _ends(pairs)).join(_ends(pairs), "node"), "wanted")
    texts = staged(_texts_of(docs, keys, text, gram), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams, exact = None, np.zeros(0, np.uint64), None
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            src, keep = c["src"].to_pylist(), []
            for lo, hi, data, offsets in text_chunks(c["t2"]):
                for i, other in zip(range(lo, hi), gram_sets(data, offsets, gram)):
                    if src[i] != last:
                        (_, _, own, cut) = next(text_chunks(c["t1"].slice(i, 1)))
                        last, grams, exact = src[i], gram_sets(own, cut, gram)[0], None
                    n, m = len(grams), len(other)
                    common = int((grams[np.minimum(np.searchsorted(grams, other), n - 1)] == other).sum()) if n and m else 0
                    ok = n > 0 and m > 0 and 100 * common >= percent * (n + m - common)
                    if ok:
                        exact = exact or _word_grams(c["t1"][i].as_py(), gram)
                        theirs = _word_grams(c["t2"][i].as_py(), gram)
                        ok = 100 * len(exact & theirs) >= percent * len(exact | theirs)
                    keep.append(ok)
            yield pa.RecordBatch.from_arrays([c["src"], c["dst"]], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    a, b = texts.select(F.col("node").alias("src"), F.col("text").alias("t1")), texts.select(F.col("node").alias("dst"), F.col("text").alias("t2"))
    out = staged(pairs.join(b, "dst").join(a, "src").select("src", "dst", "t1", "t2").mapInArrow(run, "src long, dst long"), "links")
    discard(keys, texts)
    return out


_GROUPED = ("gram", "salt", "salts", "node", "n", "place", "rank")
_LED = "gram long, salt int, salts int, node long, n long, place int, rank double, lead long, lead_n long, lead_place int"


def _led(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (_GROUPED) that are not alone in their group of gram and salt, or whose gram has several salts, each
    with the group's leader: the highest rank, of equal ones the least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before the batch, held back until it is known whether its group goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(_GROUPED)}
            at = np.arange(batch.num_rows)
            same = np.zeros(len(at), bool)
            same[1:] = (c["gram"][1:] == c["gram"][:-1]) & (c["salt"][1:] == c["salt"][:-1])
            lead = np.maximum.accumulate(np.where(same, 0, at))
            c |= {"lead": c["node"][lead], "lead_n": c["n"][lead], "lead_place": c["place"][lead]}
            if last is not None:
                if last["gram"][0] == c["gram"][0] and last["salt"][0] == c["salt"][0]:
                    first = lead == 0  # the group began before
                    for k in ("lead", "lead_n", "lead_place"):
                        c[k] = np.where(first, last[k][0], c[k])
                    same[0] = True
                c = {k: np.concatenate([last[k], v]) for k, v in c.items()}
                same = np.concatenate([last["same"], same])
            go_on = np.append(same[1:], False)
            keep = (same | go_on | (c["salts"] > 1))[:-1]
            if keep.any():
                yield pa.RecordBatch.from_pydict({k: v[:-1][keep] for k, v in c.items()})
            last = {k: v[-1:].copy() for k, v in c.items()} | {"same": same[-1:]}
        if last is not None and (last.pop("same")[0] or last["salts"][0] > 1):
            yield pa.RecordBatch.from_pydict(last)

    dealt = rows.select(*_GROUPED).repartition("gram", "salt").sortWithinPartitions("gram", "salt", F.desc("rank"), "node")
    return dealt.mapInArrow(run, _LED)


def _candidates(led: DataFrame, percent: int) -> DataFrame:
    ok = _filters(F.col("n"), F.col("lead_n"), F.col("place"), F.col("lead_place"), percent) & (F.col("node") != F.col("lead"))
    return led.filter(ok).select(F.least("node", "lead").alias("src"), F.greatest("node", "lead").alias("dst"))


def _block_candidates(ask: dict, base: dict, percent: int) -> tuple[list[int], list[int]]:
    """Nodes of ``ask`` with those of ``base`` that pass the length and suffix filters, last by their marks, and have another label.

    Range counts of one size form a matrix; a query looks at the matrices of its own size and, folded, of the
    neighbouring ones, as sets within the length filter differ by one doubling at most.
    """
    src, dst = [], []
    level = np.array([len(c) for c in base["ranges"]])
    stacks = {int(k): (np.flatnonzero(level == k), np.stack([base["ranges"][i] for i in np.flatnonzero(level == k)]).astype(np.int32)) for k in np.unique(level)}
    for k, (rows, matrix) in list(stacks.items()):
        by = np.argsort(base["n"][rows], kind="stable")
        stacks[k] = rows[by], matrix[by]
    for node, n, label, own, mark in zip(ask["node"].tolist(), ask["n"].tolist(), ask["label"].tolist(), ask["ranges"], ask["marks"]):
        own = own.astype(np.int32)
        for k in (len(own) // 2, len(own), 2 * len(own)):
            if k not in stacks:
                continue
            rows, matrix = stacks[k]
            m = base["n"][rows]
            lo, hi = np.searchsorted(m, -(-percent * n // 100)), np.searchsorted(m, 100 * n // percent, side="right")
            near = np.flatnonzero(base["label"][rows[lo:hi]] != label) + lo
            if not len(near):
                continue
            size = min(k, len(own))
            theirs, mine = matrix[near].reshape(len(near), size, -1).sum(2), own.reshape(size, -1).sum(1)
            bound = np.minimum(theirs, mine).sum(1)
            for j in rows[near[(100 + percent) * bound >= percent * (n + m[near])]].tolist():
                other = int(base["node"][j])
                need = needed_overlap(n, int(base["n"][j]), percent)
                if _common_marks(mark, base["marks"][j], need) >= need:
                    src.append(min(node, other))
                    dst.append(max(node, other))
    return src, dst


def _open_block_pairs(grams: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, gram: int, percent: int) -> DataFrame:
    """Candidates (src, dst) of different components from the groups of ``grams`` (gram, node, n, label) that are still open.

    Two nodes of one group have been compared, so only groups of three and more matter. Grams with the same nodes,
    told by 128 bits, are one group. The nodes outside the group's main component are dealt to blocks; each block is
    held against the whole group, itself in blocks.
    """
    marks = [F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(s)), 24)).alias(f"mark_{s}") for s in (7, 8)]
    stats = grams.groupBy("gram").agg(F.min_by("label", F.xxhash64("node", F.lit(2))).alias("main"), F.min("label").alias("one"), F.max("label").alias("two"), F.count("*").alias("size"), *marks)
    stats = stats.filter("size > 2 and one != two")
    open_ = staged(stats.groupBy("size", "mark_7", "mark_8").agg(F.min("gram").alias("gram"), F.min_by("main", "gram").alias("main")), "open-groups")
    rows = staged(grams.join(open_.select("gram", "main", "size"), "gram").withColumn("query", F.col("label") != F.col("main")), "open-grams")
    some = staged(_only_wanted(nodes.select("node", "k1", "k2", "n", "ranges"), rows.select("node")), "wanted")
    marks = _texts_of(docs, some.filter(F.col("n") <= MARKED).select("node", "k1", "k2"), text, gram, marks=True)
    counts = staged(marks.withColumn("ranges", F.lit(None).cast("binary")).unionByName(_few_ranges(some.filter(F.col("n") > MARKED))), "marks")
    small = rows.filter(F.col("size") <= SMALL_GROUP).join(counts, "node").select("gram", "node", "n", "label", "marks", "ranges")
    large = rows.filter(F.col("size") > SMALL_GROUP)
    blocks = staged(large.groupBy("gram").agg(F.ceil(F.count_if("query") / QUERY_BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias("salts")), "blocks")
    rows = large.join(blocks.filter("blocks > 0"), "gram").join(counts, "node")
    mixed = F.xxhash64("node", F.lit(5))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.pmod(mixed, F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.pmod(mixed, F.col("blocks")).cast("int").alias("block"), s.alias("salt"), F.lit(True).alias("asks")))
    dealt = rows.select("gram", "node", "n", "label", "marks", "ranges", F.explode(F.when(F.col("query"), F.concat(every, asks)).otherwise(every)).alias("p")).select("*", "p.*").drop("p")

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy() for c in ("node", "n", "label")}
        marks, ranges = _marks_and_ranges(t.column("marks").to_pylist(), t.column("ranges").to_pylist())
        asks = t.column("asks").to_numpy()

        def part(at: np.ndarray) -> dict:
            return {c: v[at] for c, v in cols.items()} | {"ranges": [ranges[i] for i in at], "marks": [marks[i] for i in at]}

        base = np.flatnonzero(~asks)
        src, dst = _block_candidates(part(np.flatnonzero(asks)), part(base), percent) if len(base) else ([], [])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    large = dealt.groupBy("gram", "block", "salt").applyInArrow(run, "src long, dst long")
    return _small_group_pairs(small, percent).unionByName(large).distinct()


def _folded(ranges: np.ndarray, size: int) -> np.ndarray:
    """Range counts over ``size`` ranges; sets with fewer ranges are not told apart here."""
    return ranges.reshape(size, -1).sum(1, dtype=np.int32) if len(ranges) >= size else np.zeros(size, np.int32)


def _tier(ranges: list[np.ndarray], size: int) -> np.ndarray:
    """Folded range counts, a row for each set, in 16 bits where they fit."""
    out = np.stack([_folded(r, size) for r in ranges])
    return out.astype(np.int16) if out.max() <= np.iinfo(np.int16).max else out


def _small_group_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates of groups of at most SMALL_GROUP nodes: many groups at once, pair by pair in arrays."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        gram, node, n, label = (table.column(c).to_numpy() for c in ("gram", "node", "n", "label"))
        kinds, at = np.unique(node, return_index=True)
        place = np.searchsorted(kinds, node)
        marks, ranges = _marks_and_ranges(*(table.column(c).take(pa.array(at)).to_pylist() for c in ("marks", "ranges")))
        size = np.array([len(r) for r in ranges])
        tiers = [(k, _tier(ranges, k)) for k in TIERS]
        ends = np.searchsorted(gram, gram, side="right")
        count = ends - np.arange(len(gram)) - 1
        src, dst, lo = [], [], 0
        upto = np.cumsum(count)
        while lo < len(gram):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            i = np.repeat(np.arange(lo, hi), count[lo:hi])
            j = all_ranges(np.arange(lo, hi) + 1, count[lo:hi])
            ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            pair = np.unique(np.minimum(place[i[ok]], place[j[ok]]) * len(kinds) + np.maximum(place[i[ok]], place[j[ok]]))
            a, b = pair // len(kinds), pair % len(kinds)
            need = -(-percent * (n[at[a]] + n[at[b]]) // (100 + percent))
            for width, counts in tiers:
                fits = (size[a] < width) | (size[b] < width)
                for k in range(0, len(a), 1 << 13):
                    part = slice(k, k + (1 << 13))
                    fits[part] |= np.minimum(counts[a[part]], counts[b[part]]).sum(1, dtype=np.int64) >= need[part]
                a, b, need = a[fits], b[fits], need[fits]
            fits = slice(None)
            for x, y, m in zip(a[fits].tolist(), b[fits].tolist(), need[fits].tolist()):
                if overlap_bound(ranges[x], ranges[y]) >= m and _common_marks(marks[x], marks[y], m) >= m:
                    src.append(int(kinds[x]))
                    dst.append(int(kinds[y]))
            lo = hi
        return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                whole = pa.Table.from_batches(held).combine_chunks()
                gram = whole.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
                if cut:
                    yield settle(whole.slice(0, cut))
                rest = whole.slice(cut)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield settle(pa.Table.from_batches(held).combine_chunks())
        give_back()

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` without its text but with n_shingles, component_id (the least id in reach) and group (a long that the rows of
    a component share; null without words)."""
    small_batches(docs.sparkSession)
    out = ("n_shingles", "component_id", "group")
    kept = [c for c in docs.columns if c not in (text, *out)]
    texts = docs.select(F.struct(F.col(id_column).alias("id"), F.struct(*kept).alias("own")).alias("row"), F.col(text).alias("text"))
    rows = staged(described(texts, "text", gram, percent), "gram-sets")
    sets = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min("row.id").alias("low"), F.first(F.when(F.col("prefix").isNotNull(), F.struct(F.col("n_shingles").alias("n"), "rank", "prefix", "salts", "ranges")), ignorenulls=True).alias("set")
    )
    nodes = staged(sets.select("k1", "k2", "low", "set.*").withColumn("node", F.monotonically_increasing_id()), "gram-nodes")  # written, so ids stay
    narrow = staged(rows.select("row", "n_shingles", "k1", "k2"), "gram-rows")
    discard(rows)
    postings = nodes.select("node", "n", "rank", F.posexplode(F.arrays_zip("prefix", "salts")).alias("place", "p"))
    postings = postings.select("node", "n", "rank", "place", F.col("p.prefix").alias("gram"), F.col("p.salts").alias("salts"))
    postings = postings.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts")).cast("int"))
    shared = staged(_led(postings), "shared-grams")
    tops = shared.filter("salts > 1 and node = lead").withColumn("salt", F.lit(0)).withColumn("salts", F.lit(1))
    settled = staged(_candidates(shared, percent).unionByName(_candidates(_led(tops), percent)).distinct(), "candidates")
    likely = _suffix_filter(settled, nodes, percent)
    links = _verify(likely, nodes, texts, "text", gram, percent)
    labels = connected_components(links)
    own = staged(shared.select("gram", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-grams")
    discard(shared, likely)
    more = _open_block_pairs(own, nodes, texts, "text", gram, percent).join(settled, ["src", "dst"], "left_anti")
    more = _verify(staged(more, "candidates"), nodes, texts, "text", gram, percent)
    discard(own, settled)
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))

    named = nodes.select("k1", "k2", "node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = staged(named.join(least, "label").select(F.col("k1"), F.col("k2"), F.col("label").alias("group"), "component_id"), "gram-groups")
    discard(nodes)
    some = narrow.filter("n_shingles > 0").join(named, ["k1", "k2"]).select("row", "n_shingles", "component_id", "group")
    none = narrow.filter("n_shingles = 0").select("row", "n_shingles", F.col("row.id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return some.unionByName(none).select("row.own.*", *out)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", "n_shingles", "component_id")
