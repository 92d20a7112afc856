"""Byte-level BPE over whole texts: boundaries by an associative scan of transition functions, then cached merging.

A pre-token boundary depends on a small state machine over code-point classes. Each symbol is a
transition function; functions compose associatively, so blocks are composed independently, chained,
and replayed, all as numpy array steps without a regular expression. The byte slices between
boundaries go through a bounded cache of merged pieces. Token offsets (byte ends) are kept, so ids can
be decoded whole or by byte range.

Defined results: null counts as an empty text with no tokens; repeated rows are encoded alike; of pairs with one rank, and of equal
merges, the leftmost goes first, as in the library; texts of any length are encoded whole, a very long one in a chunk of its own; empty
tables give empty tables; columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import small_batches, table
from .textops import code_points_before, give_back, list_array, offsets32, ranges, same_bytes, schema_with, slice_hash, text_chunks, with_columns

#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a contraction.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: the four classes split by what a boundary needs to know of the next code points.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANKS, S_LAST_BLANK, S_LAST_SPACE, S_PAD = range(9)
# States: the kind of piece in progress. Q_SHORT and Q_LONG stand after the apostrophe of a contraction.
Q_LETTERS, Q_NUMBERS, Q_OTHERS, Q_BLANKS, Q_GLUE, Q_SHORT, Q_LONG, Q_CLOSED = range(8)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", by symbol and state."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for q in range(8):
        step[S_LETTER, q] = Q_LETTERS
        step[S_NUMBER, q] = Q_NUMBERS
        step[S_OTHER, q] = Q_OTHERS
        step[S_SHORT, q] = Q_OTHERS if q in (Q_OTHERS, Q_GLUE) else Q_SHORT
        step[S_LONG, q] = Q_OTHERS if q in (Q_OTHERS, Q_GLUE) else Q_LONG
        step[S_BLANKS, q] = Q_BLANKS
        step[S_LAST_BLANK, q] = Q_CLOSED
        step[S_LAST_SPACE, q] = Q_GLUE
        step[S_PAD, q] = Q_CLOSED
    step[S_LETTER, Q_SHORT] = Q_CLOSED
    step[S_LETTER, Q_LONG] = Q_SHORT
    for symbol, same in ((S_LETTER, (Q_LETTERS, Q_GLUE, Q_SHORT, Q_LONG)), (S_NUMBER, (Q_NUMBERS, Q_GLUE)), (S_BLANKS, (Q_BLANKS,))):
        begins[symbol, list(same)] = False
    for symbol in (S_OTHER, S_SHORT, S_LONG):
        begins[symbol, [Q_OTHERS, Q_GLUE]] = False
    return step, begins


STEP, BEGINS = _machine()


def scan_states(symbols: np.ndarray, step: np.ndarray, start: int, block: int = 256) -> np.ndarray:
    """The state before each symbol, by composing blocks of transition functions and replaying them."""
    n, q = len(symbols), step.shape[1]
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.intp)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T) * q
    flat = step.astype(np.intp).ravel()
    maps = np.repeat(np.arange(q, dtype=np.intp)[:, None], rows, 1)
    for line in grid:  # all blocks at once, from every state
        maps = flat.take(maps + line)
    entry, state = np.empty(rows, np.intp), start
    for r, f in enumerate(maps.T.tolist()):
        entry[r] = state
        state = f[state]
    out = np.empty((block, rows), np.uint8)
    for j, line in enumerate(grid):
        out[j] = entry
        entry = flat.take(entry + line)
    return out.T.ravel()[:n]


def piece_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indices at which pieces begin; ``edges`` are the indices at which texts begin."""
    n = len(points)
    kind = code_point_classes()[points]
    first = np.zeros(n + 3, bool)
    first[edges] = True
    first[n:] = True
    nxt = np.zeros(n + 3, np.uint32)
    nxt[:n] = points
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_LAST_BLANK], np.uint8)[kind]
    blank = kind == SPACE
    symbol[blank & (points == 32)] = S_LAST_SPACE
    follows = np.ones(n, bool)  # a blank or the text's end comes next
    follows[:-1] = blank[1:]
    follows |= first[1 : n + 1]
    symbol[blank & follows] = S_BLANKS
    at = np.flatnonzero(points == 39)
    if len(at):
        a, b, one, two = nxt[at + 1], nxt[at + 2], ~first[at + 1], ~first[at + 1] & ~first[at + 2]
        symbol[at[one & np.isin(a, [ord(c) for c in SHORT_ENDINGS])]] = S_SHORT
        for x, y in LONG_ENDINGS:
            symbol[at[two & (a == ord(x)) & (b == ord(y))]] = S_LONG
    # Every text but the first is preceded by a symbol that closes all pieces, so none crosses texts.
    inner = edges[1:]
    shifted = np.arange(n) + np.searchsorted(inner, np.arange(n), side="right") if len(inner) else np.arange(n)
    padded = np.full(n + len(inner), S_PAD, np.uint8)
    padded[shifted] = symbol
    before = scan_states(padded, STEP, Q_CLOSED)[shifted]
    return np.flatnonzero(BEGINS[symbol, before])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: adjacent parts of the lowest joint rank merge first, the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = ranks.get(piece[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0:
            r = ranks.get(piece[prv[i] : stop])
            if r is not None:
                heapq.heappush(heap, (r, prv[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


#: Ids that are decoded at once, rounded to whole rows.
DECODE_IDS = 1 << 20
#: Text that is worked on at once; a longer text is still taken whole.
CHUNK_BYTES = 1 << 19
#: Pieces of up to so many bytes are merged together as rows of a matrix, longer ones one at a time.
ROW_BYTES = (8, 16, 32)
NO_RANK = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """Open-addressed table from two adjacent ids to the id of their joint bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, joint = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.bits = max(8, int(4 * len(left) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys, at = (left << 32) | right, self._home(left, right)
        while len(keys):  # of those that want one free place the first gets it, the rest move on
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], joint[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, joint, at = keys[rest], joint[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = ((left << 32) | right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = left.astype(np.int64), right.astype(np.int64)
        out = np.full(left.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        left, right = left.ravel()[todo], right.ravel()[todo]
        keys, at, flat = (left << 32) | right, self._home(left, right), out.ravel()
        while len(todo):
            here = self.keys[at]
            hit = here == keys
            flat[todo[hit]] = self.values[at[hit]]
            on = ~hit & (here >= 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


def merge_rows(tokens: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One merge in every row at a time until none is left; -1 pads."""
    tokens = tokens.copy()
    rows, joint = np.arange(len(tokens)), pairs.get(tokens[:, :-1], tokens[:, 1:])
    work, columns = tokens, np.arange(tokens.shape[1])
    while True:
        m = joint.argmin(1)
        best = joint[np.arange(len(m)), m]
        on = best < NO_RANK
        if not on.all():
            tokens[rows[~on]] = work[~on]
            rows, work, joint, m, best = rows[on], work[on], joint[on], m[on], best[on]
        if not len(rows):
            return tokens
        k, later = np.arange(len(m)), columns[None, :] > m[:, None]
        moved = np.concatenate([work[:, 1:], np.full((len(m), 1), -1, work.dtype)], 1)
        work = np.where(later, moved, work)
        work[k, m] = best
        moved = np.concatenate([joint[:, 1:], np.full((len(m), 1), NO_RANK, joint.dtype)], 1)
        joint = np.where(later[:, :-1], moved, joint)
        last = joint.shape[1] - 1
        inside = m <= last
        joint[k[inside], m[inside]] = pairs.get(work[k[inside], m[inside]], work[k[inside], m[inside] + 1])
        inside = m > 0
        joint[k[inside], m[inside] - 1] = pairs.get(work[k[inside], m[inside] - 1], work[k[inside], m[inside]])


class PieceCache(dict):
    """Piece to its slot; slots hold ids one after the other. Emptied when full, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        super().__init__()
        self.ranks, self.most, self.pairs = ranks, most, PairTable(ranks)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.ends, self.slots, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def learn(self, pieces: list[bytes]) -> None:
        """Merge pieces that the cache does not hold, all distinct."""
        whole = [p for p in pieces if p in self.ranks]
        self._keep(whole, np.array([self.ranks[p] for p in whole], np.int32), np.ones(len(whole), np.int64))
        rest = [p for p in pieces if p not in self.ranks]
        low = 0
        for width in ROW_BYTES:
            group = [p for p in rest if low < len(p) <= width]
            low = width
            if group:
                size = np.fromiter(map(len, group), np.int64, len(group))
                tokens = np.full((len(group), width), -1, np.int32)
                inside = np.arange(width)[None, :] < size[:, None]
                tokens[inside] = self.byte_ids[np.frombuffer(b"".join(group), np.uint8)]
                tokens = merge_rows(tokens, self.pairs)
                self._keep(group, tokens[tokens >= 0], (tokens >= 0).sum(1))
        for p in rest:
            if len(p) > low:
                ids = merge_pairs(p, self.ranks)
                self._keep([p], np.array(ids, np.int32), np.array([len(ids)], np.int64))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.slots + 1 : self.slots + 1 + len(pieces)] = self.used + np.cumsum(counts)
        self.update(zip(pieces, range(self.slots, self.slots + len(pieces))))
        self.used += len(ids)
        self.slots += len(pieces)


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct slice, and the position of each slice's own. Found by hash, confirmed on the bytes."""
    _, kinds, inverse = np.unique(slice_hash(data, starts, ends, 1), return_index=True, return_inverse=True)
    first, size = kinds[inverse], ends - starts
    if (size != size[first]).any() or not same_bytes(data, starts, starts[first], size):  # two slices share a hash
        return np.arange(len(starts)), np.arange(len(starts))
    return kinds, inverse


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.cache = PieceCache(ranks)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids per text, and each id's byte end within its text."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(texts, np.int64), np.zeros(0, np.int32)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = code_points_before(data)[offsets]
        starts = piece_starts(points, np.unique(edges[:-1][offsets[1:] > offsets[:-1]]))
        at = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        cache = self.cache
        if len(cache) > cache.most:
            cache.reset()
        stops = np.append(at[1:], len(raw))
        kinds, inverse = distinct_slices(data, at, stops)
        pieces = [raw[a:b] for a, b in zip(at[kinds].tolist(), stops[kinds].tolist())]
        if new := list(dict.fromkeys(p for p in pieces if p not in cache)):
            cache.learn(new)
        slots = np.fromiter(map(cache.__getitem__, pieces), np.int64, len(pieces))[inverse]
        first = cache.ends
        n = first[slots + 1] - first[slots]
        ids = cache.ids[ranges(first[slots], n)]
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, offsets)]
        counts = np.diff(upto)
        ends = np.cumsum(self.lengths[ids]) - np.repeat(offsets[:-1], counts)
        return ids, counts, ends.astype(np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and bytes per id."""
        n = self.lengths[ids]
        return self.bytes[ranges(self.firsts[ids], n)], n


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, ranks_path: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with token_ids and token_ends (each id's byte end in the text), arrays of int."""
    small_batches(docs.sparkSession)
    fields = [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in ("token_ids", "token_ends")]
    drop = (text,) if drop_text else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text)), CHUNK_BYTES):
                ids, counts, ends = c.encode(data, offsets)
                new = {"token_ids": list_array(ids, counts, pa.int32()), "token_ends": list_array(ends, counts, pa.int32())}
                yield with_columns(batch.slice(lo, hi - lo), new, drop)
        c.cache.reset()  # the worker may serve other operators next
        give_back()

    return docs.mapInArrow(run, schema_with(docs, fields, drop))


def decode(encoded: DataFrame, ranks_path: str, drop_ids: bool = False) -> DataFrame:
    """``encoded`` with decoded (binary), the bytes of token_ids; null ids give empty bytes."""
    small_batches(encoded.sparkSession)
    drop = ("token_ids", "token_ends") if drop_ids else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("token_ids"))
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(counts)])
            lo = 0
            while lo < batch.num_rows:  # so many rows as have about DECODE_IDS ids
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + DECODE_IDS, side="right")) - 1)
                body, n = c.decode(column.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
                sizes = np.diff(np.concatenate([[0], np.cumsum(n)])[upto[lo : hi + 1] - upto[lo]])
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets32(sizes)), pa.py_buffer(body.tobytes())])
                yield with_columns(batch.slice(lo, hi - lo), {"decoded": out}, drop)
                lo = hi

    return encoded.mapInArrow(run, schema_with(encoded, [T.StructField("decoded", T.BinaryType())], drop))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_byte_bpe(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    path = ranks_path or default_ranks()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = encode(docs, path, drop_text=True).select("doc_id", "token_ids")
    return decode(tokens, path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
