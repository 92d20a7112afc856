"""Numpy kernels over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The bytes that separate words, space and tab to carriage return.
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(WORD_BREAKS)] = True

_STEP = 0x9E3779B97F4A7C15
#: Longer slices are hashed one by one.
LONG_SLICE = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place (and the end) on as a number, the first lowest; zeros beyond the end. Unaligned view."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the slices, independent of where they stand: 8 bytes at a time go through a bijective mix,
    which is no polynomial, so words built to cancel in one do not collide. Long slices by BLAKE2b."""
    view = eights(data)
    left = (ends - starts).astype(np.int64)
    out = mix64(left.astype(np.uint64) * np.uint64(_STEP) + np.uint64(seed))
    for i in np.flatnonzero(left > LONG_SLICE).tolist():
        body = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=int(seed).to_bytes(8, "little"))
        out[i] = int.from_bytes(body.digest(), "little")
    live = np.flatnonzero((left > 0) & (left <= LONG_SLICE))
    at, left, h = starts[live], left[live], out[live]
    while len(live):
        h = mix64((h ^ (view[at] & _LOW_BYTES[np.minimum(left, 8)])) + np.uint64(_STEP))
        done = left <= 8
        out[live[done]] = h[done]
        more = ~done
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    return out


def window_hash(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of every ``length`` consecutive bytes, a multiple of 8."""
    view, n = eights(data), max(0, len(data) - length + 1)
    h = np.full(n, np.uint64(seed) + np.uint64(_STEP))
    for k in range(0, length, 8):
        h = mix64((h ^ view[k : k + n]) + np.uint64(_STEP))
    return h


def same_bytes(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether every slice equals the one of its length at the other place."""
    differ = np.flatnonzero(starts != others)
    for part in np.array_split(differ, max(1, int(lengths[differ].sum()) >> 20)):
        n = lengths[part]
        if (data[ranges(starts[part], n)] != data[ranges(others[part], n)]).any():
            return False
    return True


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, data, offsets)`` for runs of whole texts of about ``max_bytes``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        end = min(n, max(end, first + 1))
        lo, hi = int(offsets[first]), int(offsets[end])
        yield first, end, data[lo:hi], offsets[first : end + 1] - lo
        first = end


def spans_where(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true that cross no text: starts, ends, and each text's first run."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:n]
        stops[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word."""
    return spans_where(~IS_BREAK[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def offsets32(lengths: np.ndarray) -> np.ndarray:
    """Arrow offsets; callers hold batches far under 2**31 values, and a batch that is not raises instead of wrapping."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    if total[-1] >= 1 << 31:
        raise ValueError("more than 2**31 values in one batch")
    return total.astype(np.int32)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = offsets32(lengths)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` with columns replaced or added by name, in the order of ``extra``."""
    gone = {*extra, *drop}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in gone]
    pairs = [*kept, *extra.items()]
    return pa.RecordBatch.from_arrays([c for _, c in pairs], names=[n for n, _ in pairs])


def schema_with(df, extra, drop: tuple[str, ...] = ()):
    """The Spark schema that ``with_columns`` gives; ``extra`` is a list of StructFields."""
    from pyspark.sql import types as T

    gone = {f.name for f in extra} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in gone] + list(extra))


def give_back() -> None:
    """Return memory that a worker no longer uses to the system; workers outlive the tasks they serve."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
