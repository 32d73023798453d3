"""Array helpers shared by the operators: Arrow text buffers in bounded slices, rolling hashes, ragged gathers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one vectorised step handles; bounds a worker's memory whatever the batch.
SLICE = 1 << 20


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(total: int, size: int = SLICE) -> Iterator[tuple[int, int]]:
    for lo in range(0, total, size):
        yield lo, min(total, lo + size)


def row_groups(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose values have about ``size`` items together; a larger row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of a polynomial hash matters."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values (polynomial modulo 2**64, mixed)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, step, have, done, out = BASE, values.astype(np.uint64), 1, 0, None
    with np.errstate(over="ignore"):
        rest = length
        while True:
            if rest & 1:
                piece = step[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += have
            rest >>= 1
            if not rest:
                return mix(out)
            step = step[:-have] * power + step[have:]
            have, power = have * 2, power * power


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses a row bound."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(BASE)) -> np.ndarray:
    """64-bit hash of each byte range: differences of prefix hashes, shifted by inverse powers of the odd base."""
    n = len(data) + 1
    with np.errstate(over="ignore"):
        if base not in _powers or len(_powers[base][0]) < n:
            up, down = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, down = _powers[base]
        prefix = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts])


#: Longer byte ranges get a hash of their own each.
LONG = 256


def strong_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, mixed block by block: unlike a polynomial modulo 2**64 it has no texts that always collide."""
    n = len(starts)
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    if not n:
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    cover = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
    some = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    done = 0
    with np.errstate(over="ignore"):
        while len(some):
            block = eight[starts[some] + done] & cover[np.minimum(lengths[some] - done, 8)]
            h[some] = mix(h[some] * np.uint64(0x9FB21C651E98DF25) ^ block)
            done += 8
            some = some[lengths[some] > done]
    for i in np.flatnonzero(lengths > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = np.frombuffer(digest.digest(), np.uint64)[0]
    return h


def binaries(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary column of the byte ranges."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.ascontiguousarray(data[gather(starts, lengths)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def keep_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own; extra columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
