"""Repeated byte strings from Burrows-Wheeler transforms of shards, merged by refining their interleaving.

Each shard sorts its own suffixes once. The merge starts with the shards dealt by the first HEAD bytes of their rows, which a number holds, and, in each
round, deals the rows into the buckets of the byte before them: after h rounds the rows stand in
order of their first h bytes, and a border between rows that appears in round h has a common prefix of
h - 1 bytes. After ``width`` rounds the rows between borders are the occurrences of one string. The rows of a shard keep
their order, so all that is dealt is which shard a row is of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm import segments
from tendril.llm.common import gather, text_buffer

WIDTH, GRAM = 50, 32
#: Bytes of a shard, and of all shards that are merged at once.
SHARD, MERGE = 1 << 18, 1 << 22
#: Bytes that are compared at once.
HEAD = 8


def heads(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first HEAD bytes of each suffix as one number, zeros from its terminator on; whether a terminator is among them)."""
    code, whole, span = text.astype(np.uint64), text != 0, 1
    while span < HEAD:
        ahead = np.where(whole[:-span], code[span:], 0) if span < len(text) else code[:0]
        code <<= np.uint64(8 * span)
        code[: len(ahead)] |= ahead
        whole[: len(ahead)] &= whole[span:]
        whole[len(ahead) :] = False
        span *= 2
    return code, ~whole


def suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by doubling. Terminators (below all bytes, in text order) are distinct, so ties end there."""
    n = len(text)
    rank = np.empty(n, np.int64)
    if text.dtype == np.uint8:
        code, ended = heads(text)
        order = np.argsort(code, kind="stable")
        new = ended[order]
        new[1:] |= code[order[1:]] != code[order[:-1]]
        new[:1] = True
        rank[order] = np.cumsum(new) - 1
        span = HEAD
    else:
        stops = text == 0
        rank[:] = text.astype(np.int64) + int(stops.sum())
        rank[stops] = np.arange(int(stops.sum()))
        span, new = 1, np.zeros(1, bool)
    while not new.all() and span <= longest:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        code = rank * (int(rank.max()) + 2) + after
        order = np.argsort(code)  # equal codes stand in any order until a later round tells them apart
        new = np.ones(n, bool)
        new[1:] = code[order[1:]] != code[order[:-1]]
        rank[order] = np.cumsum(new) - 1
        span *= 2
    return order


class Shard:
    """Suffix array and transform of segments, each ended by a terminator, and the heads of the rows."""

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, segs: np.ndarray):
        lengths = sizes[segs] + 1
        text = np.zeros(int(lengths.sum()), np.uint8 if symbols.max(initial=0) < 255 else np.uint32)
        ends = np.cumsum(lengths)
        body = np.ones(len(text), bool)
        body[ends - 1] = False
        at = gather(begins[segs], sizes[segs])
        text[body] = symbols[at] + 1
        self.place = np.full(len(text), -1, np.int64)  # of the symbol in the chunk
        self.place[body] = at
        self.array = suffixes(text, int(lengths.max()))
        before = text[self.array - 1]
        before[np.isin(self.array, ends - lengths, assume_unique=True)] = 0  # the start of a segment follows a terminator
        self.before, self.stops = before, len(segs)
        self.head = self.ended = None
        if text.dtype == np.uint8:
            self.head, self.ended = (x[self.array] for x in heads(text))


def merged(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all shards in order, common prefix of each with the row before, capped at ``width``)."""
    before = np.concatenate([s.before for s in shards])
    m, n = sum(s.stops for s in shards), len(before)
    numbers = np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.int32)
    owner = np.concatenate([np.repeat(numbers, [s.stops for s in shards]), np.repeat(numbers, [len(s.before) - s.stops for s in shards])])
    prefix = np.full(n, width, np.uint8)
    prefix[0] = 0
    border = np.zeros(n, bool)
    border[0] = True  # nothing is known before the first round; a terminator behind a window must not divide it
    done = 0
    if all(s.head is not None for s in shards) and width >= HEAD:
        head = np.concatenate([s.head for s in shards])
        order = np.argsort(head, kind="stable")
        head, ended = head[order], np.concatenate([s.ended for s in shards])[order]
        owner = np.repeat(numbers, [len(s.before) for s in shards])[order]
        common = np.zeros(n, np.uint8)
        other = head[1:] ^ head[:-1]
        for k in range(1, HEAD + 1):
            # Equal heads with a terminator agree up to it: behind it stand zeros.
            common[1:] += (other >> np.uint64(64 - 8 * k) == 0) & ((head[1:] >> np.uint64(64 - 8 * k)) & np.uint64(255) != 0)
        border[1:] = (other != 0) | ended[1:]
        prefix[border] = common[border]
        done = HEAD
    dealt = np.sort(before, kind="stable")[m:]  # every round deals the same bytes
    change = dealt[1:] != dealt[:-1]
    new = np.ones(n, bool)
    symbol, block, over = np.empty(n, before.dtype), np.empty(n, np.int32), np.empty(n - m, np.int32)
    for h in range(done + 1, width + 1):
        for k, s in enumerate(shards):
            symbol[owner == k] = s.before
        np.cumsum(border, dtype=np.int32, out=block)
        source = np.argsort(symbol, kind="stable")[m:]  # rows before a terminator keep their place
        np.take(block, source, out=over, mode="clip")
        owner = np.concatenate([np.repeat(numbers, [s.stops for s in shards]), owner[source]])
        new[m + 1 :] = (over[1:] != over[:-1]) | change
        prefix[new > border] = h - 1
        border |= new
    rows = np.empty(n, np.int64)
    rows[np.argsort(owner, kind="stable")] = np.arange(n)
    return rows, prefix


def first_of_equal(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, count: np.ndarray, rank: np.ndarray, width: int = WIDTH, shard: int = SHARD, merge: int = MERGE) -> np.ndarray:
    """For each window the least ``rank`` of an equal one (a kernel of ``segments.resolve``)."""
    window = np.full(len(symbols), -1, np.int64)
    window[gather(begins, count)] = np.arange(len(rank))
    group = np.cumsum(sizes) // shard
    shards = [Shard(symbols, begins, sizes, s) for s in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1)]
    first = rank.copy()
    batch = max(1, merge // 2 // shard)
    parts = [shards[i : i + batch] for i in range(0, len(shards), batch)]
    # All at once if they fit; the segments of an anchor that do not fit meet pair by pair.
    rounds = [shards] if len(parts) <= 2 else [a + b for i, a in enumerate(parts) for b in parts[i + 1 :]]
    for some in rounds:
        rows, prefix = merged(some, width)
        at = window[np.concatenate([s.place[s.array] for s in some])[rows]]
        at[at < 0] = -1
        interval = np.flatnonzero(prefix < width)
        values = np.where(at >= 0, first[at], np.iinfo(np.int64).max)
        least = np.repeat(np.minimum.reduceat(values, interval), np.diff(np.append(interval, len(rows))))
        first[at[at >= 0]] = np.minimum(first[at[at >= 0]], least[at >= 0])
    return first


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that lie in a string
    of ``width`` bytes which also starts in a document with a smaller key.

    Strings are judged on the input. One row per row of ``docs``; null text is empty; a null key is greater than
    all others, and rows with equal keys do not remove each other's bytes.
    """
    scheme = segments.Scheme(width, GRAM, False)
    plain = segments.numbered(docs, key, text)

    def kernel(*chunk: np.ndarray) -> np.ndarray:
        return first_of_equal(*chunk, width=width)

    def kept(keys: pa.Array, texts: pa.Array, counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        data, offsets = text_buffer(texts)
        gone = segments.mask(len(data), offsets[:-1], counts, start, end)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offsets[offsets < len(data)]
        edge[inner] = gone[inner]
        sums = lambda x: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate([[0], np.cumsum(x)]))
        removed = sums(gone)
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
        left = pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(data[~gone].tobytes())])
        return pa.RecordBatch.from_arrays([keys, *(pa.array(np.asarray(x, np.int64)) for x in (np.diff(offsets), removed, sums(edge))), left], names=schema.names)

    schema = T.StructType([plain.schema["key"], *T.StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").fields])
    spans = segments.covered(plain, scheme, kernel, other_docs=True)
    return segments.without(plain, spans, kept, schema).withColumnRenamed("key", key)


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return deduplicate(docs, key).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
