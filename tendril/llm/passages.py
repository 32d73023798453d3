"""Repeated passages by FM-index: wavelet matrices over the Burrows-Wheeler transform of a shard's words.

Documents are streamed against the index of each shard that shares their anchors: from every place the
search goes backwards word by word, so the number of steps it survives is the longest match ending
there (capped at the threshold), and the places that reach the threshold are reported with their
interval of the suffix array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm import segments
from tendril.llm.common import gather, row_groups, text_buffer
from tendril.llm.substrings import Shard

WIDTH, GRAM = 20, 8
#: Words of a shard.
SHARD = 1 << 18


class Wavelets:
    """Ranks in a sequence of small numbers, in packed bits: one and a half bits for each bit of a number."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (values >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros(-(-(len(values) + 1) // 64) * 8, np.uint8)
            padded[: len(packed)] = packed
            word = padded.view(np.uint64)
            self.words.append(word)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1]]).astype(np.int32))
            order = np.argsort(bit.astype(np.uint8), kind="stable")
            self.zeros.append(len(values) - int(bit.sum()))
            values = values[order]
        every = np.arange(symbols)
        self.origin = self.descend(every, np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[level][word] + np.bitwise_count(self.words[level][word] & below)
            right = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(right == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self.descend(symbol, at) - self.origin[symbol]


class Index:
    """FM-index of a shard; symbol 0 ends a segment."""

    def __init__(self, shard: Shard, symbols: int):
        self.size = len(shard.before)
        before = shard.before.astype(np.int64)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=symbols))])
        self.wavelets = Wavelets(before, symbols)

    def statistics(self, text: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of ``text`` at ``ends``: length of the longest match that ends there, at most
        ``cap``, and the interval of the suffixes that begin with it. Symbols unknown to the shard, and 0, match nothing."""
        n = len(ends)
        text = np.where(text < len(self.count) - 1, text, 0)
        length = np.zeros(n, np.int64)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.arange(n)
        for back in range(cap):
            symbol = text[ends[live] - back]
            both = self.wavelets.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            both += np.tile(self.count[symbol], 2)
            a, b = both[: len(live)], both[len(live) :]
            fine = (a < b) & (symbol > 0)
            live = live[fine]
            if not len(live):
                break
            low[live], high[live] = a[fine], b[fine]
            length[live] += 1
        return length, low, high


def first_of_equal(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, count: np.ndarray, rank: np.ndarray, width: int = WIDTH, shard: int = SHARD) -> np.ndarray:
    """For each window the least ``rank`` of an equal one (a kernel of ``segments.resolve``)."""
    begin = gather(begins, count)
    window = np.full(len(symbols), -1, np.int64)
    window[begin] = np.arange(len(rank))
    text = symbols + 1
    group = np.cumsum(sizes) // shard
    first = rank.copy()
    for segs in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        own = gather(begins[segs], sizes[segs])
        alphabet, local = np.unique(symbols[own], return_inverse=True)
        mapped = np.zeros(int(symbols.max()) + 2, np.int64)
        mapped[alphabet + 1] = np.arange(1, len(alphabet) + 1)
        small = np.zeros(len(symbols), np.int64)
        small[own] = local
        part = Shard(small, begins, sizes, segs)
        index = Index(part, len(alphabet) + 1)
        query = mapped[text]
        for lo in range(0, len(begin), 1 << 17):
            ends = begin[lo : lo + (1 << 17)] + width - 1
            length, low, high = index.statistics(query, ends, width)
            hit = np.flatnonzero(length == width)
            if not len(hit):
                continue
            starts, back = np.unique(low[hit], return_inverse=True)
            stops = np.empty(len(starts), np.int64)
            stops[back] = high[hit]
            rows = gather(starts, stops - starts)
            ranks = rank[window[part.place[part.array[rows]]]]
            least = np.minimum.reduceat(ranks, np.cumsum(stops - starts) - (stops - starts))
            at = lo + hit
            first[at] = np.minimum(first[at], least[back])
    return first


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept): the words of each text, joined by one space, without those in a
    window of ``width`` words whose sequence starts earlier: in a smaller key, or before in the same text.

    Windows are judged on the input. One row per row of ``docs``; null text has no words; a null key
    is greater than all others, and rows with equal keys stand in order of a hash of their text (equal rows
    count as one).
    """
    scheme = segments.Scheme(width, GRAM, True)
    plain = segments.numbered(docs, key, text)

    def kernel(*chunk: np.ndarray) -> np.ndarray:
        return first_of_equal(*chunk, width=width)

    def kept(keys: pa.Array, texts: pa.Array, counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        data, offsets = text_buffer(texts)
        places = np.concatenate([[0], np.cumsum(counts)])
        sizes, removed, left = [], [], []
        for lo, hi in row_groups(offsets):
            flat, at, row, per_row = segments.normal_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            mine = slice(places[lo], places[hi])
            gone = segments.mask(len(row), np.cumsum(per_row) - per_row, counts[lo:hi], start[mine], end[mine])
            stay = np.flatnonzero(~gone)
            body, of = flat[gather(at[stay], np.diff(at)[stay])], row[stay]
            stops = np.cumsum(np.diff(at)[stay])
            last = np.append(of[1:] != of[:-1], True) if len(of) else np.empty(0, bool)
            solid = np.ones(len(body), bool)
            solid[stops[last] - 1] = False
            lengths = np.bincount(of, np.diff(at)[stay], hi - lo).astype(np.int64) if len(of) else np.zeros(hi - lo, np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths - (lengths > 0))]).astype(np.int32)
            left.append(pa.StringArray.from_buffers(hi - lo, pa.py_buffer(ends), pa.py_buffer(body[solid].tobytes())))
            sizes.append(per_row)
            removed.append(np.bincount(row[gone], minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), pa.concat_arrays(left)], names=schema.names)

    schema = T.StructType([plain.schema["key"], *T.StructType.fromDDL("n_words bigint, n_removed bigint, kept string").fields])
    spans = segments.covered(plain, scheme, kernel, other_docs=False)
    return segments.without(plain, spans, kept, schema).withColumnRenamed("key", key)


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return deduplicate(docs, key).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
