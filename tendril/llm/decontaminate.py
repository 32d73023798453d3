"""Benchmark passages in documents: shared q-grams per diagonal band, then banded alignment.

A window of ``window`` bytes of an item that occurs in a document with at most ``edits`` edits shares
at least ``window + 1 - q * (edits + 1)`` q-grams with it, all on ``edits + 1`` neighbouring diagonals.
Bands of twice that width overlap by half, so one of them holds all; bands with fewer hits in reach of a
window are dropped, and what is left is aligned. Whatever meets the bound is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm.common import gather, keep_columns, rolling, row_groups, slices, text_buffer

Q, WINDOW, EDITS = 11, 50, 3
#: Bytes of items that one pass broadcasts; larger benchmarks take several passes over the documents.
PASS_BYTES = 32 << 20
TABLE_BITS = 22
#: Pairs of equal q-grams that are expanded at once.
PAIRS = 1 << 20
#: Diagonals of a band; two sets of bands overlap by half.
BAND = 2 * (EDITS + 1)


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, every white space a space; lengths stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table[data]


@dataclass
class Items:
    """Folded items in a row with their q-grams sorted by hash."""

    ids: pa.Array
    data: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray
    places: np.ndarray
    table: np.ndarray
    window: np.ndarray
    edits: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        texts = [fold(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.concatenate([*texts, np.empty(0, np.uint8)])
        hashes = rolling(data, Q)
        at = np.arange(len(hashes))
        inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + Q - 1, "right")
        at = at[inside]
        order = np.argsort(hashes[at], kind="stable")
        grams, first, count = np.unique(hashes[at][order], return_index=True, return_counts=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        window = np.minimum(WINDOW, sizes)
        edits = np.minimum(window * EDITS // WINDOW, np.maximum(0, (window + 1) // Q - 1))
        return cls(pa.array([i for i, _ in rows], pa.int64()), data, offsets, grams, first, count, at[order], table, window, edits)


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place in the documents, number of its q-gram in the items) where the items have it too, none across a border."""
    found, which = [], []
    for lo, hi in slices(len(data)):
        h = rolling(fold(data[lo : hi + Q - 1]), Q)
        at = np.flatnonzero(items.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(items.grams, h[at]), len(items.grams) - 1)
        same = items.grams[slot] == h[at]
        found.append(at[same] + lo)
        which.append(slot[same])
    at, slot = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (found, which))
    inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + Q - 1, "right")
    return at[inside], slot[inside]


def first_from(items: Items, slot: np.ndarray, bound: np.ndarray | int) -> np.ndarray:
    """Index of the first place of each q-gram that is not below ``bound``; places of a q-gram ascend."""
    lo, hi = items.first[slot], items.first[slot] + items.count[slot]
    while (left := lo < hi).any():
        mid = (lo + hi) // 2
        below = left & (items.places[np.minimum(mid, len(items.places) - 1)] < bound)
        lo, hi = np.where(below, mid + 1, lo), np.where(left & ~below, mid, hi)
    return lo


def banded(d: np.ndarray, i: np.ndarray, doc: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Which hits lie in a band, and in reach of a window, with as many hits as the lemma asks for."""
    keep = np.zeros(len(d), bool)
    need = np.maximum(1, items.window + 1 - Q * (items.edits + 1))[item]
    reach = (items.window + items.edits - Q)[item]
    for shift in (0, EDITS + 1):
        band = (d - i + shift) // BAND
        order = np.lexsort((d, band, item, doc))
        same = np.zeros(len(d), bool)
        same[1:] = (np.diff(doc[order]) == 0) & (np.diff(item[order]) == 0) & (np.diff(band[order]) == 0)
        group = np.cumsum(~same)
        k = np.arange(len(d))
        last = k + need[order] - 1
        fine = last < len(d)
        end = np.minimum(last, len(d) - 1)
        fine &= (group[end] == group) & (d[order][end] - d[order] <= reach[order])
        cover = np.zeros(len(d) + 1, np.int64)
        np.add.at(cover, k[fine], 1)
        np.add.at(cover, end[fine] + 1, -1)
        keep[order[np.cumsum(cover[:-1]) > 0]] = True
    return keep


def reach(a: bytes, b: bytes, edits: int) -> list[int]:
    """How much of ``a`` a prefix of ``b`` aligns with, for 0 to ``edits`` edits: furthest points on 2 * edits + 1 diagonals."""
    na, nb, out, front = len(a), len(b), [], {}
    for k in range(edits + 1):
        now = {}
        for g in range(-k, k + 1):
            if k == 0:
                x = 0
            else:
                x = max(front.get(g, -2) + 1, front.get(g - 1, -2) + 1, front.get(g + 1, -2))
            x = min(x, na, nb + g)
            if x < max(0, g):
                continue
            while x < na and x - g < nb and a[x] == b[x - g]:
                x += 1
            now[g] = x
        front = now
        out.append(max(now.values()))
    return out


def verify(d: np.ndarray, i: np.ndarray, doc: np.ndarray, item: np.ndarray, data: np.ndarray, offsets: np.ndarray, items: Items):
    """(doc, item, start, end, edits) of the first window that aligns, for each pair of document and item.

    Each run of hits on one diagonal is an exact match; it grows to both sides within the edit budget.
    """
    order = np.lexsort((d, d - i, item, doc))
    d, i, doc, item = d[order], i[order], doc[order], item[order]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d) != 1) | (np.diff(d - i) != 0) | (np.diff(item) != 0) | (np.diff(doc) != 0)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(d))) + Q - 1
    by = np.lexsort((-length, item[start], doc[start]))
    out, done = [], None
    for s, n in zip(start[by], length[by], strict=True):
        pair = (doc[s], item[s])
        if pair == done:
            continue
        m, budget = int(items.window[item[s]]), int(items.edits[item[s]])
        lo, hi, ilo, ihi = offsets[doc[s]], offsets[doc[s] + 1], items.offsets[item[s]], items.offsets[item[s] + 1]
        de, ie, more = d[s] + n, i[s] + n, m + budget
        right = reach(items.data[ie : min(ihi, ie + m)].tobytes(), fold(data[de : min(hi, de + more)]).tobytes(), budget)
        left = reach(items.data[max(ilo, i[s] - m) : i[s]].tobytes()[::-1], fold(data[max(lo, d[s] - more) : d[s]]).tobytes()[::-1], budget)
        best = next(((k, j) for total in range(budget + 1) for k in range(total + 1) for j in (total - k,) if left[k] + n + right[j] >= m), None)
        if best is not None:
            done = pair
            out.append((doc[s], item[s], max(lo, d[s] - left[best[0]]), min(hi, de + right[best[1]]), sum(best)))
    return out


def passes_of(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The items in groups of about PASS_BYTES; the driver and each executor hold one group at a time."""
    rows = keep_columns(benchmark, item=key, text=text).filter(F.octet_length("text") >= Q).distinct()
    rows = rows.withColumn("item", F.col("item").cast("bigint"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // PASS_BYTES))
    for k in range(n):
        some = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        if some:
            yield Items.of([(r[0], r[1]) for r in some])


def found_in(texts: pa.Array, items: Items) -> Iterator[list]:
    """What ``verify`` returns for a column of texts, start and end within the text, in bounded parts.

    Rows are taken in groups, and groups by their number of pairs of equal q-grams; a row with too many goes
    by ranges of items, and a row with one item by diagonals.
    """
    data, offsets = text_buffer(texts)
    for lo, hi in row_groups(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        for found in blocks(part, own, items):
            if found:
                yield [(row + lo, item, start - own[row], end - own[row], edits) for row, item, start, end, edits in found]


def blocks(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[list]:
    """``verify`` over blocks of about PAIRS pairs: no pair of a document and an item is in two of the results."""
    at, slot = matches(data, offsets, items)
    doc = np.searchsorted(offsets, at, "right") - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, items.count[slot], len(offsets) - 1).astype(np.int64))])
    for a, b in row_groups(ends, PAIRS):
        mine = slice(*np.searchsorted(doc, [a, b]))
        if ends[b] - ends[a] <= PAIRS:
            yield aligned(at[mine], items.first[slot[mine]], items.count[slot[mine]], data, offsets, items)
            continue
        todo = [(0, len(items.offsets) - 1)]
        while todo:
            x, y = todo.pop()
            begin, end = (first_from(items, slot[mine], items.offsets[k]) for k in (x, y))
            n = int((end - begin).sum())
            if 0 < n <= PAIRS:
                yield aligned(at[mine], begin, end - begin, data, offsets, items)
            elif n and y - x > 1:
                todo += [((x + y) // 2, y), (x, (x + y) // 2)]
            elif n:
                yield next((f for f in diagonals(at[mine], slot[mine], x, data, offsets, items) if f), [])


def diagonals(at: np.ndarray, slot: np.ndarray, item: int, data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[list]:
    """``verify`` of a document and an item over ranges of diagonals, each with half a band beside it, so that
    every band is whole in one of them; a single band in pieces of the document that overlap by more than a window."""
    lo, hi, half = items.offsets[item], items.offsets[item + 1], BAND // 2
    todo = [(int(at[0] - hi) // BAND * BAND, (int(at[-1] - lo) // BAND + 1) * BAND)]
    while todo:
        a, b = todo.pop()
        begin = first_from(items, slot, np.maximum(lo, at - b - half + 1))
        count = np.maximum(begin, first_from(items, slot, np.minimum(hi, at - a + half + 1))) - begin
        n = int(count.sum())
        if n > PAIRS and b - a > BAND:
            mid = a + (b - a) // BAND // 2 * BAND
            todo += [(mid, b), (a, mid)]
            continue
        few = max(1, PAIRS // (2 * BAND)) if n > PAIRS else len(at)
        for k in range(0, len(at) if n else 0, few):
            x, y = at[k], at[min(k + few, len(at)) - 1]
            some = slice(*np.searchsorted(at, [x - 2 * WINDOW, y + 2 * WINDOW + 1]))
            if count[some].any():
                yield aligned(at[some], begin[some], count[some], data, offsets, items, lambda d, i: (d >= x) & (d <= y) & (d - i >= a) & (d - i < b))


def aligned(at: np.ndarray, begin: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray, items: Items, inner=None) -> list:
    """``verify`` of the pairs of each place with ``count`` places of the items; only ``inner`` ones begin a window."""
    d, i = np.repeat(at, count), items.places[gather(begin, count)]
    if not len(d):
        return []
    doc = np.searchsorted(offsets, d, "right") - 1
    item = np.searchsorted(items.offsets, i, "right") - 1
    kept = banded(d, i, doc, item, items)
    if inner is not None:
        kept &= inner(d, i)
    return verify(d[kept], i[kept], doc[kept], item[kept], data, offsets, items)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, end, edits): one row per document row and item of which a window occurs in it.

    A window is WINDOW bytes of the item (all of a shorter one) with at most EDITS edits, letters in either
    case, any white space alike; start and end are bytes of the document. Null and empty texts match
    nothing; items under Q bytes are too short to tell and match nothing. Items without an id count like others;
    their rows have a null item_id, one for each different text. Only the items are broadcast, at
    most about PASS_BYTES a pass; documents are read once a pass and never shuffled.
    """
    plain = keep_columns(docs, key=key, text=text)
    schema = T.StructType([plain.schema["key"], *T.StructType.fromDDL("item_id bigint, start bigint, end bigint, edits int").fields])

    def one(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in found_in(batch.column(1), shared.value):
                    row, item, start, end, edits = (np.array(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), shared.value.ids.take(pa.array(item)), pa.array(start), pa.array(end), pa.array(edits.astype(np.int32))], names=schema.names
                    )

        return plain.mapInArrow(run, schema)

    parts = [one(items) for items in passes_of(benchmark, item_key, item_text)]
    found = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs, with all their columns; no shuffle.

    Items are taken by their text, whether they have an id or not; those under Q bytes match nothing.
    """
    schema, at = docs.schema, docs.columns.index(text)
    for items in passes_of(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for found in found_in(batch.column(at), shared.value):
                    stays[[f[0] for f in found]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, schema)
    return docs
