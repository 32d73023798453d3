"""Repeated windows without all windows: texts cut into segments that meet by an anchor.

A window is ``width`` consecutive symbols (bytes or words). Its anchor is the least hash of the ``gram``
symbol runs inside it; neighbouring windows mostly share it, and windows with the same anchor in a row
form a segment. Equal windows have equal anchors, so they lie in segments with the same anchor, whatever
stands around them. Only anchors that the census finds twice matter, and equal segments meet once: what is left goes,
anchor by anchor, to a kernel that tells for each window which occurrence is the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm.common import binaries, gather, mix, rolling, row_groups, slices, sliding_min, spans_hash, strong_hash, text_buffer, words
from tendril.session import freed, materialize, size_batches

#: Windows of a segment at most: a long run of one anchor (text that repeats itself) is cut.
MOST = 64
#: Bits of the table that keeps segments without a repeated anchor from being shuffled, at least and at
#: most. It lets false ones pass, so its size changes the traffic, never the result.
LEAST_BITS, MOST_BITS = 20, 28
#: Bytes of segments that a kernel takes at once; whole anchors stay together.
CHUNK = 1 << 19
#: Bytes of different segments from which an anchor is too frequent for one task.
FREQUENT = 1 << 20
#: Bytes that are cut into segments at once: hashes take several times eight as much, and should stay in the processor's cache.
PIECE = 1 << 17
#: Bytes of whole documents that a task handles at once, whatever the batch.
GROUP = 1 << 22
#: Segments and windows of a task that are held before equal ones become one, and of a batch that it sends.
ROWS, SENT = 1 << 17, 1 << 14
#: Rows without an id come after all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Scheme:
    width: int
    gram: int
    by_word: bool


def runs(hashes: np.ndarray, scheme: Scheme, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the segments; ``hashes`` are those of the grams."""
    least = sliding_min(hashes, scheme.width - scheme.gram + 1)
    n = len(least)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (valid[1:n] != valid[: n - 1])
    at = np.flatnonzero(edge)
    start, count = at[:-1], np.diff(at)
    fine = valid[start]
    start, count = start[fine], count[fine]
    pieces = -(-count // MOST)
    of = np.repeat(np.arange(len(start)), pieces)
    part = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return start[of] + MOST * part, np.minimum(MOST, count[of] - MOST * part), mix(least[start[of]])


def anchors_in(hashes: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, scheme: Scheme) -> np.ndarray:
    """How often a segment holds its anchor: text that repeats itself has several."""
    span = count + scheme.width - scheme.gram
    if not len(span):
        return span
    return np.add.reduceat(mix(hashes[gather(start, span)]) == np.repeat(anchor, span), np.cumsum(span) - span, dtype=np.int64)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of rows, each followed by one space: (bytes, start of each word, row of each word, words of each row)."""
    start, end = words(data, offsets)
    lengths = end - start + 1
    flat = data[np.minimum(gather(start, lengths), max(0, len(data) - 1))] if len(data) else data
    ends = np.cumsum(lengths)
    flat[ends - 1] = 32
    row = np.searchsorted(offsets, start, "right") - 1
    return flat, np.append(ends - lengths, len(flat)), row, np.bincount(row, minlength=len(offsets) - 1)


def divided(start: np.ndarray, count: np.ndarray, anchor: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments with an anchor in ``frequent`` (sorted leading 48 bits) as single windows; the fourth array tells which those are."""
    if not len(frequent):
        return start, count, anchor, np.zeros(len(start), bool)
    key = anchor >> np.uint64(16)
    alone = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
    times = np.where(alone, count, 1)
    begin = np.repeat(start, times) + gather(np.zeros(len(times), np.int64), times)
    return begin, np.repeat(np.where(alone, 1, count), times), np.repeat(anchor, times), np.repeat(alone, times)


def cut(column: pa.Array, scheme: Scheme, census: bool = False, frequent: np.ndarray = np.empty(0, np.uint64)) -> Iterator[tuple]:
    """Segments of a column, for bounded parts of it: (anchor, row, start in its row, how often it holds its
    anchor, bytes, from, length, whether it is a single window of a ``frequent`` anchor); the fourth only for the ``census``."""
    data, offsets = text_buffer(column)
    if not scheme.by_word:
        for lo, hi in slices(len(data), PIECE):
            part = data[lo : hi + scheme.width - 1]
            n = len(part) - scheme.width + 1
            if n <= 0:
                continue
            valid = np.zeros(n + 1, np.int8)
            a, b = np.maximum(offsets[:-1] - lo, 0), np.minimum(offsets[1:] - lo - scheme.width + 1, n)
            some = a < b
            np.add.at(valid, a[some], 1)
            np.add.at(valid, b[some], -1)
            grams = rolling(part, scheme.gram)
            start, count, anchor, alone = divided(*runs(grams, scheme, np.cumsum(valid[:-1]) > 0), frequent)
            row = np.searchsorted(offsets, start + lo, "right") - 1
            held = anchors_in(grams, start, count, anchor, scheme) if census else None
            yield anchor, row, start + lo - offsets[row], held, part, start, count + scheme.width - 1, alone
        return
    for lo, hi in row_groups(offsets):
        flat, at, row, per_row = normal_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = len(at) - scheme.width
        if n <= 0:
            continue
        hashes = spans_hash(flat, at[:-1], at[1:] - 1)
        valid = row[:n] == row[scheme.width - 1 :]
        grams = rolling(hashes, scheme.gram)
        start, count, anchor, alone = divided(*runs(grams, scheme, valid), frequent)
        held = anchors_in(grams, start, count, anchor, scheme) if census else None
        first = np.cumsum(per_row) - per_row
        begin, end = at[start], at[start + count + scheme.width - 1]
        yield anchor, row[start] + lo, start - first[row[start]], held, flat, begin, end - begin, alone


def several(key: np.ndarray, content: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with more than two different contents, and the bytes of these."""
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[of] > 2)
    some = some[np.lexsort((content[some], key[some]))]
    key, content, length = key[some], content[some], length[some]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    key, first, times = np.unique(key[new], return_index=True, return_counts=True)
    weight = np.add.reduceat(length[new], first) if len(first) else np.empty(0, np.int64)
    return key[times > 2], weight[times > 2].astype(np.int64)


CENSUS = ["part", "keys", "many", "weight"]


def census(docs: DataFrame, scheme: Scheme, other_docs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bit table of the anchors in several documents, or else of those that occur several times; and the leading 48
    bits of the frequent ones, sorted.

    A task sends each anchor at most twice for a group of documents, as the leading 48 bits in sorted blobs by the first of
    them; where a blob's range is put together, what stands there twice sets its bit. Two anchors that look
    alike let a segment pass that the kernel then finds alone. An anchor with more than two different segments in a group
    is sent with their bytes too; where these sums exceed FREQUENT it is frequent, so there are fewer
    of them than FREQUENT goes into the text's segments.
    """
    with freed(docs.sparkSession):
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    expected = max(1, 2 * total // (scheme.width - scheme.gram + 2) // (5 if scheme.by_word else 1))
    bits = int(np.clip(np.ceil(np.log2(2 * expected)), LEAST_BITS, MOST_BITS))
    ranges = int(np.clip(np.ceil(np.log2(expected / (1 << 18))), 8, bits - 6))  # the first byte follows from the range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(lo, hi - lo) for b in batches for lo, hi in row_groups(text_buffer(b.column(0))[1], GROUP)):
            found = [
                (anchor >> np.uint64(16), row if other_docs else held, spans_hash(data, begin, begin + length), length)
                for anchor, row, _, held, data, begin, length, _ in cut(part.column(0), scheme, not other_docs)
            ]
            if not found:
                continue
            key, other, content, length = (np.concatenate(x) for x in zip(*found, strict=True))
            many, weight = several(key, content, length)
            if other_docs:
                order = np.lexsort((other, key))
                key, other = key[order], other[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
                key = key[new]
            else:
                key = np.sort(np.repeat(key, np.minimum(other, 2)))
            few = np.ones(len(key), bool)
            few[2:] = key[2:] != key[:-2]
            key = key[few]
            part, crowd = ((k >> np.uint64(48 - ranges)).astype(np.int64) for k in (key, many))
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            blob = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5]
            ends = np.append(at, len(part))
            # Byte by byte, not key by key: the leading bytes of sorted keys compress well.
            planes = [blob[a:b].T.tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            # Rows of both kinds have their own: blobs of keys, or a frequent key and its bytes.
            none, nothing = np.zeros(len(at), np.int64), pa.array([b""] * len(many), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(planes, pa.binary()), pa.array(none), pa.array(none)], names=CENSUS)
            yield pa.RecordBatch.from_arrays([pa.array(crowd), nothing, pa.array(many.view(np.int64)), pa.array(weight)], names=CENSUS)

    page = bits - ranges

    def meet(table: pa.Table) -> pa.Table:
        data, offsets = text_buffer(table.column("keys"))
        key = np.zeros((len(data) // 5, 8), np.uint8)
        for a, b in zip(offsets[:-1] // 5, offsets[1:] // 5, strict=True):
            key[a:b, :5] = data[5 * a : 5 * b].reshape(5, -1).T
        key = np.sort(key.view(np.uint64).reshape(-1))
        own = np.zeros(1 << page, np.uint8)
        own[(key[1:][key[1:] == key[:-1]] >> np.uint64(48 - bits)).astype(np.int64) & ((1 << page) - 1)] = 1
        weight = table.column("weight").to_numpy()
        many, of = np.unique(table.column("many").to_numpy()[weight > 0].view(np.uint64), return_inverse=True)
        many = many[np.bincount(of, weight[weight > 0], len(many)) > FREQUENT]
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary()), "frequent": pa.array([many.tobytes()], pa.binary())})

    sent = docs.select("text").mapInArrow(run, "part bigint, keys binary, many bigint, weight bigint")
    frequent = [np.empty(0, np.uint64)]
    table = np.zeros(1 << (bits - 6), np.uint64)
    with freed(docs.sparkSession):
        met = sent.groupBy("part").applyInArrow(meet, "part bigint, bits binary, frequent binary").collect()
    for r in met:
        at = r.part << (page - 6)
        table[at : at + (1 << (page - 6))] = np.frombuffer(r.bits, np.uint64)
        frequent.append(np.frombuffer(r.frequent, np.uint64))
    return table, np.sort(np.concatenate(frequent))


def bit_table(values: DataFrame) -> np.ndarray:
    """Bits of numbers (column ``anchor``) by their leading bits: a filter of bounded size, packed by the executors."""
    with freed(values.sparkSession):
        n = values.count()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, n) * 16)))))
    page = min(bits, 18)

    def pack(table: pa.Table) -> pa.Table:
        anchor = table.column("anchor").to_numpy().view(np.uint64)
        own = np.zeros(1 << page, np.uint8)
        own[(anchor >> np.uint64(64 - bits)).astype(np.int64) & ((1 << page) - 1)] = 1
        return pa.table({"page": table.column("page")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    paged = values.withColumn("page", F.expr(f"shiftrightunsigned(anchor, {64 - bits + page})") if bits > page else F.lit(0).cast("bigint"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    with freed(values.sparkSession):
        packed = paged.groupBy("page").applyInArrow(pack, "page bigint, bits binary").collect()
    for r in packed:
        at = r.page << (page - 6)
        table[at : at + (1 << (page - 6))] = np.frombuffer(r.bits, np.uint64)
    return table


def passing(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the values whose bit is set."""
    slot = values >> np.uint64(64 - int(np.log2(len(table)) + 6))
    return np.flatnonzero((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))


def names_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes by which the occurrences of a segment find what was told about it; no kind of text makes them collide."""
    return strong_hash(data, start, end, 1), strong_hash(data, start, end, 2)


def collapse(rows: pa.Table, other_docs: bool) -> pa.Table:
    """Equal segments (or windows) as one: the first occurrence, and in ``more`` the greatest doc or the number of occurrences."""
    # Only a number for each content is sorted and grouped: copies of the contents would stand beside them.
    content = rows.column("content").combine_chunks().dictionary_encode()
    plain = rows.drop_columns("content").append_column("content", content.indices).combine_chunks()
    plain = plain.sort_by([(c, "ascending") for c in ("doc", "row", "start")])
    first = [(c, "first") for c in ("anchor", "doc", "row", "start")]
    grouped = pa.TableGroupBy(plain, ["content", "alone"], use_threads=False).aggregate([*first, ("more", "max" if other_docs else "sum")])
    at = grouped.column_names.index("content")
    grouped = grouped.set_column(at, "content", content.dictionary.take(grouped.column("content").combine_chunks()))
    names = [c.removesuffix("_first").removesuffix("_max").removesuffix("_sum") for c in grouped.column_names]
    return grouped.rename_columns(names).select(["anchor", "content", "doc", "row", "start", "more", "alone"])


#: A segment; or, ``alone``, a window of a frequent anchor with the two hashes of its name as content, the first as anchor.
SEGMENT = "anchor bigint, content binary, doc bigint, row bigint, start bigint, more bigint, alone boolean"


def occurrences(docs: DataFrame, scheme: Scheme, table: tuple[np.ndarray, np.ndarray], other_docs: bool) -> DataFrame:
    """SEGMENT rows: segments whose anchor passes the table, equal ones of a task already as one (of ROWS at a time).

    Segments of a frequent anchor go as windows, each to the partition of its own name: what surrounds a
    frequent passage is spread over all tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = shared.value
        found, held = [], 0
        for batch in batches:
            doc, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for anchor, row, start, _, data, begin, length, alone in cut(batch.column(2), scheme, frequent=frequent):
                hit = passing(bits, anchor)
                for single in (False, True):
                    some = hit[alone[hit] == single]
                    if not len(some):
                        continue
                    of, zero = row[some], np.zeros(len(some), np.int64)
                    if single:
                        h1, h2 = names_of(data, begin[some], begin[some] + length[some])
                        own, content = h1, binaries(np.stack([h1, h2], 1).reshape(-1).view(np.uint8), 16 * np.arange(len(some)), zero + 16)
                    else:
                        own, content = anchor[some], binaries(data, begin[some], length[some])
                    found.append(
                        pa.table({
                            "anchor": own.view(np.int64), "content": content, "doc": doc[of], "row": zero if other_docs else ident[of],
                            "start": zero if other_docs else start[some], "more": doc[of] if other_docs else zero + 1, "alone": np.full(len(some), single),
                        })
                    )
                    held += len(some)
                if held > ROWS:
                    found = [collapse(pa.concat_tables(found), other_docs)]
                    held = found[0].num_rows
                    if held > ROWS // 2:
                        yield from found[0].combine_chunks().to_batches(SENT)
                        found, held = [], 0
        if found:
            yield from collapse(pa.concat_tables(found), other_docs).combine_chunks().to_batches(SENT)

    return docs.select("doc", "row", "text").mapInArrow(run, SEGMENT)


def places(docs: DataFrame, scheme: Scheme, anchors: tuple[np.ndarray, np.ndarray], names: np.ndarray) -> DataFrame:
    """(h1, h2, doc, row, start): all occurrences of the segments whose name passes the second table."""
    shared = docs.sparkSession.sparkContext.broadcast((anchors, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (anchors, frequent), names = shared.value
        for batch in batches:
            doc, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for anchor, row, start, _, data, begin, length, _ in cut(batch.column(2), scheme, frequent=frequent):
                hit = passing(anchors, anchor)
                h1, h2 = names_of(data, begin[hit], begin[hit] + length[hit])
                told = passing(names, h1)
                if len(told):
                    row = row[hit[told]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[told].view(np.int64), h2[told].view(np.int64), doc[row], ident[row], start[hit[told]])], names=["h1", "h2", "doc", "row", "start"])

    return docs.select("doc", "row", "text").mapInArrow(run, "h1 bigint, h2 bigint, doc bigint, row bigint, start bigint")


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def resolve(found: DataFrame, scheme: Scheme, kernel: Kernel, other_docs: bool) -> DataFrame:
    """(h1, h2, off, n, fd, fr, fs): the first occurrence of each window of each segment, in runs.

    ``found`` has SEGMENT rows. Rows of an anchor stand together in a partition and are taken in chunks; an
    anchor is not divided here, as windows of frequent ones come by their own names. Of those the first occurrence is the
    result itself. Runs that remove nothing anywhere are left out.
    """
    names = ["h1", "h2", "off", "n", "fd", "fr", "fs"]

    def windows(rows: pa.Table) -> pa.RecordBatch | None:
        doc, row, start, more = (rows.column(c).to_numpy() for c in ("doc", "row", "start", "more"))
        keep = more > (doc if other_docs else 1)
        if not keep.any():
            return None
        name = text_buffer(rows.column("content"))[0].view(np.int64).reshape(-1, 2)[keep]
        zero = np.zeros(len(name), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (name[:, 0], name[:, 1], zero, zero + 1, doc[keep], row[keep], start[keep])], names=names)

    def solve(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = collapse(pa.Table.from_batches(batches), other_docs)
        for kind, own in ((windows, rows.filter(rows.column("alone"))), (segments, rows.filter(pa.compute.invert(rows.column("alone"))))):
            if own.num_rows and (done := kind(own)) is not None:
                yield done

    def segments(rows: pa.Table) -> pa.RecordBatch | None:
        data, offsets = text_buffer(rows.column("content"))
        doc, row, start, more = (rows.column(c).to_numpy() for c in ("doc", "row", "start", "more"))
        if scheme.by_word:
            at = np.flatnonzero(data == 32) + 1
            starts = np.concatenate([[0], at[:-1]])
            symbols = word_ids(data, starts, at - 1)
            sizes = np.diff(np.searchsorted(starts, offsets))
        else:
            symbols, sizes = data.astype(np.int64), np.diff(offsets)
        begins = np.cumsum(sizes) - sizes
        count = sizes - scheme.width + 1
        seg = np.repeat(np.arange(len(sizes)), count)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        place = 0 if other_docs else start[seg] + off
        order = np.argsort(doc[seg], kind="stable") if other_docs else np.lexsort((place, row[seg], doc[seg]))
        rank = np.empty(len(seg), np.int64)
        rank[order] = np.arange(len(seg))
        if other_docs:
            # A segment that its anchor has for itself has no others to be ordered among, and repeats within it are
            # in its own document.
            _, of, times = np.unique(rows.column("anchor").to_numpy(), return_inverse=True, return_counts=True)
            met = np.flatnonzero(times[of] > 1)
            best, some = rank.copy(), times[of][seg] > 1
            if len(met):
                best[some] = kernel(symbols, begins[met], sizes[met], count[met], rank[some])
        else:
            best = kernel(symbols, begins, sizes, count, rank)
        first = order[best]
        fd, fr = doc[seg][first], row[seg][first]
        fs = np.zeros(len(seg), np.int64) if other_docs else place[first]
        step = 0 if other_docs else 1
        edge = np.ones(len(seg), bool)
        edge[1:] = (seg[1:] != seg[:-1]) | (fd[1:] != fd[:-1]) | (fr[1:] != fr[:-1]) | (fs[1:] != fs[:-1] + step)
        a = np.flatnonzero(edge)
        n = np.diff(np.append(a, len(seg)))
        s = seg[a]
        keep = (more[s] > doc[s]) | (fd[a] != doc[s]) if other_docs else (more[s] > 1) | (fd[a] != doc[s]) | (fr[a] != row[s]) | (fs[a] != start[s] + off[a])
        a, n, s = a[keep], n[keep], s[keep]
        if not len(a):
            return None
        own = names_of(data, offsets[s], offsets[s + 1])
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in own), *(pa.array(x) for x in (off[a], n, fd[a], fr[a], fs[a]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            _, offsets = text_buffer(batch.column(1))
            if held and held[-1].column(0)[-1].as_py() != anchor[0] and size >= CHUNK:
                yield from solve(held)
                held, size = [], 0
            lo = 0
            for at in np.append(np.flatnonzero(np.diff(anchor)) + 1, len(anchor)).tolist():
                if size + offsets[at] - offsets[lo] >= CHUNK and at < len(anchor):
                    held.append(batch.slice(lo, at - lo))
                    yield from solve(held)
                    held, size, lo = [], 0, at
            held.append(batch.slice(lo))
            size += int(offsets[-1] - offsets[lo])
        if held:
            yield from solve(held)

    dealt = found.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "h1 bigint, h2 bigint, off bigint, n bigint, fd bigint, fr bigint, fs bigint")


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Dense numbers of words from 0. Words with equal hashes are compared, so equal numbers mean equal words."""
    hashes = spans_hash(data, starts, ends)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, twin = ends - starts, first[ids]
    if not (np.array_equal(sizes, sizes[twin]) and np.array_equal(data[gather(starts, sizes)], data[gather(starts[twin], sizes)])):
        raw = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        number = {w: i for i, w in enumerate(dict.fromkeys(raw))}
        ids = np.array([number[w] for w in raw])
    return ids


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc, row, text): null text is empty, a null key comes last.

    row tells rows with the same key apart: a hash of the text, by which they are ordered; 0 where keys do not repeat.
    """
    k, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    repeated = not docs.groupBy(k).count().filter("count > 1").isEmpty()
    row = F.xxhash64(body) if repeated else F.lit(0).cast("bigint")
    return docs.select(k.alias("key"), F.coalesce(k.cast("bigint"), F.lit(LAST)).alias("doc"), row.alias("row"), body.alias("text"))


def covered(docs: DataFrame, scheme: Scheme, kernel: Kernel, other_docs: bool) -> DataFrame:
    """(doc, row, spans array of (start, end)): symbols that lie in a window which occurs earlier.

    Earlier means in a smaller doc (``other_docs``), or before in the order of doc, row and start. ``docs`` is
    what ``numbered`` returns. Spans of a document may overlap. Texts are read three times, which is cheaper than
    to store their segments.
    """
    size_batches(docs.sparkSession)
    anchors = census(docs, scheme, other_docs)
    told = materialize(resolve(occurrences(docs, scheme, anchors, other_docs), scheme, kernel, other_docs), "told")
    own = places(docs, scheme, anchors, bit_table(told.select(F.col("h1").alias("anchor"))))
    earlier = F.col("fd") < F.col("doc") if other_docs else F.struct("fd", "fr", "fs") < F.struct("doc", "row", F.col("start") + F.col("off"))
    begin = F.col("start") + F.col("off")
    pairs = own.join(told, ["h1", "h2"]).filter(earlier)
    spans = pairs.select("doc", "row", F.struct(begin.alias("start"), (begin + F.col("n") + scheme.width - 1).alias("end")).alias("span"))
    # Written, so that the shuffle files of all places are gone before the texts are dealt to their spans.
    return materialize(spans.groupBy("doc", "row").agg(F.collect_list("span").alias("spans")), "spans")


def without(docs: DataFrame, spans: DataFrame, kept: Callable, schema: T.StructType) -> DataFrame:
    """Joins the spans to their documents; ``kept`` turns (key column, texts, spans per row) into the output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_groups(text_buffer(batch.column(1))[1], GROUP):
                keys, texts, lists = batch.slice(lo, hi - lo).columns
                counts = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = lists.flatten()
                start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)) if len(flat) else (np.empty(0, np.int64),) * 2
                yield kept(keys, texts, counts, start, end)

    joined = docs.join(spans, ["doc", "row"], "left").select("key", "text", "spans")
    return joined.mapInArrow(run, schema)


def mask(size: int, begins: np.ndarray, counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Symbols covered by the spans, all rows in one array; ``begins`` is where each row's symbols begin."""
    base = np.repeat(begins, counts)
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, base + start, 1)
    np.add.at(change, base + end, -1)
    return np.cumsum(change[:-1]) > 0
