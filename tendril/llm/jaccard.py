"""Jaccard join of word shingles by chosen paths: sets split on sampled shared tokens until buckets are small.

A set is represented by its minima under ``TOKENS`` hash functions; two sets share about as many of
them as their similarity. At a node every set follows the tokens whose hash, seeded by the node,
is small enough: ``SPREAD`` shared ones are expected for a pair at the threshold, so it stays together with
probability ``1 - exp(-SPREAD)``, and ``DEEPER`` ones at each node below, however often buckets are split
again. Independent trees bring the chance to lose a pair down to the recall that is asked for (``runs_for``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import gather, mix, rolling, row_groups, strong_hash, text_buffer
from tendril.llm.segments import LAST, normal_words, numbered
from tendril.session import materialize

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS = 128
SPREAD, DEEPER = 1.0, 2.0
#: Sets of a bucket that are compared with each other directly.
LIMIT = 512
#: A child with more than this share of its parent holds sets that are alike: splitting it is no use.
DENSE = 0.7


def runs_for(recall: float) -> int:
    """Trees after which a pair at the threshold is lost with probability ``1 - recall`` at most, at any depth.

    A node loses a pair if all shared children do: with each further level that chance rises to the
    fixed point of ``lost = exp(-DEEPER * (1 - lost))``.
    """
    lost, before = np.exp(-DEEPER), 0.0
    while lost - before > 1e-12:
        lost, before = np.exp(-DEEPER * (1 - lost)), lost
    return int(np.ceil(-np.log(1 - recall) / (SPREAD * (1 - lost))))


def seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 32, TOKENS, np.uint32), rng.integers(0, 1 << 31, TOKENS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted, and the number of each row.

    A text of fewer than WORDS words has one shingle of all its words; without words it has none.
    """
    flat, at, row, per_row = normal_words(data, offsets)
    n = len(offsets) - 1
    if not len(row):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    word = strong_hash(flat, at[:-1], at[1:] - 1)
    runs = rolling(word, WORDS)
    whole = row[: len(runs)] == row[len(row) - len(runs) :]
    of, value = row[: len(runs)][whole], runs[whole]
    short = np.flatnonzero((per_row > 0) & (per_row < WORDS))
    if len(short):
        first = np.cumsum(per_row) - per_row
        texts = strong_hash(flat, at[first[short]], at[first[short] + per_row[short]] - 1)
        of, value = np.concatenate([of, short]), np.concatenate([value, texts])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(of[new], minlength=n)


def sets(docs: DataFrame) -> DataFrame:
    """(doc, row, size, h1, h2, minima): equal sets have equal sizes and hashes."""
    flip, times = seeds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in row_groups(offsets):
                value, sizes = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = hi - lo
                some = np.flatnonzero(sizes)
                minima = np.zeros((n, TOKENS), np.uint32)
                sums = np.zeros((2, n), np.int64)
                if len(some):
                    begin = (np.cumsum(sizes) - sizes)[some]
                    low = (value >> np.uint64(32)).astype(np.uint32)
                    for k in range(TOKENS):
                        minima[some, k] = np.minimum.reduceat((low ^ flip[k]) * times[k], begin)
                    for k, seed in enumerate((np.uint64(0), np.uint64(0xABCDEF))):
                        sums[k, some] = np.add.reduceat(mix(value ^ seed), begin).view(np.int64)
                part = batch.slice(lo, n)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TOKENS), n, [None, pa.py_buffer(minima.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), packed], names=["doc", "row", "size", "h1", "h2", "minima"])

    return docs.select("doc", "row", "text").mapInArrow(run, "doc bigint, row bigint, size bigint, h1 bigint, h2 bigint, minima binary")


def packed(column: pa.Array, kind, width: int) -> np.ndarray:
    data, _ = text_buffer(column)
    return np.ascontiguousarray(data).view(kind).reshape(len(column), width)


def follow(nodes: DataFrame, spread: float, trees: int | None = None) -> DataFrame:
    """(bucket, cls, above): the tokens that each set follows from its node, or from the roots of ``trees``.

    ``nodes`` has cls, minima and, below the roots, bucket and n of the node.
    """
    limit = np.uint64(spread / (THRESHOLD * TOKENS) * 2.0**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            place = mix(np.arange(1, TOKENS + 1, dtype=np.uint64))
            for whole in batches:
                for lo in range(0, whole.num_rows, 2048):
                    batch = whole.slice(lo, 2048)
                    token = packed(batch.column(1), np.uint32, TOKENS).astype(np.uint64) + place
                    cls, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                    at = batch.column(2).to_numpy().view(np.uint64)
                    for tree in range(trees or 1):
                        node = at if trees is None else np.full(len(cls), mix(np.array([tree + 1], np.uint64))[0])
                        h = mix(token ^ node[:, None])
                        row, k = np.nonzero(h < limit)
                        child = mix(h[row, k] + place[k])
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cls[row]), pa.array(n[row])], names=["bucket", "cls", "above"])

    return nodes.select("cls", "minima", "bucket", "n").mapInArrow(run, "bucket bigint, cls bigint, above bigint")


def leaves(classes: DataFrame, recall: float) -> DataFrame:
    """(cls, bucket, n): the buckets that are compared directly; n sets are in a bucket."""
    roots = classes.select("cls", "minima", F.lit(0).cast("bigint").alias("bucket"), F.lit(LAST).alias("n"))
    active = materialize(follow(roots, SPREAD, runs_for(recall)), "paths")
    done = []
    while True:
        shared = active.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        active = materialize(active.join(shared, "bucket"), "buckets")
        ready = (F.col("n") <= LIMIT) | (F.col("n") > DENSE * F.col("above"))
        done.append(active.filter(ready).select("cls", "bucket", "n"))
        large = active.filter(~ready)
        if large.isEmpty():
            return reduce(DataFrame.unionAll, done)
        active = materialize(follow(large.join(classes.select("cls", "minima"), "cls"), DEEPER), "paths")


def in_blocks(members: DataFrame) -> DataFrame:
    """Deals each bucket's sets into blocks of LIMIT; every two blocks meet once. Adds part, lo, hi to rows with bucket, n, cls."""
    blocks = F.ceil(F.col("n") / LIMIT).cast("int")
    part = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("blocks", blocks).withColumn("part", part).withColumn("other", other)
    return dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("blocks", "other")


def pairs_of(part: np.ndarray, first: int, second: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of a block, or of the two different blocks, either of which may be empty, some rows at a time."""
    if first == second:
        n = len(part)
        for lo in range(0, n, rows):
            i, j = np.nonzero(np.arange(lo, min(n, lo + rows))[:, None] < np.arange(n)[None])
            yield i + lo, j
    else:
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        for lo in range(0, len(a), rows):
            yield np.repeat(a[lo : lo + rows], len(b)), np.tile(b, len(a[lo : lo + rows]))


def alike(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that may reach the threshold: by size, and by bytes of the minima within five deviations."""
    fits = np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])
    least = TOKENS * THRESHOLD - 5 * np.sqrt(TOKENS * THRESHOLD * (1 - THRESHOLD))
    at = np.flatnonzero(fits)
    return at[(sketch[i[at]] == sketch[j[at]]).sum(1) >= least]


def candidates(members: DataFrame) -> DataFrame:
    """(bucket, lo, hi, cls, partners): the pairs to verify, each in the first bucket that both sets are in."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda name: table.column(name).to_numpy()
        cls, size, part, bucket = get("cls"), get("size"), get("part"), get("bucket")[0]
        sketch = packed(table.column("sketch"), np.uint8, TOKENS)
        lists = table.column("buckets").combine_chunks()
        counts = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy()
        width = int(counts.max())
        own = np.full((len(cls), width), LAST, np.int64)
        own[np.repeat(np.arange(len(cls)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in pairs_of(part, get("lo")[0], get("hi")[0]):
            at = alike(sketch, size, i, j)
            for lo in range(0, len(at), 4096):
                a, b = i[at[lo : lo + 4096]], j[at[lo : lo + 4096]]
                before = np.where(own[a] < bucket, own[a], LAST)
                met = np.zeros(len(a), bool)
                for k in range(width):
                    met |= ((before[:, k : k + 1] == own[b]) & (before[:, k : k + 1] != LAST)).any(1)
                left.append(a[~met])
                right.append(b[~met])
        a, b = np.concatenate(left), np.concatenate(right)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        used = np.unique(np.concatenate([a, b]))
        ends = np.searchsorted(a, used, "right")
        begin = np.searchsorted(a, used, "left")
        partners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends - begin)]).astype(np.int32)), pa.array(cls[b]))
        n = len(used)
        key = [pa.array(np.full(n, get(c)[0])) for c in ("bucket", "lo", "hi")]
        return pa.Table.from_arrays([*key, pa.array(cls[used]), partners], names=["bucket", "lo", "hi", "cls", "partners"])

    return members.groupBy("bucket", "lo", "hi").applyInArrow(run, "bucket bigint, lo int, hi int, cls bigint, partners array<bigint>")


def shared_sizes(value: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets (``value`` between ``offsets``)."""
    n = len(offsets) - 1
    if len(i) > 4 * n:
        of = np.repeat(np.arange(n), np.diff(offsets))
        _, token, count = np.unique(value, return_inverse=True, return_counts=True)
        again = count[token] > 1
        of, token = of[again], np.unique(token[again], return_inverse=True)[1]
        order = np.argsort(token, kind="stable")
        of, token = of[order], token[order]
        total = np.zeros((n, n), np.float32)
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            a, b = np.searchsorted(token, [lo, lo + 4096])
            has = np.zeros((n, 4096), np.float32)
            has[of[a:b], token[a:b] - lo] = 1
            total += has @ has.T
        return total[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        both = np.concatenate([value[offsets[a] : offsets[a + 1]], value[offsets[b] : offsets[b + 1]]])
        both.sort()
        out[k] = (both[1:] == both[:-1]).sum()
    return out


def verify(rows: DataFrame) -> DataFrame:
    """(cls, links, label): exact similarities within each group of candidates.

    links counts the documents of the sets found alike; label is the least set that links lead to here.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        data, offsets = text_buffer(table.column("shingles"))
        value, offsets = np.ascontiguousarray(data).view(np.uint64), offsets // 8
        partners = table.column("partners").combine_chunks()
        counts = pa.compute.list_value_length(partners).to_numpy().astype(np.int64)
        i = np.repeat(np.arange(len(cls)), counts)
        order = np.argsort(cls)
        j = order[np.searchsorted(cls[order], partners.flatten().to_numpy())]
        size = np.diff(offsets)
        both = shared_sizes(value, offsets, i, j)
        fine = both >= THRESHOLD * (size[i] + size[j] - both) - 1e-9
        i, j = i[fine], j[fine]
        links = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
        label = cls.copy()
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            if (least == label).all():
                break
            label = least
        some = links > 0
        return pa.Table.from_arrays([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(label[some])], names=["cls", "links", "label"])

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(run, "cls bigint, links bigint, label bigint")


def components(edges: DataFrame) -> DataFrame:
    """(cls, root): the least set of each component, for sets with an edge (cls, label).

    Large-star and small-star rounds: neighbours hang on to the least one around them, so the depth falls
    by powers. A set with many neighbours is summed up before it is shuffled.
    """
    link = lambda df: df.select(F.greatest("cls", "label").alias("cls"), F.least("cls", "label").alias("label")).filter("cls <> label").distinct()
    current = materialize(link(edges), "edges")
    while True:
        both = current.unionAll(current.select(F.col("label").alias("cls"), F.col("cls").alias("label")))
        least = both.groupBy("cls").agg(F.min("label").alias("m")).select("cls", F.least("cls", "m").alias("m"))
        large = link(both.join(least, "cls").filter("label > cls").select(F.col("label").alias("cls"), F.col("m").alias("label")))
        large = materialize(large, "large")
        least = large.groupBy("cls").agg(F.min("label").alias("m"))
        small = large.join(least, "cls")
        small = materialize(link(small.select("label", F.col("m").alias("cls")).unionAll(least.select(F.col("cls").alias("label"), F.col("m").alias("cls")))), "small")
        same = current.exceptAll(small).isEmpty() and small.exceptAll(current).isEmpty()
        current = small
        if same:
            return current.select("cls", F.col("label").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(doc, row, class_id, n_links, first): one row per row of ``docs``.

    n_links: other documents whose shingle sets reach THRESHOLD; class_id: the least key among all that
    links lead to; first: whether this (doc, row) is the one of its class that would stay. Equal sets
    are one class from the start and are never paired. Texts without words stand alone; null text has no words;
    a null key comes last and names no class.
    """
    plain = numbered(docs, key, text).withColumn("row", F.xxhash64("text"))  # one_each names rows alike
    found = materialize(sets(plain), "sets")
    identity = [F.col("size"), F.col("h1"), F.col("h2"), F.when(F.col("size") == 0, F.struct("doc", "row")).alias("alone")]
    least = F.min(F.struct("doc", "row")).alias("least")
    classes = found.groupBy(*identity).agg(least, F.count("*").alias("copies"), F.first("minima").alias("minima"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    some = classes.filter("size > 0").select("cls", "minima", "size", "copies", "least")

    leaf = materialize(leaves(some, recall), "leaves")
    bytes_of = F.concat(*[F.substring("minima", 4 * k + 1, 1) for k in range(TOKENS)])
    mine = leaf.groupBy("cls").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    sketched = some.join(mine, "cls").select("cls", "size", bytes_of.alias("sketch"), "buckets")
    members = leaf.distinct().join(sketched, "cls")
    likely = materialize(candidates(in_blocks(members)), "candidates")

    wanted = likely.select("cls").distinct().join(some.select("cls", "copies", "least.*"), "cls")
    texts = plain.select("doc", "row", "text").join(wanted, ["doc", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in row_groups(offsets):
                value, sizes = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = (np.concatenate([[0], np.cumsum(sizes)]) * 8).astype(np.int32)
                own = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(value.tobytes())])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own], names=["cls", "copies", "shingles"])

    shingled = texts.select("cls", "copies", "text").mapInArrow(run, "cls bigint, copies bigint, shingles binary").dropDuplicates(["cls"])
    checked = materialize(verify(likely.join(shingled, "cls")), "links")
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(checked.select("cls", "label"))
    rooted = classes.select("cls", "least", "copies").join(links, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("top"))
    told = rooted.join(tops, "root").select("cls", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = classes.select("cls", "size", "h1", "h2", F.coalesce("alone", F.struct(F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("row"))).alias("alone")).join(told, "cls")
    each = found.select("doc", "row", "size", "h1", "h2", F.coalesce(identity[3], F.struct(F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("row"))).alias("alone"))
    joined = each.join(told, ["size", "h1", "h2", "alone"])
    return joined.select("doc", "row", F.nullif(F.col("top.doc"), F.lit(LAST)).alias("class_id"), "n_links", (F.struct("doc", "row") == F.col("top")).alias("first"))


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links), one row per row of ``docs``."""
    found = near_duplicates(docs, key, text)
    return found.select(F.nullif("doc", F.lit(LAST)).alias(key), "class_id", "n_links")


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one with the least key stays, once."""
    found = near_duplicates(docs, key, text).filter("first").select(F.col("doc").alias("_doc"), F.col("row").alias("_row")).distinct()
    ident = [F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)).alias("_doc"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_row")]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *ident)
    return marked.join(found, ["_doc", "_row"], "left_semi").dropDuplicates(["_doc", "_row"]).select("whole.*")
