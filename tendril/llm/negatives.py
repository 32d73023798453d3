"""Hard negatives: along a spanning tree of the anchors, the scores of a parent bound those of its children.

A candidate's score with a child differs from that with its parent by at most the length of the edge times the
candidate's norm. Only candidates whose bounds touch the wanted window are scored again; the others keep
their bounds, which widen on the way down. Anchors are taken in groups of bounded size, each of which passes over all
candidates once, so no candidate is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import materialize

#: Anchors of a group, and candidates that are bounded at a time.
ANCHORS, ROWS = 2048, 2048
#: A sum of products below this is exact in floats.
EXACT = 2.0**52
LIMIT = (1 << 63) - 1
FOUND = "anchor bigint, positive bigint, other bigint, id bigint, score bigint"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero beyond the end of shorter ones."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    of = np.repeat(np.arange(len(column)), lengths)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def prepared(vectors: DataFrame, scale: int, key: str, vector: str, label: Column) -> DataFrame:
    """(rid, id, label, v): whole numbers ``floor(scale * x)``, and a number of each row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows with equal ids are rows of
    their own.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v"),
    )
    whole = plain.filter("id is not null and label is not null and v is not null").filter(good)
    # rint of a floor keeps it a float: numbers beyond a long stay what they are.
    return whole.withColumn("v", F.transform("v", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)))


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): anchors in an order in which parents come first; the parent in that order (-1: root) and the distance."""
    n = len(a)
    square = (a**2).sum(1)
    best, parent = np.full(n, np.inf), np.full(n, -1)
    order, place, edge = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n)
    now = int(np.argmin(((a - a.mean(0)) ** 2).sum(1)))
    left = np.ones(n, bool)
    for k in range(n):
        order[k], place[now], left[now] = now, k, False
        if parent[now] >= 0:
            edge[k] = np.sqrt(((a[now] - a[parent[now]]) ** 2).sum())
        far = square + square[now] - 2 * (a @ a[now])
        nearer = left & (far < best)
        best[nearer], parent[nearer] = far[nearer], now
        now = int(np.argmin(np.where(left, best, np.inf)))
    up = parent[order]
    return order, np.where(up >= 0, place[up], -1), edge


def scores(c: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers, exact also where floats would round; beyond a long they are its bound."""
    if exact or not len(c):
        return (c @ a).astype(np.int64)
    whole = [int(x) for x in a]
    return np.array([max(-LIMIT, min(LIMIT, sum(int(x) * y for x, y in zip(row, whole, strict=True)))) for row in c], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > 8 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
        return among[np.lexsort((ids[among], -score[among]))[:k]]
    return np.lexsort((ids, -score))[:k]


def walk(tree: dict, c: np.ndarray, wanted: Callable, use: Callable) -> int:
    """Goes down the tree for a block of candidates; returns how many scores it computed.

    ``wanted(i, low, high)`` tells which candidates may matter to anchor i by the bounds of their scores;
    ``use(i, at, scores)`` takes the true scores of those.
    """
    a, parent, edge = tree["v"], tree["parent"], tree["edge"]
    norms, lengths = np.sqrt((c**2).sum(1)), tree["norms"]
    exact = (norms.max(initial=0) + 1) * (lengths.max(initial=0) + 1) < EXACT
    low, high = np.empty((2, len(a), len(c)))
    done = 0
    for i in range(len(a)):
        up = parent[i]
        if up < 0:
            low[i], high[i] = -norms * lengths[i], norms * lengths[i]
        else:
            reach = norms * (edge[i] * (1 + 1e-9) + 1e-9 * (lengths[i] + lengths[up])) + 1e-6
            np.subtract(low[up], reach, out=low[i])
            np.add(high[up], reach, out=high[i])
        at = np.flatnonzero(wanted(i, low[i], high[i])) if up >= 0 else np.arange(len(c))
        if len(at):
            found = scores(c[at], a[i], exact)
            low[i, at] = high[i, at] = found.astype(np.float64)
            done += len(at)
            if up < 0:
                keep = wanted(i, low[i], high[i])
                at, found = at[keep], found[keep]
            use(i, at, found)
    return done


class Tops:
    """The k best (score, id, row) of each slot seen so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.least, self.held = k, np.full(slots, -np.inf), [None] * slots

    def add(self, slot: int, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        if not len(score):
            return
        if self.held[slot] is not None:
            score, ids, rids = (np.concatenate(x) for x in zip(self.held[slot], (score, ids, rids), strict=True))
        at = best(score, ids, self.k)
        self.held[slot] = score[at], ids[at], rids[at]
        if len(at) == self.k:
            self.least[slot] = float(score[at[-1]])

    def rows(self, anchors: np.ndarray, positives: np.ndarray) -> pa.RecordBatch:
        some = [i for i, x in enumerate(self.held) if x is not None]
        n = [len(self.held[i][0]) for i in some]
        kept = [np.concatenate([self.held[i][j] for i in some]) if some else np.empty(0, np.int64) for j in (2, 1, 0)]
        columns = [np.repeat(anchors[some], n), np.repeat(positives[some], n), *kept]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["anchor", "positive", "other", "id", "score"])


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(rids, ids, labels, matrix) of bounded runs of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield *(part.column(j).to_numpy() for j in range(3)), matrix(part.column(3), width)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key; each task sends k at most."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, every: int = 100, n_positives: int = 5, k: int = 10, shares: tuple[int, int] = (30, 90), scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; positives the first rows of the same label; negatives
    the first ``k`` of another label whose score lies within ``shares`` percent of the positive's. Scores are inner products
    of ``floor(scale * x)``; ties go to the smaller id. Two passes over all rows for each group of anchors: one for
    the positives, one for the negatives. Shorter vectors count as zero beyond their end. Rows with equal ids are
    rows of their own, also as anchors. A score beyond a long is its bound, also when compared.
    """
    spark = vectors.sparkSession
    whole = materialize(prepared(vectors, scale, key, vector, F.col(f"`{label}`") if isinstance(label, str) else label), "rows")
    width = whole.agg(F.max(F.size("v"))).first()[0] or 0
    asked = whole.filter(F.pmod("id", F.lit(every)) == 0)
    groups = -(-asked.count() // ANCHORS)
    out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not width or not groups:
        return out
    parted = materialize(asked.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")), "anchors")
    columns = whole.select("rid", "id", "label", "v")

    def planted(table: pa.Table) -> pa.Table:
        """The spanning tree of a group, as one row."""
        rid, ids, labels = (table.column(c).to_numpy() for c in ("rid", "id", "label"))
        v = matrix(table.column("v").combine_chunks(), width)
        order, parent, edge = spanning_tree(v)
        raw = [x.tobytes() for x in (rid[order], ids[order], labels[order], v[order], parent, edge)]
        return pa.table({"part": table.column("part")[:1], **{n: pa.array([x], pa.binary()) for n, x in zip(["rid", "id", "label", "v", "parent", "edge"], raw, strict=True)}})

    trees = materialize(parted.groupBy("part").applyInArrow(planted, "part int, rid binary, id binary, label binary, v binary, parent binary, edge binary"), "trees")

    def tree_of(part: int) -> dict | None:
        """One group's tree: at most about ANCHORS vectors."""
        row = trees.filter(F.col("part") == part).first()
        if row is None:
            return None
        tree = {n: np.frombuffer(row[n], np.float64 if n in ("v", "edge") else np.int64) for n in ("rid", "id", "label", "v", "parent", "edge")}
        tree["v"] = tree["v"].reshape(-1, width)
        tree["norms"] = np.sqrt((tree["v"] ** 2).sum(1))
        return tree

    def positives(tree: dict):
        shared = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            tops = Tops(len(tree["rid"]), n_positives)
            for rids, ids, labels, c in blocks(batches, width):
                wanted = lambda i, low, high: (labels == tree["label"][i]) & (rids != tree["rid"][i]) & (high >= tops.least[i])  # noqa: E731, B023
                walk(tree, c, wanted, lambda i, at, s: tops.add(i, s, ids[at], rids[at]))  # noqa: B023
            yield tops.rows(tree["rid"], np.zeros(len(tree["rid"]), np.int64))

        return columns.mapInArrow(run, FOUND)

    def negatives(tree: dict, told: list):
        """``told``: (anchor, positive, score) of the group."""
        n = len(tree["rid"])
        at = {r: i for i, r in enumerate(tree["rid"].tolist())}
        slots = [[] for _ in range(n)]
        for s, row in enumerate(told):
            slots[at[row.anchor]].append(s)
        # Bounds in whole numbers: -(-a // b) rounds up, a // b down.
        low = np.array([-(-shares[0] * row.score // 100) for row in told], object)
        high = np.array([shares[1] * row.score // 100 for row in told], object)
        names = [np.array([getattr(row, c) for row in told], np.int64) for c in ("anchor", "other")]
        shared = spark.sparkContext.broadcast((tree, slots, low, high, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, slots, low, high, (anchors, others) = shared.value
            tops = Tops(len(low), k)
            least, most = low.astype(np.float64), high.astype(np.float64)
            top = np.array([max((most[s] for s in own), default=-np.inf) for own in slots])
            top += 1e-9 * np.abs(np.where(np.isfinite(top), top, 0))
            for rids, ids, labels, c in blocks(batches, width):

                def wanted(i, under, over):
                    own = slots[i]
                    if not own:
                        return np.zeros(len(under), bool)
                    bottom = min(max(least[s] - 1e-9 * abs(least[s]), tops.least[s]) for s in own)
                    return (labels != tree["label"][i]) & (over >= bottom) & (under <= top[i])  # noqa: B023

                def use(i, at, s):
                    for slot in slots[i]:
                        inside = np.flatnonzero((s >= low[slot]) & (s <= high[slot]))
                        tops.add(slot, s[inside], ids[at[inside]], rids[at[inside]])  # noqa: B023

                walk(tree, c, wanted, use)
            yield tops.rows(anchors, others)

        return columns.mapInArrow(run, FOUND)

    names = parted.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    for part in range(groups):
        tree = tree_of(part)
        if tree is None:
            continue
        first = materialize(first_of(positives(tree), ["anchor"], n_positives), "positives")
        told = first.collect()  # at most n_positives for each anchor of the group
        if not told:
            continue
        found = materialize(first_of(negatives(tree, told), ["anchor", "positive"], k), "negatives")
        pairs = first.select("anchor", F.col("other").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        rows = found.join(pairs, ["anchor", "positive"]).join(names, "anchor")
        out = out.unionByName(rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def relabelled(key: str = "vec_id", label: str = "label") -> Column:
    """Labels of which those of ids divisible by 7 are made wrong, to be found again as negatives."""
    own = F.col(f"`{label}`")
    return F.when(F.col(f"`{key}`") % 7 == 0, (own + 1) % 10).otherwise(own)


def oracle() -> str:
    return """
with g as materialized (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.rid as ar, a.vec_id as anchor_id, c.rid as cr, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from g a join g c on a.rid <> c.rid where a.vec_id % 100 = 0),
p as materialized (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, cr) <= 5),
r as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.ar, p.cr order by s.score desc, s.vec_id, s.cr)::integer as rank,
    s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.ar = p.ar and not s.same where 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select * from r where rank <= 10"""
