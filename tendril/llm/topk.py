"""Exact inner-product top k: longest vectors first, partial sums along rotated axes, Cauchy-Schwarz for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import materialize

#: Rows whose second moments give the axes; any rotation is right, a fitted one prunes more.
SAMPLE = 4096
ROWS, QUERIES = 2048, 512
#: Axes that the partial sums take.
LEADING = 16


def grid(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(id, v array<bigint>, norm2): ``floor(scale * x)``; rows with null or non-finite parts take no part.

    Repeated rows count once. A null id can be no answer and takes no part either.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v"))
    plain = plain.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(good)
    whole = plain.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()
    return whole.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero beyond the end of shorter ones."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    of = np.repeat(np.arange(len(column)), lengths)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def axes(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, the widest direction first."""
    return np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(q_ids, q, floor, c_ids, c, rotation, k):
    """Top k of one block of queries in one block of candidates, the longest candidates first.

    ``floor``: for each query a score that k candidates reach already. A candidate is scored only if the
    bound of its score is not below it; the bounds carry a margin for the rounding of floats, and
    the scores are sums of integers.
    """
    norms = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    c_ids, c, norms = c_ids[order], c[order], norms[order]
    q_norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    exact_floats = (norms.max(initial=0) + 1) * (q_norms.max(initial=0) + 1) < 2.0**52
    qr, cr = q @ rotation, c @ rotation
    lead = min(LEADING, rotation.shape[1])
    q_rest, c_rest = (np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0)) for x in (qr, cr))
    slack = 1e-9 * np.outer(q_norms, norms) + 1e-6
    bound = qr[:, :lead] @ cr[:, :lead].T + np.outer(q_rest, c_rest) + slack
    out = []
    for i in range(len(q_ids)):
        reach = int(np.searchsorted(-(norms * q_norms[i] * (1 + 1e-9) + 1e-6), -floor[i], "right"))
        at = np.flatnonzero(bound[i, :reach] >= floor[i])
        at = at[c_ids[at] != q_ids[i]]
        if not len(at):
            continue
        if exact_floats:
            scores = (c[at].astype(np.float64) @ q[i].astype(np.float64)).astype(np.int64)
        else:
            scores = c[at] @ q[i]
        top = best(scores, c_ids[at], k)
        out.append((np.full(len(top), q_ids[i]), c_ids[at[top]], scores[top]))
    return out


def pack_rows(frame: DataFrame, ordered: list, width: int, rows: int) -> DataFrame:
    """Blocks of vectors in the given order: (part, longest, ids, v) with packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                v = matrix(part.column(1), width)
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.max(part.column(2).to_numpy()))]), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["longest", "ids", "v"])

    dealt = frame.repartitionByRange(*ordered).sortWithinPartitions(*ordered) if ordered else frame
    return dealt.select("id", "v", "norm2").mapInArrow(run, "longest double, ids binary, v binary")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k best others.

    All candidates are seen by each query block, in blocks sorted by length. The blocks of the longest
    vectors run first and give every query a floor; the rest run in parallel against it. A vector that
    many rows share makes ties only: within a block they end with the smaller ids. Shorter vectors
    count as zero beyond their end; components beyond 2**40 after scaling are outside its range. A query
    id with several different vectors is answered for each and the better score of each partner counts.
    """
    spark = vectors.sparkSession
    whole = materialize(grid(vectors, scale, key, vector), "grid")
    width = whole.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sampled = np.zeros((max(1, len(sample)), width))
    for i, v in enumerate(sample):
        sampled[i, : len(v)] = v
    rotation = axes(sampled)

    asked = whole.filter(F.pmod("id", F.lit(every)) == 0)
    groups = max(1, -(-asked.count() // QUERIES))

    def together(part: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pa.array(part["v"]), width)
        return pd.DataFrame({"part": [int(part["part"].iloc[0])], "q_ids": [part["id"].to_numpy(np.int64).tobytes()], "q": [v.tobytes()]})

    parted = asked.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("part"))
    questions = materialize(parted.groupBy("part").applyInPandas(together, "part int, q_ids binary, q binary"), "questions")
    order = [F.col("norm2").desc(), F.col("id"), F.col("v")]
    blocks = materialize(pack_rows(whole, order, width, ROWS), "blocks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cut = blocks.filter("part = 0").selectExpr("percentile(longest, 0.95) as cut").first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.names.index(name))[row].as_py()  # noqa: E731, B023
                q_ids, c_ids = (np.frombuffer(get(x), np.int64) for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(get(x), np.int64).reshape(-1, width) for x in ("q", "v"))
                floor = np.frombuffer(get("floors"), np.float64) if get("floors") is not None else np.full(len(q_ids), -np.inf)
                found = search_block(q_ids, q, floor, c_ids, c, rotation, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    schema = "query_id bigint, vec_id bigint, score bigint"

    def scan(part: DataFrame, asked: DataFrame) -> DataFrame:
        return part.join(asked, "part").select("ids", "v", "q_ids", "q", "floors").repartition(F.xxhash64("ids", "q_ids")).mapInArrow(run, schema)

    def final(found: DataFrame) -> DataFrame:
        pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col("vec_id").alias("vec_id")))), 1, k)
        each = pairs.groupBy("query_id").agg(ranked.alias("top"))
        return each.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.low")).alias("score"))

    first = materialize(scan(blocks.filter(F.col("longest") >= cut), questions.withColumn("floors", F.lit(None).cast("binary"))), "longest")
    reached = final(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))

    def floors(part: pd.DataFrame) -> pd.DataFrame:
        by_id = dict(zip(part["id"].dropna().astype("int64"), part["floor"].dropna(), strict=True))
        row = part.loc[part["q_ids"].notna()].iloc[0]
        ids = np.frombuffer(row["q_ids"], np.int64)
        values = np.array([by_id.get(i, -np.inf) for i in ids.tolist()], np.float64)
        return pd.DataFrame({"part": [int(row["part"])], "q_ids": [row["q_ids"]], "q": [row["q"]], "floors": [values.tobytes()]})

    per_part = parted.select("id", "part").distinct().join(reached, "id").select("part", "id", "floor", F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q"))
    mine = questions.select("part", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("floor"), "q_ids", "q")
    armed = materialize(per_part.unionByName(mine).groupBy("part").applyInPandas(floors, "part int, q_ids binary, q binary, floors binary"), "floors")
    rest = scan(blocks.filter(F.col("longest") < cut), armed)
    return final(first.unionByName(rest))


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    return f"""
with g as materialized (select distinct vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, max(list_inner_product(q.v, c.v))::bigint as score
  from g q join g c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""
