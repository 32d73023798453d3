"""Selections: filters that yield element keys, and the algebra on key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril import vocab

VKEY = ("graph_id", "v")
EKEY = ("graph_id", "e")


def where(elements: DataFrame, condition: Column, key: tuple[str, ...]) -> DataFrame:
    return elements.filter(condition).select(*key)


def of_step(elements: DataFrame, t: int) -> DataFrame:
    return elements.filter(F.col("t") == t)


def of_type(vertices: DataFrame, node_type: str, t: int | None = None, within: DataFrame | None = None) -> DataFrame:
    out = vertices.filter(F.col("node_type") == node_type)
    if t is not None:
        out = of_step(out, t)
    return out if within is None else out.join(within.select(*VKEY), list(VKEY), "left_semi")


def of_object(elements: DataFrame, object_id: int, t: int | None = None) -> DataFrame:
    out = elements.filter(F.col("object_id") == object_id)
    return out if t is None else of_step(out, t)


def of_location(elements: DataFrame, location: str, t: int | None = None) -> DataFrame:
    out = elements.filter(F.col("location") == location)
    return out if t is None else of_step(out, t)


def visible(elements: DataFrame, current: int, before: int, after: int, hide_core: bool = False) -> DataFrame:
    out = elements.filter(F.col("t").between(current - before, current + after))
    return out.filter(~F.col("location").eqNullSafe(F.lit(vocab.CORE_LOCATION))) if hide_core else out


def spans_steps(selection: DataFrame) -> DataFrame:
    """One row: does the selection touch more than one time step?"""
    return selection.agg((F.count_distinct("t") > 1).alias("several_steps"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def complement(selection: DataFrame, elements: DataFrame) -> DataFrame:
    return difference(elements.select(*selection.columns), selection)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: same key sets, decided by one full join without collecting keys."""
    keys = a.columns
    left = a.distinct().withColumn("_a", F.lit(True))
    right = b.distinct().withColumn("_b", F.lit(True))
    odd = F.col("_a").isNull() | F.col("_b").isNull()
    return left.join(right, keys, "full").agg((F.count_if(odd) == 0).alias("equal"))


def subgraph(vertices: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected vertices and the edges with both ends among them."""
    keep = chosen.select(*VKEY).distinct()
    lines = edges
    for end in ("src", "dst"):
        lines = lines.join(keep.withColumnRenamed("v", end), ["graph_id", end], "left_semi")
    return vertices.join(keep, list(VKEY), "left_semi"), lines


def merge_graphs(graphs: list[DataFrame], steps: list[int], key: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """One table from a graph per step: the step is stamped on and ids are made unique by it.

    ``ends`` are the columns that hold ids of another table (``src`` and ``dst`` of edges) and change alike; pass the
    same steps for both tables.
    """
    if len(set(steps)) < len(steps) or min(steps, default=0) < 0:
        raise ValueError("steps must be different and not negative")
    width, out = max(vocab.MAX_STEPS, max(steps, default=0) + 1), None
    for df, t in zip(graphs, steps, strict=True):
        part = df.withColumn("t", F.lit(t)).withColumns({c: F.col(c) * width + t for c in (key, *ends)})
        out = part if out is None else out.unionByName(part)
    return out
