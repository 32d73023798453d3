"""Consistency rules; each returns violations ``(graph_id, component, id, t, problem, solution)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import labels as L
from tendril.operators import graph
from tendril.operators.statistics import life_time


def _row(df: DataFrame, component: str, ident: Column, t: Column, problem, solution) -> DataFrame:
    as_col = lambda s: F.lit(s) if isinstance(s, str) else s
    return df.select(
        "graph_id", F.lit(component).alias("component"), ident.cast("string").alias("id"), t.cast("int").alias("t"),
        as_col(problem).alias("problem"), as_col(solution).alias("solution"),
    )


def tips_without_single_base(vertices: DataFrame, oriented: DataFrame) -> DataFrame:
    """Tips whose path to the root has no base or several."""
    tips = vertices.filter(F.col("node_type") == vocab.TIP).select("graph_id", "v", "t")
    bc = tips.join(oriented.select("graph_id", "v", "base_count"), ["graph_id", "v"], "left").withColumn(
        "base_count", F.coalesce("base_count", F.lit(0))
    )
    none = F.col("base_count") == 0
    return _row(
        bc.filter("base_count <> 1"), "tip", F.col("v"), F.col("t"),
        F.when(none, "no base").otherwise("more than one base"), F.when(none, "add base").otherwise("remove base"),
    )


def incident_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = vertices.select("graph_id", "v", "t", "node_type").join(graph.degrees(vertices, edges), ["graph_id", "v"])
    n, kind = F.col("degree"), F.col("node_type")
    tips = d.filter((kind == vocab.TIP) & (n != 1))
    many = n >= 2
    out = _row(
        tips, "tip", F.col("v"), F.col("t"),
        F.when(many, "more than one incident edge").otherwise("no incident edge"),
        F.when(many, "check problem").otherwise("remove tip"),
    )
    out = out.unionByName(
        _row(d.filter((kind == vocab.BASE) & (n != 2)), "base", F.col("v"), F.col("t"), "not two incident edges", "check problem")
    )
    return out.unionByName(
        _row(d.filter((kind == vocab.BRANCH) & (n < 3)), "branch", F.col("v"), F.col("t"), "too few incident edges", "convert node to point")
    )


def filament_size(vertices: DataFrame, edges: DataFrame, oriented: DataFrame) -> DataFrame:
    tips = _row(
        vertices.filter(F.col("node_type") == vocab.TIP).select("graph_id", "v", "t")
        .join(oriented.select("graph_id", "v", "base_count"), ["graph_id", "v"], "left")
        .filter(F.coalesce("base_count", F.lit(0)) != 1),
        "tip", F.col("v"), F.col("t"), "more or less than one base", "add or remove base",
    )
    nodes, lines = graph.location_labels(oriented, vertices, edges)
    inside = F.col("location") == vocab.FILAMENT_LOCATION
    nv = nodes.filter(inside).groupBy("graph_id", "base_v").agg(F.count(F.lit(1)).alias("nv"))
    ne = lines.filter(inside).groupBy("graph_id", "base_v").agg(F.count(F.lit(1)).alias("ne"))
    small = (
        vertices.filter(F.col("node_type") == vocab.BASE)
        .select("graph_id", F.col("v").alias("base_v"), "t", "object_id")
        .join(nv, ["graph_id", "base_v"], "left")
        .join(ne, ["graph_id", "base_v"], "left")
        .filter((F.coalesce("nv", F.lit(0)) < 2) | (F.coalesce("ne", F.lit(0)) < 1))
    )
    return tips.unionByName(
        _row(small, "filopodium", L.object_label("object_id"), F.col("t"), "too few elements", "check if tip, base and one edge exist")
    )


def repeated_match_ids(vertices: DataFrame) -> DataFrame:
    """One row for every further base with a match id already used in its step."""
    again = (
        vertices.filter((F.col("node_type") == vocab.BASE) & (F.col("match_id") != vocab.UNASSIGNED_ID))
        .groupBy("graph_id", "t", "match_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("_i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    )
    return _row(again, "filopodia", F.lit("?"), F.col("t"), "multiple filopodia with same match ID", "isolate filopodia")


def object_gaps(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects whose bases are not one for each step of their life (an object without any base included), and
    objects with several match ids."""
    real = L.is_real_object("object_id")
    bases = vertices.filter(real & (F.col("node_type") == vocab.BASE)).groupBy("graph_id", "object_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("match_id") != vocab.UNASSIGNED_ID, F.col("match_id"))).alias("n_match")
    )
    d = life_time(vertices, edges).filter(real).join(bases, ["graph_id", "object_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    name = L.object_label("object_id")
    gaps = _row(d.filter("life <> n"), "filopodium", name, F.lit(-1), "has a gap", "fill gap or isolate")
    return gaps.unionByName(_row(d.filter("n_match > 1"), "filopodia", name, F.lit(-1), "contains multiple match IDs", "isolate"))


def time_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements without a step, and edges between two steps. A missing step is NULL here."""
    t = vertices.select("graph_id", "v", "t")
    out = _row(t.filter(F.col("t").isNull()), "node", F.col("v"), F.lit(-1), "no time label", "delete")
    ends = (
        edges.select("graph_id", "e", "src", "dst")
        .join(t.select("graph_id", F.col("v").alias("src"), F.col("t").alias("ts")), ["graph_id", "src"])
        .join(t.select("graph_id", F.col("v").alias("dst"), F.col("t").alias("td")), ["graph_id", "dst"])
        .filter(~F.col("ts").eqNullSafe(F.col("td")))
    )
    out = out.unionByName(_row(ends, "edge", F.col("e"), F.lit(-1), "connects two timesteps", "delete"))
    return out.unionByName(_row(edges.filter(F.col("t").isNull()), "edge", F.col("e"), F.lit(-1), "no time label", "delete"))


def bulbous_gaps(vertices: DataFrame) -> DataFrame:
    span = (
        vertices.filter((F.col("node_type") == vocab.BASE) & (F.col("bulbous") == "BULBOUS"))
        .groupBy("graph_id", "object_id")
        .agg((F.max("t") - F.min("t") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
        .filter("span <> n")
    )
    return _row(span, "filopodia", L.object_label("object_id"), F.lit(-1), "incomplete bulbous label", "extend bulbous label")


def violations(vertices: DataFrame, edges: DataFrame, oriented: DataFrame | None = None) -> DataFrame:
    """The whole table: empty means the graph is fit for statistics."""
    oriented = graph.orient(vertices, edges) if oriented is None else oriented
    parts = [
        bulbous_gaps(vertices),
        time_labels(vertices, edges),
        object_gaps(vertices, edges),
        tips_without_single_base(vertices, oriented),
        incident_edges(vertices, edges),
        filament_size(vertices, edges, oriented),
        repeated_match_ids(vertices),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_consistent(table: DataFrame) -> None:
    """Statistics are refused while violations exist."""
    if not table.isEmpty():
        raise ValueError("the graph has consistency violations; see the violations table")


def step_coverage(steps: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Per key: duplicate steps and gaps. ``steps`` has one row per file or element."""
    per = steps.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(
        F.min(t).alias("min_t"), F.max(t).alias("max_t"), F.count(F.lit(1)).alias("n_steps"),
        F.count_if(F.col("_n") > 1).alias("n_duplicate"),
        (F.max(t) - F.min(t) + 1 - F.count(F.lit(1))).cast("bigint").alias("n_missing"),
    )


def interval_fill(df: DataFrame, keys: list[str], t: str, flag: Column, name: str = "filled") -> DataFrame:
    """Marks every row between the first and the last flagged step of its key.

    The interval is an aggregate joined back, so a hot key is aggregated map-side first.
    """
    span = df.filter(flag).groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return df.join(span, keys, "left").withColumn(name, F.coalesce(F.col(t).between(F.col("_lo"), F.col("_hi")), F.lit(False))).drop("_lo", "_hi")


def track_ends(items: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Flags subtrack starts and ends: the neighbour step is empty; the first step of all has
    no starts and the last no ends. ``items`` has one row per key and step."""
    bounds = items.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    w = Window.partitionBy(*keys).orderBy(t)  # one row per key and step, bounded by the label format
    starts = ~(F.coalesce(F.lag(t).over(w), F.lit(-(10**6))) == F.col(t) - 1) & (F.col(t) > bounds.select("lo").scalar())
    ends = ~(F.coalesce(F.lead(t).over(w), F.lit(-(10**6))) == F.col(t) + 1) & (F.col(t) < bounds.select("hi").scalar())
    return items.withColumn("is_start", starts).withColumn("is_end", ends)
