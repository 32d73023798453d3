"""Graph operators as rounds of joins over vertex and edge tables.

Rounds read and write stored tables, so each join has plain scans on both sides and the
adaptive skew join can split a hub node's rows. The side keyed by vertex id is unique.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions.ordered import neighbours
from tendril.session import materialize

VKEY = ["graph_id", "v"]
SMALL = 1_000_000  # links a single task can hold without harm


def both_ways(edges: DataFrame) -> DataFrame:
    """``(graph_id, e, a, b)``: every edge once per direction."""
    return edges.select(
        "graph_id", "e", F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                                          F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    )


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, v, degree)``, isolated vertices included; a loop counts twice."""
    deg = both_ways(edges).groupBy("graph_id", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select(*VKEY).join(deg, VKEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def types_by_degree(vertices: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Node types from the degree: 1 tip, 2 base, 3 or more branching; given roots stay roots.

    An isolated vertex that is not a root is an error.
    """
    d = degrees(vertices, edges)
    if roots is not None:
        d = d.join(roots.select(*VKEY).distinct().withColumn("_root", F.lit(True)), VKEY, "left")
    else:
        d = d.withColumn("_root", F.lit(None).cast("boolean"))
    kind = (
        F.when(F.col("_root"), vocab.ROOT)
        .when(F.col("degree") == 0, F.raise_error(F.lit("isolated vertex has no type")))
        .when(F.col("degree") == 1, vocab.TIP)
        .when(F.col("degree") == 2, vocab.BASE)
        .otherwise(vocab.BRANCH)
    )
    return d.select(*VKEY, "degree", kind.alias("node_type"))


def edge_lengths(points: DataFrame, compat_edges: DataFrame | None = None) -> DataFrame:
    """``(graph_id, e, length)`` of polylines in long form.

    With ``compat_edges`` every listed edge appears, and one without points has length -1.
    """
    steps = neighbours(points, ["graph_id", "e"], "ord", ["x", "y", "z"], back="p")
    seg = sum_of_squares("x", "y", "z")
    out = steps.groupBy("graph_id", "e").agg(F.sum(F.coalesce(F.sqrt(seg), F.lit(0.0))).alias("length"))
    if compat_edges is not None:
        out = compat_edges.select("graph_id", "e").join(out, ["graph_id", "e"], "left")
        out = out.withColumn("length", F.coalesce("length", F.lit(-1.0)))
    return out


def sum_of_squares(*cols: str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        d = F.col(c) - F.col(f"p.{c}")
        total = total + d * d
    return total


def orient(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first orientation away from the root nodes.

    ``(graph_id, v, parent, parent_edge, depth, base_count, base_v)``: ``base_count`` is the
    number of BASE nodes on the path to the root (both ends included), ``base_v`` the last one
    met on the way out. Unreachable vertices are absent. One round per tree level.
    """
    kinds = vertices.select(*VKEY, "node_type")
    adj = materialize(
        both_ways(edges).join(kinds.withColumnRenamed("v", "b"), ["graph_id", "b"]), "adjacency"
    )
    front = materialize(
        kinds.filter(F.col("node_type") == vocab.ROOT).select(
            "graph_id",
            "v",
            F.lit(None).cast("bigint").alias("parent"),
            F.lit(None).cast("bigint").alias("parent_edge"),
            F.lit(0).alias("depth"),
            F.lit(0).alias("base_count"),
            F.lit(None).cast("bigint").alias("base_v"),
        ),
        "roots",
    )
    levels = [front]
    for depth in itertools.count(1):
        step = adj.join(front.withColumnRenamed("v", "a"), ["graph_id", "a"]).filter(
            F.col("parent_edge").isNull() | (F.col("e") != F.col("parent_edge"))
        )
        is_base = F.col("node_type") == vocab.BASE
        cand = step.select(
            "graph_id",
            F.col("b").alias("v"),
            F.struct(
                F.col("a").alias("parent"),
                F.col("e").alias("parent_edge"),
                (F.col("base_count") + is_base.cast("int")).alias("base_count"),
                F.when(is_base, F.col("b")).otherwise(F.col("base_v")).alias("base_v"),
            ).alias("s"),
        )
        best = cand.groupBy(*VKEY).agg(F.min("s").alias("s"))
        for seen in levels[-2:]:  # neighbours of level k lie in levels k-1, k and k+1 only
            best = best.join(seen.select(*VKEY), VKEY, "left_anti")
        front = materialize(
            best.select(*VKEY, "s.parent", "s.parent_edge", F.lit(depth).alias("depth"), "s.base_count", "s.base_v"),
            "level",
        )
        if front.isEmpty():
            return _union(levels)
        levels.append(front)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def location_labels(oriented: DataFrame, vertices: DataFrame, edges: DataFrame, strict: bool = False):
    """Core or filament location of vertices and edges.

    An element is filament when its path to the root has exactly one BASE and core when it
    has none; more is an error (``strict``) or a NULL location. An edge takes the location of
    its source unless that is a BASE, then of its target. Roots are core.
    """
    kinds = vertices.select(*VKEY, "node_type")
    bad = F.raise_error(F.lit("more than one base on a path")).cast("string") if strict else F.lit(None).cast("string")
    label = (
        F.when(F.col("node_type") == vocab.ROOT, vocab.CORE_LOCATION)
        .when(F.col("base_count") == 0, vocab.CORE_LOCATION)
        .when(F.col("base_count") == 1, vocab.FILAMENT_LOCATION)
        .otherwise(bad)
    )
    nodes = oriented.join(kinds, VKEY).select(*VKEY, "node_type", "base_count", "base_v", label.alias("location"))
    s = nodes.select("graph_id", F.col("v").alias("src"), F.col("node_type").alias("_st"), F.struct("location", "base_v").alias("_s"))
    d = nodes.select("graph_id", F.col("v").alias("dst"), F.struct("location", "base_v").alias("_d"))
    picked = F.when(F.col("_st") == vocab.BASE, F.col("_d")).otherwise(F.col("_s"))
    lines = (
        edges.select("graph_id", "e", "src", "dst")
        .join(s, ["graph_id", "src"])
        .join(d, ["graph_id", "dst"])
        .withColumn("_p", picked)
        .select("graph_id", "e", "_p.location", "_p.base_v")
    )
    return nodes.select(*VKEY, "location", "base_count", "base_v"), lines


def core_membership(oriented: DataFrame, edges: DataFrame) -> DataFrame:
    """On-demand membership of edges: core if either end has no BASE on its path, filament if
    both have exactly one, NULL otherwise (an error in the data)."""
    bc = oriented.select("graph_id", "v", "base_count")
    s = bc.select("graph_id", F.col("v").alias("src"), F.col("base_count").alias("_bs"))
    d = bc.select("graph_id", F.col("v").alias("dst"), F.col("base_count").alias("_bd"))
    where = F.when(F.least("_bs", "_bd") == 0, vocab.CORE_LOCATION).when(
        (F.col("_bs") == 1) & (F.col("_bd") == 1), vocab.FILAMENT_LOCATION
    )
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", "e", where.alias("location"))


def root_paths(oriented: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(graph_id, target, hop, v, e, reversed)``: paths from the root to each target.

    ``hop`` counts from the target (0) to the root, ``e`` is the edge towards the root and
    ``reversed`` tells that the edge points towards the root. Walks that reach a root leave
    the loop, so the busiest vertex is never joined again.
    """
    links = materialize(
        oriented.filter(F.col("parent").isNotNull())
        .select("graph_id", "v", "parent", "parent_edge")
        .join(edges.select("graph_id", F.col("e").alias("parent_edge"), "src"), ["graph_id", "parent_edge"])
        .select("graph_id", "v", "parent", F.col("parent_edge").alias("e"), (F.col("src") == F.col("v")).alias("reversed")),
        "links",
    )
    cur = targets.select("graph_id", F.col("v").alias("target"), "v")
    parts, hop = [], 0
    while True:
        walked = materialize(
            cur.join(links, VKEY, "left").select("graph_id", "target", F.lit(hop).alias("hop"), "v", "e", "reversed", "parent"),
            "hop",
        )
        parts.append(walked.drop("parent"))
        cur = walked.filter(F.col("parent").isNotNull()).select("graph_id", "target", F.col("parent").alias("v"))
        hop += 1
        if cur.isEmpty():
            return _union(parts)


def until_branching(oriented: DataFrame, vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """``(graph_id, target, v)``: from each target towards the root, up to and including the
    first branching or root node above it."""
    kinds = vertices.select(*VKEY, "node_type")
    links = materialize(oriented.select(*VKEY, "parent").join(kinds, VKEY), "links")
    cur = targets.select("graph_id", F.col("v").alias("target"), "v")
    parts, first = [], True
    while True:
        walked = materialize(cur.join(links, VKEY), "hop")
        parts.append(walked.select("graph_id", "target", "v"))
        stop = F.col("node_type").isin(vocab.BRANCH, vocab.ROOT) & F.lit(not first)
        cur = walked.filter(~stop & F.col("parent").isNotNull()).select("graph_id", "target", F.col("parent").alias("v"))
        first = False
        if cur.isEmpty():
            return _union(parts)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every id in ``pairs``; the component is its least id.

    Alternates two contraction steps: neighbours above a vertex are linked to the least
    vertex around it, then neighbours below are. The edge count never grows and the number
    of rounds is about the logarithm of the component size. The minimum per vertex is a
    partial aggregate, so a hub costs no more than its rows.
    """
    ids = pairs.select(F.col(a).alias("id")).unionByName(pairs.select(F.col(b).alias("id"))).distinct()
    links = materialize(
        pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col("hi") != F.col("lo")).distinct(),
        "links",
    )
    # Stored aggregates let the adaptive join split a hub's rows; small graphs need no split.
    keep = (lambda df, tag: df) if links.count() < SMALL else materialize
    mark = None
    while True:
        around = links.select(F.col("hi").alias("u"), F.col("lo").alias("w")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("w"))
        )
        least = keep(around.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m")), "least")
        large = keep(
            around.filter(F.col("w") > F.col("u")).join(least, "u").select(F.col("w").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large",
        )
        floor = keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "floor")
        small = (
            large.join(floor, "hi")
            .filter(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(floor.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        links = materialize(small, "links")
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == mark:
            return ids.join(links.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left").select(
                "id", F.coalesce("component", "id").alias("component")
            )
        mark = seen


def filament_components(vertices: DataFrame, edges: DataFrame, location: str = vocab.FILAMENT_LOCATION) -> DataFrame:
    """Connected pieces of the elements at one location: ``(graph_id, v, component)``.

    Edges of that location connect their end points when those carry it as well.
    """
    inside = vertices.filter(F.col("location") == location).select(*VKEY)
    lines = edges.filter(F.col("location") == location).select("graph_id", "src", "dst")
    for end in ("src", "dst"):
        lines = lines.join(inside.withColumnRenamed("v", end), ["graph_id", end], "left_semi")
    linked = components(
        lines.select(F.struct("graph_id", F.col("src").alias("v")).alias("a"), F.struct("graph_id", F.col("dst").alias("v")).alias("b")),
        "a",
        "b",
    ).select("id.graph_id", "id.v", F.col("component.v").alias("component"))
    return inside.join(linked, VKEY, "left").withColumn("component", F.coalesce("component", "v"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``e`` of the minimum spanning forest of ``edges(e, a, b, w)``; ties by ``e``.

    Each round every tree picks its lightest outgoing edge and the picked edges are
    contracted, which at least halves the number of trees.
    """
    live = materialize(edges.select("e", F.col("a").alias("ca"), F.col("b").alias("cb"), "w").filter("ca <> cb"), "live")
    chosen: list[DataFrame] = []
    while True:
        if live.isEmpty():
            break
        offers = live.select(F.col("ca").alias("c"), "w", "e", "ca", "cb").unionByName(
            live.select(F.col("cb").alias("c"), "w", "e", "ca", "cb")
        )
        picks = offers.groupBy("c").agg(F.min(F.struct("w", "e", "ca", "cb")).alias("p"))
        step = materialize(picks.select("p.e", "p.ca", "p.cb").distinct(), "picks")
        chosen.append(step.select("e"))
        groups = materialize(components(step, "ca", "cb"), "groups")
        live = (
            live.join(groups.select(F.col("id").alias("ca"), F.col("component").alias("na")), "ca")
            .join(groups.select(F.col("id").alias("cb"), F.col("component").alias("nb")), "cb")
            .filter("na <> nb")
            .select("e", F.col("na").alias("ca"), F.col("nb").alias("cb"), "w")
        )
        live = materialize(live, "live")
    return _union(chosen) if chosen else live.select("e")


def threshold_clusters(edges: DataFrame, limit: float) -> DataFrame:
    """Single-linkage clusters: components over edges not longer than ``limit``."""
    return components(edges.filter(F.col("w") <= limit), "a", "b")


def triangles(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All 3-cliques ``(p, q, r)`` of an undirected graph.

    Edges point from the end with fewer neighbours to the other, which bounds the fan-out of
    every vertex by the square root of the edge count: a hub starts no wedge at all.
    """
    links = pairs.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).filter("p <> q").distinct()
    deg = links.select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    graded = materialize(
        links.join(deg.select(F.col("id").alias("p"), F.struct("n", "id").alias("dp")), "p")
        .join(deg.select(F.col("id").alias("q"), F.struct("n", "id").alias("dq")), "q")
        .select(
            F.when(F.col("dp") < F.col("dq"), F.col("p")).otherwise(F.col("q")).alias("s"),
            F.when(F.col("dp") < F.col("dq"), F.col("q")).otherwise(F.col("p")).alias("d"),
        ),
        "graded",
    )
    wedge = graded.select("s", F.col("d").alias("d1")).join(graded.select("s", F.col("d").alias("d2")), "s").filter("d1 < d2")
    closing = graded.select(F.least("s", "d").alias("d1"), F.greatest("s", "d").alias("d2"))
    tri = F.array_sort(F.array("s", "d1", "d2"))
    return wedge.join(closing, ["d1", "d2"]).select(tri[0].alias("p"), tri[1].alias("q"), tri[2].alias("r"))


def cliques(pairs: DataFrame, size: int, a: str = "a", b: str = "b") -> DataFrame:
    """Cliques of exactly ``size`` vertices as sorted arrays, grown one vertex at a time.

    Each clique of k vertices is extended by later vertices adjacent to its last one, then
    checked against the others by semi joins.
    """
    links = materialize(pairs.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).filter("p <> q").distinct(), "links")
    grown = links.select(F.array("p", "q").alias("members"))
    if size >= 3:
        grown = triangles(links, "p", "q").select(F.array("p", "q", "r").alias("members"))
    for k in range(3, size):
        grown = grown.withColumn("p", F.element_at("members", k)).join(links, "p")
        for i in range(1, k):
            grown = grown.join(
                links.select(F.col("p").alias("_m"), F.col("q").alias("_q")),
                (F.element_at("members", i) == F.col("_m")) & (F.col("q") == F.col("_q")),
                "left_semi",
            )
        grown = materialize(grown.select(F.concat("members", F.array("q")).alias("members")), "cliques")
    return grown


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, v, dist, pred)`` over undirected ``edges(a, b, w)`` with weights >= 0.

    Rounds of relaxation from the vertices whose distance just fell; ties keep the lower
    predecessor.
    """
    arcs = materialize(
        edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "arcs"
    )
    best = materialize(
        sources.select("source", F.col("source").alias("v"), F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("pred")), "best"
    )
    front = best
    while True:
        offer = (
            front.join(arcs.withColumnRenamed("a", "v"), "v")
            .groupBy("source", F.col("b").alias("v"))
            .agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("v").alias("p"))).alias("o"))
        )
        merged = materialize(
            best.join(offer, ["source", "v"], "full").select(
                "source", "v",
                F.when(F.col("o").isNull() | (F.col("dist") <= F.col("o.d")), F.col("dist")).otherwise(F.col("o.d")).alias("dist"),
                F.when(F.col("o").isNull() | (F.col("dist") <= F.col("o.d")), F.col("pred")).otherwise(F.col("o.p")).alias("pred"),
                F.when(F.col("o").isNull(), False).otherwise(F.col("dist").isNull() | (F.col("o.d") < F.col("dist"))).alias("fell"),
            ),
            "best",
        )
        best = merged.drop("fell")
        front = merged.filter("fell").drop("fell")
        if front.isEmpty():
            return best
