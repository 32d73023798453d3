"""Placing base nodes on paths, and clipping graphs by surfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import geometry as G
from tendril.functions import ordered as O
from tendril.operators import fields, graph

XYZ = ["x", "y", "z"]


def error_profile(path: DataFrame, image: DataFrame, directions: int = 20, radii: int = 12, spacing: float = 0.1) -> DataFrame:
    """``(field_id, t, path_id, ord, error)``: misfit of a Gaussian to the cross-section at each point.

    Cross-sections are radial grids normal to the path, sampled trilinearly. Moments and the
    residual are plain aggregates over samples. ``path(field_id, t, path_id, ord, x, y, z)``.
    """
    key = ["field_id", "t", "path_id"]
    near = O.neighbours(path, key, "ord", XYZ, back="b", ahead="a")
    step = [F.coalesce(F.col(f"a.{c}"), F.col(c)) - F.coalesce(F.col(f"b.{c}"), F.col(c)) for c in XYZ]
    near = near.select(*key, "ord", *XYZ, *[s.alias(f"d{c}") for s, c in zip(step, XYZ)])
    size = F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in XYZ))
    near = near.select(*key, "ord", *XYZ, *[F.try_divide(F.col(f"d{c}"), size).alias(f"n{c}") for c in XYZ]).filter(F.col("nx").isNotNull())
    u, v = G.plane_basis("nx", "ny", "nz")
    near = near.select(*key, "ord", *XYZ, F.array(*u).alias("_u"), F.array(*v).alias("_v")).withColumn("_s", F.explode(G.radial_samples(directions, radii, spacing)))
    at = [F.col(c) + F.col("_s.u") * F.col("_u")[i] + F.col("_s.v") * F.col("_v")[i] for i, c in enumerate(XYZ)]
    ident = F.struct("path_id", "ord", F.col("_s.u").alias("u"), F.col("_s.v").alias("v"))
    samples = fields.sample_trilinear(near.select("field_id", "t", ident.alias("id"), *[a.alias(c) for a, c in zip(at, XYZ)]), image, ["field_id", "t"])
    flat = samples.select("field_id", "t", "id.*", "value")
    here = [*key, "ord"]
    fit = flat.groupBy(*here).agg(
        F.try_divide(F.sum(F.col("value") * F.col("u")), F.sum("value")).alias("mu"),
        F.try_divide(F.sum(F.col("value") * F.col("v")), F.sum("value")).alias("mv"),
        F.try_divide(F.sum(F.col("value") * F.col("u") * F.col("u")), F.sum("value")).alias("uu"),
        F.try_divide(F.sum(F.col("value") * F.col("v") * F.col("v")), F.sum("value")).alias("vv"),
        F.max("value").alias("peak"),
    )
    fit = fit.withColumn("su", F.sqrt(F.greatest(F.col("uu") - F.col("mu") * F.col("mu"), F.lit(1e-12)))).withColumn("sv", F.sqrt(F.greatest(F.col("vv") - F.col("mv") * F.col("mv"), F.lit(1e-12))))
    model = F.coalesce(G.gaussian2d("u", "v", "mu", "mv", "su", "sv", "peak"), F.lit(0.0))
    return flat.join(fit, here).groupBy(*here).agg(F.sqrt(F.sum((model - F.col("value")) * (model - F.col("value")))).alias("error"))


def base_points(profile: DataFrame, keys: list[str], threshold: float = vocab.BASE_SIGNIFICANCE) -> DataFrame:
    """Split position per path; -1 where the profile has no significant turn."""
    return O.best_split(profile, keys, "ord", "error", threshold)


def outermost(candidates: DataFrame, oriented: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates without another candidate between them and the root: one base per subtree.

    ``candidates(graph_id, v)``; ancestors are walked once for all candidates together.
    """
    walk = graph.root_paths(oriented, edges, candidates).filter("hop > 0").select("graph_id", "target", "v")
    covered = walk.join(candidates.select("graph_id", "v").distinct(), ["graph_id", "v"], "left_semi").select("graph_id", F.col("target").alias("v")).distinct()
    return candidates.join(covered, ["graph_id", "v"], "left_anti")


def candidate_on_segment(candidates: DataFrame, keys: list[str], reversed_col: str, pos: str = "ord") -> DataFrame:
    """The candidate nearest the root on an initial segment: the last one when the segment
    runs towards the root, the first one otherwise."""
    pick = F.when(F.bool_or(reversed_col), F.max(pos)).otherwise(F.min(pos))
    return candidates.groupBy(*keys).agg(pick.alias(pos))


def thickness_base(points: DataFrame, keys: list[str], pos: str, thickness: str, limit: float = vocab.THICKNESS_THRESHOLD) -> DataFrame:
    """The first point along each path (numbered from its tip) thicker than the limit."""
    return O.first_where(points, keys, pos, F.col(thickness) > limit, [thickness])


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b)])


def triangle_hit(origin: list[Column], direction: list[Column], tri: str = "") -> Column:
    """Parameter s with origin + s * direction on the triangle (a, b, c columns), else NULL."""
    a = [F.col(f"{tri}a{c}") for c in "xyz"]
    e1 = [F.col(f"{tri}b{c}") - F.col(f"{tri}a{c}") for c in "xyz"]
    e2 = [F.col(f"{tri}c{c}") - F.col(f"{tri}a{c}") for c in "xyz"]
    p = _cross(direction, e2)
    det = _dot(e1, p)
    inv = 1 / F.when(F.abs(det) > 1e-12, det)
    w = [o - q for o, q in zip(origin, a)]
    u = _dot(w, p) * inv
    q = _cross(w, e1)
    v = _dot(direction, q) * inv
    s = _dot(e2, q) * inv
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1), s)


def _cells(df: DataFrame, lows: dict[str, Column], highs: dict[str, Column], cell: float) -> DataFrame:
    for c in lows:
        df = df.withColumn(f"_c{c}", F.explode(F.sequence(F.floor(lows[c] / cell).cast("bigint"), F.floor(highs[c] / cell).cast("bigint"))))
    return df


def _triangle_box(axes: str):
    lows = {c: F.least(F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"c{c}")) for c in axes}
    highs = {c: F.greatest(F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"c{c}")) for c in axes}
    return lows, highs


def surface_crossings(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """``(graph_id, e, ord, s, x, y, z)``: where the segment ending at point ``ord`` pierces the
    surface. Segments and triangles meet by equality on the cells their boxes cover."""
    seg = O.neighbours(points, ["graph_id", "e"], "ord", XYZ, back="p").filter(F.col("p").isNotNull())
    lows = {c: F.least(F.col(c), F.col(f"p.{c}")) for c in XYZ}
    highs = {c: F.greatest(F.col(c), F.col(f"p.{c}")) for c in XYZ}
    a = _cells(seg, lows, highs, cell)
    b = _cells(triangles, *_triangle_box("xyz"), cell)
    cand = a.join(b, ["_cx", "_cy", "_cz"])
    d = [F.col(c) - F.col(f"p.{c}") for c in XYZ]
    s = triangle_hit([F.col(f"p.{c}") for c in XYZ], d)
    hits = cand.withColumn("s", s).filter((F.col("s") >= 0) & (F.col("s") < 1))
    once = hits.groupBy("graph_id", "e", "ord", "tri_id").agg(F.min("s").alias("s"), *[F.first(f"p.{c}").alias(f"_p{c}") for c in XYZ], *[F.first(c).alias(f"_q{c}") for c in XYZ])
    return once.groupBy("graph_id", "e", "ord", F.round("s", 9).alias("s")).agg(
        *[F.min(F.col(f"_p{c}") + F.col("s") * (F.col(f"_q{c}") - F.col(f"_p{c}"))).alias(c) for c in XYZ]
    )


def inside_surface(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """``(id, inside)``: a ray along +x pierces a closed surface an odd number of times."""
    a = points.withColumn("_cy", F.floor(F.col("y") / cell).cast("bigint")).withColumn("_cz", F.floor(F.col("z") / cell).cast("bigint"))
    b = _cells(triangles, *_triangle_box("yz"), cell)
    s = triangle_hit([F.col(c) for c in XYZ], [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    n = a.join(b, ["_cy", "_cz"]).withColumn("s", s).filter("s > 0").groupBy("id").agg(F.count_distinct(F.round("s", 9)).alias("n"))
    return points.select("id").join(n, "id", "left").select("id", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def clip_by_surface(points: DataFrame, triangles: DataFrame, cell: float, keep_inside: bool = True) -> DataFrame:
    """Polylines cut at a closed surface: ``(graph_id, e, part, ord, x, y, z)`` of the kept side.

    Every crossing flips the side; the side of a point is the side of the first point of its
    edge plus the crossings before it, so all cuts are made at once.
    """
    hits = surface_crossings(points, triangles, cell)
    firsts = points.filter("ord = 0").select(F.struct("graph_id", "e").alias("id"), *XYZ)
    side = inside_surface(firsts, triangles, cell).select("id.graph_id", "id.e", "inside")
    own = points.select("graph_id", "e", (F.col("ord") * 1.0).alias("at"), *XYZ, F.lit(0).alias("cut"))
    cut = hits.select("graph_id", "e", (F.col("ord") - 1 + F.col("s")).alias("at"), *XYZ, F.lit(1).alias("cut"))
    from tendril.operators.statistics import dense_ids

    seq = dense_ids(own.unionByName(cut).withColumn("_o", F.struct("at", "cut")), ["graph_id", "e"], "_o", "pos")
    run = O.running_sums(seq, ["graph_id", "e"], "pos", {"_n": F.col("cut")}).join(side, ["graph_id", "e"])
    # A crossing ends the part before it and starts the part after it.
    parts = run.withColumn("part", F.explode(F.when(F.col("cut") == 1, F.array(F.col("_n") - 1, F.col("_n"))).otherwise(F.array("_n"))))
    parts = parts.withColumn("part", F.col("part").cast("int"))
    inside = F.col("inside") == (F.col("part") % 2 == 0)
    return parts.filter(inside if keep_inside else ~inside).select("graph_id", "e", "part", F.col("pos").cast("int").alias("ord"), *XYZ)
