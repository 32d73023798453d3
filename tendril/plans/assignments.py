"""Queries on point-set matching, base placement, file names and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import geometry as G
from tendril.functions import labels as L
from tendril.operators import edits as E
from tendril.operators import graph
from tendril.operators import matching as X
from tendril.operators import placement as PL
from tendril.operators import spatial as P
from tendril.plans import scene
from tendril.plans.matching import EMB, emb
from tendril.plans.registry import query
from tendril.plans.scene import SQL, table
from tendril.session import materialize
from tendril.streaming.steps import append_step

WITH = "WITH " + SQL


def halves(spark, d):
    """Embeddings of each label, split into two point sets by the sign of their fourth value."""
    c = lambda i: F.col("embedding")[i].cast("double")
    e = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("g"), F.col("vec_id").alias("id"), c(0).alias("x"), c(1).alias("y"), c(2).alias("z"), (c(3) > 0).alias("up"))
    e = materialize(e, "sets")
    return e.filter("up").drop("up"), e.filter("not up").drop("up")


@query("greedy_matching")
def greedy_matching(spark, d):
    left, right = halves(spark, d)
    return X.greedy_matching(left, right, 0.1, scale=10.0)[0]


@query("exact_matching")
def exact_matching(spark, d):
    left, right = halves(spark, d)
    return X.exact_matching(left, right, 0.06)


@query("exact_matching_by_score")
def exact_matching_by_score(spark, d):
    left, right = halves(spark, d)
    return X.exact_matching(left, right, 0.06, mode="score", scale=10.0)


@query("iterative_matching")
def iterative_matching(spark, d):
    left, right = halves(spark, d)
    return X.iterative_matching(left, right, 0.1, scale=10.0)[1]


@query(
    "correspondence_edges",
    """
    WITH e AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, embedding[4] > 0 AS up FROM embeddings),
    p AS (SELECT a.g, a.up, a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM e a JOIN e b ON a.g = b.g AND a.up = b.up AND a.id <> b.id)
    SELECT CAST(a.g AS BIGINT) AS g, a.i AS l1, b.i AS r1, a.j AS l2, b.j AS r2 FROM p a JOIN p b ON a.g = b.g AND a.up AND NOT b.up AND a.i < a.j AND a.d < 0.08 AND b.d < 0.08 AND abs(a.d - b.d) < 0.005
    """,
)
def correspondence_edges(spark, d):
    left, right = halves(spark, d)
    return X.correspondence_edges(left, right, 0.08, 0.005)


@query("start_transforms")
def start_transforms(spark, d):
    left, right = halves(spark, d)
    cl = materialize(X.start_cliques(X.correspondence_edges(left, right, 0.1, 0.01)), "cliques")
    fit = X.start_transforms(cl, left, right)
    return fit.select("g.g", "g.l", "g.r", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"), F.round("tz", 6).alias("tz"))


DOT = " + ".join(f"CAST(a.embedding[{i}] AS DOUBLE) * CAST(b.embedding[{i}] AS DOUBLE)" for i in range(1, 65))


@query(
    "angular_gate",
    f"""
    WITH {EMB}, p AS (SELECT a.id AS l_id, b.id AS r_id FROM emb a JOIN emb b ON b.label = a.label AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.1)
    SELECT l_id, r_id, round(degrees(acos(greatest(-1, least(1, {DOT})))), 4) AS angle FROM p JOIN embeddings a ON a.vec_id = l_id JOIN embeddings b ON b.vec_id = r_id
    WHERE degrees(acos(greatest(-1, least(1, {DOT})))) > 60
    """,
)
def angular_gate(spark, d):
    """Pairs in reach whose whole (unit) vectors are more than 60 degrees apart."""
    e = materialize(emb(spark, d), "emb").select(F.col("label").alias("g"), "id", "x", "y", "z")
    pairs = P.near_pairs(e, e, 0.1).filter("l_id <> r_id")
    full = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    j = pairs.join(full.select(F.col("vec_id").alias("l_id"), F.col("vec").alias("lv")), "l_id").join(full.select(F.col("vec_id").alias("r_id"), F.col("vec").alias("rv")), "r_id")
    dims = range(64)
    out = X.angular_gate(j, [F.col("lv")[i] for i in dims], [F.col("rv")[i] for i in dims], 0.1, 60.0)
    return out.select("l_id", "r_id", F.round("angle", 4).alias("angle"))


@query(
    "plane_distances",
    f"WITH {EMB} SELECT id, round(sqrt(greatest(0, x * x + y * y + z * z - pow((x + y) / sqrt(2), 2))), 8) AS across FROM emb",
)
def plane_distances(spark, d):
    """Length of each point vector across the direction (1, 1, 0)."""
    n = [F.lit(1 / 2**0.5), F.lit(1 / 2**0.5), F.lit(0.0)]
    return emb(spark, d).select("id", F.round(X.plane_distance([F.col(c) for c in "xyz"], n), 8).alias("across"))


@query(
    "outermost_candidates",
    WITH + """
    SELECT v.graph_id, v.v FROM vertices v WHERE v.y > 50 AND v.node_type <> 'ROOT_NODE' AND NOT EXISTS (
      SELECT 1 FROM edges e JOIN vertices p ON p.graph_id = e.graph_id AND p.v = e.src WHERE e.graph_id = v.graph_id AND e.dst = v.v AND p.y > 50 AND p.node_type <> 'ROOT_NODE')
    AND NOT EXISTS (
      SELECT 1 FROM edges e JOIN edges f ON f.graph_id = e.graph_id AND f.dst = e.src JOIN vertices p ON p.graph_id = f.graph_id AND p.v = f.src
      WHERE e.graph_id = v.graph_id AND e.dst = v.v AND p.y > 50 AND p.node_type <> 'ROOT_NODE')
    """,
)
def outermost_candidates(spark, d):
    """Candidate nodes (y above 50) with no candidate nearer the root."""
    v, e = materialize(scene.vertices(spark, d), "vertices"), materialize(scene.edges(spark, d), "edges")
    cand = v.filter((F.col("y") > 50) & (F.col("node_type") != vocab.ROOT)).select("graph_id", "v")
    return PL.outermost(cand, graph.orient(v, e), e)


@query(
    "initial_segment_candidate",
    "SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN max(l_linenumber) ELSE min(l_linenumber) END AS ord FROM lineitem GROUP BY 1",
)
def initial_segment_candidate(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_linestatus") == "O").alias("reversed"))
    return PL.candidate_on_segment(li, ["l_orderkey"], "reversed")


@query(
    "page_names",
    r"""
    SELECT page_id, split_part(url, '/', -1) AS base_name, 'out/' || regexp_replace(split_part(url, '/', -1), '\.(tif|hoc|am)', '', 'g') || '.am' AS output_name FROM pages
    """,
)
def page_names(spark, d):
    return table(spark, d, "pages").select("page_id", L.base_name("url").alias("base_name"), L.output_name("url", F.lit("out")).alias("output_name"))


@query(
    "file_metadata",
    """
    WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN printf('p/s_gc%03d_t%03d.am', page_id % 1000, length(url)) WHEN 1 THEN printf('p/GrowthCone%d_%02d.tif', page_id % 10, length(url))
      WHEN 2 THEN printf('p/a_%02d_GrowthCone%d.am', length(url), page_id % 10) ELSE printf('p/b_gc%03d.am', page_id % 1000) END AS path FROM pages)
    SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN page_id % 1000 WHEN 1 THEN page_id % 10 WHEN 2 THEN page_id % 10 ELSE page_id % 1000 END AS INT) AS obj,
      CAST(CASE WHEN page_id % 4 = 3 THEN NULL ELSE regexp_extract(path, CASE page_id % 4 WHEN 0 THEN '_t([0-9]{1,3})' WHEN 1 THEN 'GrowthCone[0-9]_([0-9]{1,2})' ELSE '_([0-9]{1,2})_Gr' END, 1) END AS INT) AS t FROM f
    """,
)
def file_metadata(spark, d):
    """Object and step read back from file names of all four patterns, made from the pages."""
    p = table(spark, d, "pages").select("page_id", F.length("url").alias("n"))
    i = F.col("page_id")
    m = lambda k: (i % k).cast("int")
    path = (
        F.when(i % 4 == 0, F.format_string("p/s_gc%03d_t%03d.am", m(1000), F.col("n"))).when(i % 4 == 1, F.format_string("p/GrowthCone%d_%02d.tif", m(10), F.col("n")))
        .when(i % 4 == 2, F.format_string("p/a_%02d_GrowthCone%d.am", F.col("n"), m(10))).otherwise(F.format_string("p/b_gc%03d.am", m(1000)))
    )
    return p.select("page_id", L.object_and_time(path).alias("m")).select("page_id", "m.obj", "m.t")


@query(
    "time_labels",
    """
    SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t, printf('T_%03d', date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS name,
      CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS parsed, round(1 - date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 29.0::DOUBLE, 6) AS green FROM events
    """,
)
def time_labels(spark, d):
    t = table(spark, d, "events").select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t")).distinct()
    name = L.time_label("t")
    return t.select("t", name.alias("name"), L.parse_time_label(name).alias("parsed"), F.round(G.time_colour("t", F.lit(0), F.lit(29))[1], 6).alias("green"))


@query("appended_step", "SELECT c_custkey AS id, c_acctbal AS x, 0 AS t FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier")
def appended_step(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0).alias("t"))
    return append_step(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")))


@query(
    "sample_grid",
    """
    SELECT page_id, CAST(i AS INT) AS i, round(CASE WHEN i = 0 THEN 0 ELSE length(url) * 0.01 * ((i - 1) % 12 + 1) * cos(floor((i - 1) / 12) * 2 * pi() / 20) END, 6) AS u,
      round(CASE WHEN i = 0 THEN 0 ELSE length(url) * 0.01 * ((i - 1) % 12 + 1) * sin(floor((i - 1) / 12) * 2 * pi() / 20) END, 6) AS v FROM pages CROSS JOIN range(241) r(i)
    """,
)
def sample_grid(spark, d):
    """The radial sample grid, scaled per page."""
    g = table(spark, d, "pages").select("page_id", F.length("url").alias("n"), F.posexplode(G.radial_samples(20, 12, 0.01)).alias("i", "s"))
    return g.select("page_id", "i", F.round(F.col("n") * F.col("s.u"), 6).alias("u"), F.round(F.col("n") * F.col("s.v"), 6).alias("v"))


# ---- edits ------------------------------------------------------------------------------


def version(spark, d):
    v = materialize(scene.vertices(spark, d), "vertices")
    e = materialize(scene.edges(spark, d), "edges")
    return E.Graph(v, e, materialize(scene.points(v, e), "points"))


def mid_cuts(g):
    """Every base-to-order edge split at its middle point."""
    base = g.vertices.filter(F.col("node_type") == vocab.BASE).select("graph_id", F.col("v").alias("src"))
    return g.edges.join(base, ["graph_id", "src"]).select(
        "graph_id", "e", F.lit(1).alias("ord"), (-F.col("e")).alias("v"), (-4 * F.col("e")).alias("e1"), (-4 * F.col("e") - 1).alias("e2"), F.lit(vocab.BRANCH).alias("node_type")
    )


@query(
    "edit_split_edges",
    WITH + """
    SELECT graph_id, count(*) AS n_vertices, (SELECT count(*) FROM edges e WHERE e.graph_id = v.graph_id) + (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = v.graph_id) AS n_edges
    FROM (SELECT graph_id FROM vertices UNION ALL SELECT n_name FROM sc_orders) v GROUP BY 1
    """,
)
def edit_split_edges(spark, d):
    g = version(spark, d)
    out = E.apply(g, E.split_edges(g, mid_cuts(g), 0))
    return out.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_vertices")).join(out.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id")


@query("edit_undo", WITH + " SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM points) AS n_points")
def edit_undo(spark, d):
    """Split, then undo: element counts are those of the start."""
    g = version(spark, d)
    return E.apply(g, E.split_edges(g, mid_cuts(g), 5).until(4)).counts()


@query(
    "edit_delete_and_contract",
    WITH + """,
    kids AS (SELECT e.graph_id, e.src AS v, count(*) AS n, count(CASE WHEN k.x - floor(k.x) < 0.5 THEN 1 END) AS dead FROM edges e JOIN vertices k ON k.graph_id = e.graph_id AND k.v = e.dst WHERE k.node_type = 'TIP_NODE' AND e.dst % 4 = 3 GROUP BY 1, 2)
    SELECT graph_id, (SELECT count(*) FROM vertices v WHERE v.graph_id = k.graph_id) - CAST(sum(dead) AS BIGINT) - count(CASE WHEN dead > 0 AND n - dead = 1 THEN 1 END) AS n_vertices,
      (SELECT count(*) FROM edges v WHERE v.graph_id = k.graph_id) - CAST(sum(dead) AS BIGINT) - count(CASE WHEN dead > 0 AND n - dead = 1 THEN 1 END) AS n_edges
    FROM kids k GROUP BY 1
    """,
)
def edit_delete_and_contract(spark, d):
    """Item tips whose x lies in the lower half of its unit are deleted; orders left with one
    item turn into points of the edge from customer to item."""
    g = version(spark, d)
    order = g.vertices.filter(F.col("node_type") == vocab.BRANCH).select("graph_id", F.col("v").alias("src"))
    items = g.edges.join(order, ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("v"))
    gone = g.vertices.join(items, ["graph_id", "v"], "left_semi").filter(F.col("x") - F.floor("x") < 0.5).select("graph_id", "v")
    out = E.apply(g, E.delete(g, gone, None, 0))
    return out.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_vertices")).join(out.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id")


@query("edit_assign_label", WITH + " SELECT graph_id, CASE WHEN bulbous = 'BULBOUS' THEN 2 ELSE match_id END AS match_id, count(*) AS n FROM vertices GROUP BY 1, 2")
def edit_assign_label(spark, d):
    """Bulbous bases get the match label IGNORED."""
    g = version(spark, d)
    out = E.apply(g, E.assign_label(g, g.vertices.filter("bulbous = 'BULBOUS'"), "match_id", F.lit(vocab.IGNORED_ID), 0))
    return out.vertices.groupBy("graph_id", "match_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "edit_move_vertices",
    WITH + """,
    m AS (SELECT p.graph_id, p.e, p.ord, p.x, p.y, p.z + CASE WHEN p.ord = 2 AND k.node_type = 'TIP_NODE' THEN 1 ELSE 0 END AS z FROM points p JOIN edges e ON e.graph_id = p.graph_id AND e.e = p.e JOIN vertices k ON k.graph_id = e.graph_id AND k.v = e.dst)
    SELECT a.graph_id, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 3) AS length
    FROM m a JOIN m b ON a.graph_id = b.graph_id AND a.e = b.e AND b.ord = a.ord + 1 GROUP BY 1
    """,
)
def edit_move_vertices(spark, d):
    """All tips moved up by one in z; edge ends follow."""
    g = version(spark, d)
    to = g.vertices.filter(F.col("node_type") == vocab.TIP).select("graph_id", "v", "x", "y", (F.col("z") + 1).alias("z"))
    out = E.apply(g, E.move_vertices(g, to, 0))
    return graph.edge_lengths(out.points).groupBy("graph_id").agg(F.round(F.sum("length"), 3).alias("length"))


CHAINS = """WITH o AS (SELECT o_custkey AS c, o_orderkey % 7 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    ways AS (SELECT c, r, y, coalesce(lag(y) OVER (PARTITION BY c ORDER BY r), 0) AS before FROM o)
    SELECT c AS graph_id, 1::BIGINT AS e, (2 * r - k)::INTEGER AS ord, r - k / 2.0::DOUBLE AS x, CASE k WHEN 0 THEN y WHEN 1 THEN (y + before) / 2.0::DOUBLE ELSE before END::DOUBLE AS y
    FROM ways, (VALUES (0), (1), (2)) t(k) WHERE k < 2 OR r = 1
    """


@query("edit_contract_chains", CHAINS)
def edit_contract_chains(spark, d):
    """The orders of a customer as a chain of branching nodes, each with a side tip: without the tips
    the chain is one edge with the points of all."""
    each = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("graph_id"), F.row_number().over(each).cast("bigint").alias("r"), (F.col("o_orderkey") % 7).cast("double").alias("y"),
        F.coalesce(F.lag(F.col("o_orderkey") % 7).over(each), F.lit(0)).cast("double").alias("before"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"),
    )
    o = materialize(o, "chains")
    side = F.lit(1 << 40)
    node = lambda v, x, y, kind: o.select("graph_id", v.alias("v"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"), kind.alias("node_type"))
    r, zero = F.col("r"), F.lit(0).cast("bigint")
    verts = node(r, r, F.col("y"), F.when(r == F.col("n"), vocab.TIP).otherwise(vocab.BRANCH)).unionAll(node(r + side, r, F.col("y") + 1, F.lit(vocab.TIP))).unionAll(node(zero, zero, zero, F.lit(vocab.ROOT)).distinct())
    edges = o.select("graph_id", r.alias("e"), (r - 1).alias("src"), r.alias("dst")).unionAll(o.select("graph_id", (r + side).alias("e"), r.alias("src"), (r + side).alias("dst")))
    line = o.select("graph_id", "r", F.col("y"), F.col("before"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    points = line.select("graph_id", r.alias("e"), "ord", (r - 1 + F.col("ord") / 2).cast("double").alias("x"), (F.col("before") + (F.col("y") - F.col("before")) * F.col("ord") / 2).alias("y"), F.lit(0.0).alias("z"))
    points = points.unionAll(line.filter("ord < 2").select("graph_id", (r + side).alias("e"), "ord", r.cast("double"), F.col("y") + F.col("ord"), F.lit(0.0)))
    g = E.Graph(*(materialize(x, "chains") for x in (verts, edges, points)))
    out = E.apply(g, E.delete(g, g.vertices.filter(F.col("v") > side).select("graph_id", "v"), None, 0))
    return out.points.select("graph_id", "e", "ord", "x", "y")
