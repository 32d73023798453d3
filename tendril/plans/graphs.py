"""Queries on the derived sales graphs: selection, orientation, statistics, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import labels as L
from tendril.operators import consistency as C
from tendril.operators import dictionary as D
from tendril.operators import graph as G
from tendril.operators import selection as sel
from tendril.operators import statistics as S
from tendril.plans import scene
from tendril.plans.registry import query
from tendril.plans.scene import ORIENTED_SQL, SQL, table
from tendril.session import materialize

WITH = "WITH " + SQL
REC = "WITH RECURSIVE " + ORIENTED_SQL


def graph_of(spark, d):
    """Vertices and edges, stored once because several steps of a query read them."""
    return materialize(scene.vertices(spark, d), "vertices"), materialize(scene.edges(spark, d), "edges")


# ---- selections -------------------------------------------------------------------------


@query("nodes_of_step", WITH + " SELECT graph_id, v, node_type FROM vertices WHERE t = 2")
def nodes_of_step(spark, d):
    return sel.of_step(scene.vertices(spark, d), 2).select("graph_id", "v", "node_type")


@query("nodes_of_type", WITH + " SELECT graph_id, v, t FROM vertices WHERE node_type = 'BRANCHING_NODE'")
def nodes_of_type(spark, d):
    return sel.of_type(scene.vertices(spark, d), vocab.BRANCH).select("graph_id", "v", "t")


@query("root_of_step", WITH + " SELECT graph_id, t, CAST(CASE WHEN count(*) = 1 THEN min(v) ELSE -1 END AS BIGINT) AS root FROM vertices WHERE node_type = 'ROOT_NODE' GROUP BY 1, 2")
def root_of_step(spark, d):
    return S.root_of_step(scene.vertices(spark, d))


@query(
    "object_selection",
    WITH + " SELECT graph_id, object_id, t, count(*) AS n_nodes, count(CASE WHEN node_type = 'BASE_NODE' THEN 1 END) AS n_bases FROM vertices WHERE object_id > 3 GROUP BY 1, 2, 3",
)
def object_selection(spark, d):
    v = scene.vertices(spark, d).filter(L.is_real_object("object_id"))
    return v.groupBy("graph_id", "object_id", "t").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("node_type") == vocab.BASE).alias("n_bases"))


@query("visible_window", WITH + " SELECT graph_id, t, node_type, count(*) AS n FROM vertices WHERE t BETWEEN 2 AND 5 GROUP BY 1, 2, 3")
def visible_window(spark, d):
    v = scene.vertices(spark, d).withColumn("location", F.lit(None).cast("string"))
    return sel.visible(v, 3, 1, 2).groupBy("graph_id", "t", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("several_steps", WITH + " SELECT graph_id, object_id, count(DISTINCT t) > 1 AS several_steps FROM vertices GROUP BY 1, 2")
def several_steps(spark, d):
    return scene.vertices(spark, d).groupBy("graph_id", "object_id").agg((F.count_distinct("t") > 1).alias("several_steps"))


@query(
    "selection_algebra",
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
    e AS (SELECT c_custkey AS k FROM customer)
    SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
    UNION ALL SELECT 'intersection', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
    UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'complement', k FROM (SELECT k FROM e EXCEPT SELECT k FROM a)
    """,
)
def selection_algebra(spark, d):
    o = table(spark, d, "orders")
    a = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k")).distinct()
    b = o.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k")).distinct()
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"union": sel.union(a, b), "intersection": sel.intersection(a, b), "difference": sel.difference(a, b), "complement": sel.complement(a, e)}
    out = None
    for op, df in parts.items():
        row = df.select(F.lit(op).alias("op"), "k")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "selection_equality",
    """
    SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) = 0
       AND (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) = 0 AS equal
    """,
)
def selection_equality(spark, d):
    o = table(spark, d, "orders")
    return sel.equal(o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query(
    "subgraph_extraction",
    WITH + """
    SELECT e.graph_id, e.e, e.src, e.dst FROM edges e JOIN vertices a ON a.graph_id = e.graph_id AND a.v = e.src
    JOIN vertices b ON b.graph_id = e.graph_id AND b.v = e.dst WHERE a.node_type <> 'TIP_NODE' AND b.node_type <> 'TIP_NODE'
    """,
)
def subgraph_extraction(spark, d):
    v, e = graph_of(spark, d)
    _, lines = sel.subgraph(v, e, v.filter(F.col("node_type") != vocab.TIP))
    return lines.select("graph_id", "e", "src", "dst")


@query(
    "merge_steps",
    """
    SELECT c_custkey * 1000 + 0 AS v, c_acctbal AS x, 0 AS t FROM customer UNION ALL SELECT s_suppkey * 1000 + 1, s_acctbal, 1 FROM supplier
    """,
)
def merge_steps(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_acctbal").alias("x"))
    return sel.merge_graphs([c, s], [0, 1], "v")


# ---- orientation ------------------------------------------------------------------------


@query("node_degrees", WITH + " SELECT v.graph_id, v.v, count(k) AS degree FROM vertices v LEFT JOIN (SELECT graph_id, src AS k FROM edges UNION ALL SELECT graph_id, dst FROM edges) i ON i.graph_id = v.graph_id AND i.k = v.v GROUP BY 1, 2")
def node_degrees(spark, d):
    return G.degrees(*graph_of(spark, d))


@query(
    "types_by_degree",
    WITH + """
    SELECT v.graph_id, v.v, count(k) AS degree, CASE WHEN any_value(node_type) = 'ROOT_NODE' THEN 'ROOT_NODE' WHEN count(k) = 1 THEN 'TIP_NODE' WHEN count(k) = 2 THEN 'BASE_NODE' ELSE 'BRANCHING_NODE' END AS node_type
    FROM vertices v LEFT JOIN (SELECT graph_id, src AS k FROM edges UNION ALL SELECT graph_id, dst FROM edges) i ON i.graph_id = v.graph_id AND i.k = v.v GROUP BY 1, 2
    """,
)
def types_by_degree(spark, d):
    v, e = graph_of(spark, d)
    return G.types_by_degree(v, e, v.filter(F.col("node_type") == vocab.ROOT))


@query("rooted_labels", REC + " SELECT graph_id, v, parent, depth, base_count, base_v FROM oriented")
def rooted_labels(spark, d):
    return G.orient(*graph_of(spark, d)).drop("parent_edge")


@query(
    "node_locations",
    REC + """
    SELECT o.graph_id, o.v, CASE WHEN base_count = 0 THEN 'GROWTHCONE' WHEN base_count = 1 THEN 'FILOPODIUM' END AS location FROM oriented o
    """,
)
def node_locations(spark, d):
    v, e = graph_of(spark, d)
    return G.location_labels(G.orient(v, e), v, e)[0].select("graph_id", "v", "location")


@query(
    "edge_locations",
    REC + """
    SELECT e.graph_id, e.e, CASE WHEN p.base_count = 0 THEN 'GROWTHCONE' WHEN p.base_count = 1 THEN 'FILOPODIUM' END AS location
    FROM edges e JOIN vertices s ON s.graph_id = e.graph_id AND s.v = e.src
    JOIN oriented p ON p.graph_id = e.graph_id AND p.v = CASE WHEN s.node_type = 'BASE_NODE' THEN e.dst ELSE e.src END
    """,
)
def edge_locations(spark, d):
    v, e = graph_of(spark, d)
    return G.location_labels(G.orient(v, e), v, e)[1].select("graph_id", "e", "location")


@query(
    "edge_membership",
    REC + """
    SELECT e.graph_id, e.e, CASE WHEN least(a.base_count, b.base_count) = 0 THEN 'GROWTHCONE' WHEN a.base_count = 1 AND b.base_count = 1 THEN 'FILOPODIUM' END AS location
    FROM edges e JOIN oriented a ON a.graph_id = e.graph_id AND a.v = e.src JOIN oriented b ON b.graph_id = e.graph_id AND b.v = e.dst
    """,
)
def edge_membership(spark, d):
    v, e = graph_of(spark, d)
    return G.core_membership(G.orient(v, e), e)


PATHS = REC + """,
walk AS (
  SELECT graph_id, v AS target, 0 AS hop, v, parent FROM oriented WHERE (graph_id, v) IN (SELECT graph_id, v FROM vertices WHERE node_type = 'TIP_NODE')
  UNION ALL SELECT w.graph_id, w.target, w.hop + 1, o.v, o.parent FROM walk w JOIN oriented o ON o.graph_id = w.graph_id AND o.v = w.parent)
"""


@query("root_paths", PATHS + " SELECT graph_id, target, hop, v, CASE WHEN parent IS NOT NULL THEN v END AS e, CASE WHEN parent IS NOT NULL THEN false END AS reversed FROM walk")
def root_paths(spark, d):
    v, e = graph_of(spark, d)
    return G.root_paths(G.orient(v, e), e, v.filter(F.col("node_type") == vocab.TIP))


@query(
    "until_branching",
    PATHS + """
    SELECT w.graph_id, w.target, w.v FROM walk w WHERE NOT EXISTS (
      SELECT 1 FROM walk u JOIN vertices k ON k.graph_id = u.graph_id AND k.v = u.v
      WHERE u.graph_id = w.graph_id AND u.target = w.target AND u.hop > 0 AND u.hop < w.hop AND k.node_type IN ('BRANCHING_NODE', 'ROOT_NODE'))
    """,
)
def until_branching(spark, d):
    v, e = graph_of(spark, d)
    return G.until_branching(G.orient(v, e), v, v.filter(F.col("node_type") == vocab.TIP))


@query("filament_components", REC + " SELECT graph_id, v, min(v) OVER (PARTITION BY graph_id, base_v) AS component FROM oriented WHERE base_count = 1")
def filament_components(spark, d):
    """Pieces of the filament part, found without using the orientation's base column."""
    v, e = graph_of(spark, d)
    nodes, lines = G.location_labels(G.orient(v, e), v, e)
    return G.filament_components(
        nodes.select("graph_id", "v", "location"), e.select("graph_id", "e", "src", "dst").join(lines.select("graph_id", "e", "location"), ["graph_id", "e"])
    )


@query("same_filament", REC + " SELECT v.graph_id, v.object_id, v.t, count(*) AS n_nodes FROM oriented o JOIN vertices v ON v.graph_id = o.graph_id AND v.v = o.v WHERE base_count = 1 AND object_id > 3 GROUP BY 1, 2, 3")
def same_filament(spark, d):
    v, e = graph_of(spark, d)
    o = G.orient(v, e).filter("base_count = 1").select("graph_id", "v")
    return v.filter(L.is_real_object("object_id")).join(o, ["graph_id", "v"]).groupBy("graph_id", "object_id", "t").agg(F.count(F.lit(1)).alias("n_nodes"))


# ---- statistics -------------------------------------------------------------------------

LENGTHS = """
seg AS (
  SELECT a.graph_id, a.e, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS s
  FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.e = b.e AND b.ord = a.ord + 1),
edge_len AS (SELECT graph_id, e, sum(s) AS length FROM seg GROUP BY 1, 2)
"""
FILAMENT = REC + "," + LENGTHS + """,
eloc AS (
  SELECT e.graph_id, e.e, p.base_v, p.base_count FROM edges e JOIN vertices s ON s.graph_id = e.graph_id AND s.v = e.src
  JOIN oriented p ON p.graph_id = e.graph_id AND p.v = CASE WHEN s.node_type = 'BASE_NODE' THEN e.dst ELSE e.src END),
flen AS (SELECT graph_id, base_v, sum(length) AS total FROM eloc JOIN edge_len USING (graph_id, e) WHERE base_count = 1 GROUP BY 1, 2),
kinds AS (
  SELECT o.graph_id, o.base_v, count(CASE WHEN node_type = 'BRANCHING_NODE' THEN 1 END) AS nb, count(CASE WHEN node_type = 'TIP_NODE' THEN 1 END) AS nt
  FROM oriented o JOIN vertices k ON k.graph_id = o.graph_id AND k.v = o.v WHERE base_count = 1 GROUP BY 1, 2),
fil AS (
  SELECT b.graph_id, row_number() OVER (PARTITION BY b.graph_id ORDER BY b.v) - 1 AS filament_id, b.t, b.object_id,
    printf('F_%04d', b.object_id - 3) AS object_name, coalesce(total, 0) AS total_length,
    CASE WHEN r.x - b.x > 0 THEN 360 - degrees(acos((r.y - b.y) / sqrt(pow(r.x - b.x, 2) + pow(r.y - b.y, 2))))
         ELSE degrees(acos((r.y - b.y) / nullif(sqrt(pow(r.x - b.x, 2) + pow(r.y - b.y, 2)), 0))) END AS angle,
    CASE WHEN b.bulbous = 'BULBOUS' THEN 1 ELSE 0 END AS bulbous, b.v AS base_v, b.x, b.y, b.z, coalesce(nb, 0) AS n_branch, coalesce(nt, 0) AS n_tips
  FROM vertices b JOIN vertices r ON r.graph_id = b.graph_id AND r.t = b.t AND r.node_type = 'ROOT_NODE'
  LEFT JOIN flen f ON f.graph_id = b.graph_id AND f.base_v = b.v LEFT JOIN kinds k ON k.graph_id = b.graph_id AND k.base_v = b.v
  WHERE b.node_type = 'BASE_NODE'),
life AS (
  SELECT graph_id, object_id, min(t) AS first_t, max(t) AS last_t, max(t) - min(t) + 1 AS life
  FROM (SELECT graph_id, object_id, t FROM vertices UNION ALL SELECT graph_id, object_id, t FROM edges) WHERE object_id > 3 GROUP BY 1, 2)
"""


def parts(spark, d):
    v, e = graph_of(spark, d)
    p = scene.points(v, e)
    return v, e, p


@query("edge_lengths", WITH + "," + LENGTHS + " SELECT graph_id, e, round(length, 5) AS length FROM edge_len")
def edge_lengths(spark, d):
    _, _, p = parts(spark, d)
    return G.edge_lengths(p).withColumn("length", F.round("length", 5))


@query("filament_table", FILAMENT + " SELECT graph_id, filament_id, t, object_id, object_name, round(total_length, 4) AS total_length, round(angle, 5) AS angle, bulbous, base_v, x, y, z, n_branch, n_tips FROM fil")
def filament_table(spark, d):
    out = S.filament_table(*parts(spark, d))
    return out.withColumn("total_length", F.round("total_length", 4)).withColumn("angle", F.round("angle", 5))


@query(
    "filament_tips",
    REC + """
    SELECT o.graph_id, o.base_v, row_number() OVER (PARTITION BY o.graph_id, o.base_v ORDER BY o.v) AS tip_no, o.v, k.x, k.y, k.z
    FROM oriented o JOIN vertices k ON k.graph_id = o.graph_id AND k.v = o.v WHERE base_count = 1 AND node_type = 'TIP_NODE'
    """,
)
def filament_tips(spark, d):
    v, e = graph_of(spark, d)
    return S.filament_tips(v, G.orient(v, e))


@query("life_time", WITH + " SELECT graph_id, object_id, min(t) AS first_t, max(t) AS last_t, max(t) - min(t) + 1 AS life FROM (SELECT graph_id, object_id, t FROM vertices UNION ALL SELECT graph_id, object_id, t FROM edges) GROUP BY 1, 2")
def life_time(spark, d):
    return S.life_time(*graph_of(spark, d))


@query("match_life_time", WITH + " SELECT graph_id, match_id, min(t) AS first_t, max(t) AS last_t FROM vertices GROUP BY 1, 2")
def match_life_time(spark, d):
    return S.match_life_time(scene.vertices(spark, d))


STEPS = list(range(7))


@query(
    "length_table",
    FILAMENT + """
    SELECT f.graph_id, f.object_id, any_value(object_name) AS object_name, any_value(first_t) AS first_t, any_value(last_t) AS last_t, any_value(life) AS life,
      round(arg_min(angle, f.t), 5) AS angle, string_agg(CAST(filament_id AS VARCHAR), ', ' ORDER BY filament_id) AS filaments,
      """ + ", ".join(f"round(max(CASE WHEN t = {s} THEN total_length END), 4) AS length_t{s:02d}" for s in STEPS) + """
    FROM fil f JOIN life l ON l.graph_id = f.graph_id AND l.object_id = f.object_id GROUP BY 1, 2
    """,
)
def length_table(spark, d):
    v, e, p = parts(spark, d)
    out = S.length_table(materialize(S.filament_table(v, e, p), "filaments"), S.life_time(v, e), STEPS)
    return out.withColumn("angle", F.round("angle", 5)).select(*[F.round(c, 4).alias(c) if c.startswith("length_t") else F.col(c) for c in out.columns])


@query(
    "object_table",
    FILAMENT + """,
    pad AS (
      SELECT graph_id, object_id, t, total_length AS len FROM fil
      UNION ALL SELECT graph_id, object_id, first_t - 1, 0 FROM life WHERE first_t <> 0
      UNION ALL SELECT graph_id, object_id, last_t + 1, 0 FROM life WHERE last_t < (SELECT max(t) FROM vertices)),
    sp AS (SELECT graph_id, object_id, lag(len) OVER (PARTITION BY graph_id, object_id ORDER BY t) - len AS v FROM pad),
    ev AS (
      SELECT graph_id, object_id, count(v) AS n_events, avg(abs(v)) AS speed_mean, stddev_pop(abs(v)) AS speed_std, count(CASE WHEN abs(v) > 0.1 THEN 1 END) AS n_filtered,
        count(CASE WHEN v < -0.1 THEN 1 END) AS n_extensions, count(CASE WHEN v > 0.1 THEN 1 END) AS n_retractions,
        avg(CASE WHEN v < -0.1 THEN -v END) AS extension_mean, avg(CASE WHEN v > 0.1 THEN v END) AS retraction_mean, count(CASE WHEN abs(v) <= 0.1 THEN 1 END) AS n_static
      FROM sp WHERE v IS NOT NULL GROUP BY 1, 2)
    SELECT f.graph_id, f.object_id, any_value(object_name) AS object_name, any_value(first_t) AS first_t, any_value(last_t) AS last_t, any_value(life) AS life,
      CAST(sum(bulbous) AS BIGINT) AS n_bulbous, round(sum(bulbous) / any_value(life), 6) AS bulbous_share, round(avg(total_length), 4) AS length_mean,
      round(stddev_pop(total_length), 4) AS length_std, round(arg_max(total_length, f.t), 4) AS final_length, any_value(n_events) AS n_events,
      round(any_value(speed_mean), 4) AS speed_mean, round(any_value(speed_std), 4) AS speed_std, any_value(n_filtered) AS n_filtered,
      any_value(n_extensions) AS n_extensions, round(any_value(extension_mean), 4) AS extension_mean, any_value(n_retractions) AS n_retractions,
      round(any_value(retraction_mean), 4) AS retraction_mean, any_value(n_static) AS n_static
    FROM fil f JOIN life USING (graph_id, object_id) LEFT JOIN ev USING (graph_id, object_id) GROUP BY 1, 2
    """,
)
def object_table(spark, d):
    v, e, p = parts(spark, d)
    fil = materialize(S.filament_table(v, e, p), "filaments")
    out = S.object_table(fil, S.life_time(v, e), v.agg(F.max("t")))
    r4 = ("length_mean", "length_std", "final_length", "speed_mean", "speed_std", "extension_mean", "retraction_mean")
    return out.select(
        "graph_id", "object_id", "object_name", "first_t", "last_t", "life", "n_bulbous", F.round("bulbous_share", 6).alias("bulbous_share"),
        *[F.round(c, 4).alias(c) for c in r4], "n_events", "n_filtered", "n_extensions", "n_retractions", "n_static",
    )


@query(
    "retrace_differences",
    WITH + "," + LENGTHS + """,
    chord AS (
      SELECT a.graph_id, a.e, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS c
      FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.e = b.e AND a.ord = 0 AND b.ord = 2)
    SELECT graph_id, count(*) AS n_edges, round(sum(length), 3) AS total_before, round(sum(c), 3) AS total_after, round(avg(abs(c - length)), 6) AS mean_abs,
      round(avg(c - length), 6) AS mean_signed, round(avg(abs(c - length) / length), 6) AS mean_relative, round(avg((c - length) / length), 6) AS mean_signed_relative
    FROM edge_len JOIN chord USING (graph_id, e) GROUP BY graph_id
    """,
)
def retrace_differences(spark, d):
    """Every edge against its straight retrace (the chord between its ends)."""
    _, _, p = parts(spark, d)
    p = materialize(p, "points")
    out = S.retrace_differences(G.edge_lengths(p), G.edge_lengths(p.filter("ord <> 1").withColumn("ord", F.floor(F.col("ord") / 2).cast("int"))))
    return out.select("graph_id", "n_edges", F.round("total_before", 3).alias("total_before"), F.round("total_after", 3).alias("total_after"),
                      *[F.round(c, 6).alias(c) for c in ("mean_abs", "mean_signed", "mean_relative", "mean_signed_relative")])


# ---- consistency ------------------------------------------------------------------------

R_TIPS = """
SELECT v.graph_id, 'tip' AS component, CAST(v.v AS VARCHAR) AS id, v.t, CASE WHEN coalesce(base_count, 0) = 0 THEN 'no base' ELSE 'more than one base' END AS problem,
  CASE WHEN coalesce(base_count, 0) = 0 THEN 'add base' ELSE 'remove base' END AS solution
FROM vertices v LEFT JOIN oriented o ON o.graph_id = v.graph_id AND o.v = v.v WHERE node_type = 'TIP_NODE' AND coalesce(base_count, 0) <> 1
"""
R_DEGREE = """
SELECT graph_id, CASE node_type WHEN 'TIP_NODE' THEN 'tip' WHEN 'BASE_NODE' THEN 'base' ELSE 'branch' END AS component, CAST(v AS VARCHAR) AS id, t,
  CASE WHEN node_type = 'TIP_NODE' AND n >= 2 THEN 'more than one incident edge' WHEN node_type = 'TIP_NODE' THEN 'no incident edge'
       WHEN node_type = 'BASE_NODE' THEN 'not two incident edges' ELSE 'too few incident edges' END AS problem,
  CASE WHEN node_type = 'TIP_NODE' AND n = 0 THEN 'remove tip' WHEN node_type = 'BRANCHING_NODE' THEN 'convert node to point' ELSE 'check problem' END AS solution
FROM (SELECT v.graph_id, v.v, any_value(v.t) AS t, any_value(node_type) AS node_type, count(k) AS n FROM vertices v
      LEFT JOIN (SELECT graph_id, src AS k FROM edges UNION ALL SELECT graph_id, dst FROM edges) i ON i.graph_id = v.graph_id AND i.k = v.v GROUP BY 1, 2)
WHERE (node_type = 'TIP_NODE' AND n <> 1) OR (node_type = 'BASE_NODE' AND n <> 2) OR (node_type = 'BRANCHING_NODE' AND n < 3)
"""
R_MATCH = """
SELECT graph_id, 'filopodia' AS component, '?' AS id, t, 'multiple filopodia with same match ID' AS problem, 'isolate filopodia' AS solution
FROM (SELECT graph_id, t, row_number() OVER (PARTITION BY graph_id, t, match_id ORDER BY v) AS k FROM vertices WHERE node_type = 'BASE_NODE' AND match_id <> 1) WHERE k > 1
"""
NAME = "printf('F_%04d', object_id - 3)"
R_GAPS = f"""
SELECT graph_id, 'filopodium' AS component, {NAME} AS id, -1 AS t, 'has a gap' AS problem, 'fill gap or isolate' AS solution
FROM (SELECT graph_id, object_id, max(t) - min(t) + 1 AS life, count(CASE WHEN node_type = 'BASE_NODE' THEN 1 END) AS n FROM vertices WHERE object_id > 3 GROUP BY 1, 2) WHERE life <> n
UNION ALL
SELECT graph_id, 'filopodia', {NAME}, -1, 'contains multiple match IDs', 'isolate'
FROM (SELECT graph_id, object_id FROM vertices WHERE object_id > 3 AND node_type = 'BASE_NODE' AND match_id <> 1 GROUP BY 1, 2 HAVING count(DISTINCT match_id) > 1)
"""
R_BULB = f"""
SELECT graph_id, 'filopodia' AS component, {NAME} AS id, -1 AS t, 'incomplete bulbous label' AS problem, 'extend bulbous label' AS solution
FROM (SELECT graph_id, object_id, max(t) - min(t) + 1 AS span, count(*) AS n FROM vertices WHERE node_type = 'BASE_NODE' AND bulbous = 'BULBOUS' GROUP BY 1, 2) WHERE span <> n
"""
R_TIME = """
SELECT graph_id, 'edge' AS component, CAST(e AS VARCHAR) AS id, -1 AS t, 'connects two timesteps' AS problem, 'delete' AS solution
FROM shifted s WHERE (SELECT t FROM stamped a WHERE a.v = s.src AND a.graph_id = s.graph_id) IS DISTINCT FROM (SELECT t FROM stamped a WHERE a.v = s.dst AND a.graph_id = s.graph_id)
UNION ALL SELECT graph_id, 'node', CAST(v AS VARCHAR), -1, 'no time label', 'delete' FROM stamped WHERE t IS NULL
"""


# A copy with violations: bulbous bases turned into branching nodes, every fifth order into a base.
PLANTED = REC.replace("""oriented AS (""", """planted AS (SELECT * REPLACE (CASE WHEN node_type = 'BASE_NODE' AND bulbous = 'BULBOUS' THEN 'BRANCHING_NODE' WHEN node_type = 'BRANCHING_NODE' AND (v // 4) % 5 = 0 THEN 'BASE_NODE' ELSE node_type END AS node_type) FROM vertices),
oriented AS (""")
PLANTED = PLANTED[: PLANTED.index("oriented AS (")] + PLANTED[PLANTED.index("oriented AS (") :].replace("vertices", "planted")


def planted(spark, d):
    v, e = graph_of(spark, d)
    kind = F.col("node_type")
    lost = (kind == vocab.BASE) & (F.col("bulbous") == "BULBOUS")
    second = (kind == vocab.BRANCH) & (F.floor(F.col("v") / 4) % 5 == 0)
    return materialize(v.withColumn("node_type", F.when(lost, vocab.BRANCH).when(second, vocab.BASE).otherwise(kind)), "planted"), e


@query("rule_tip_bases", PLANTED + R_TIPS.replace("vertices", "planted"))
def rule_tip_bases(spark, d):
    """The rule on a copy with tips that have no base or two."""
    v, e = planted(spark, d)
    return C.tips_without_single_base(v, G.orient(v, e))


@query("rule_incident_edges", WITH + R_DEGREE)
def rule_incident_edges(spark, d):
    return C.incident_edges(*graph_of(spark, d))


@query(
    "rule_filament_size",
    PLANTED + f"""
    SELECT b.graph_id, 'filopodium' AS component, {NAME} AS id, b.t, 'too few elements' AS problem, 'check if tip, base and one edge exist' AS solution
    FROM planted b LEFT JOIN (SELECT graph_id, base_v, count(*) AS n FROM oriented WHERE base_count = 1 GROUP BY 1, 2) k ON k.graph_id = b.graph_id AND k.base_v = b.v
    WHERE node_type = 'BASE_NODE' AND coalesce(n, 0) < 2
    UNION ALL SELECT v.graph_id, 'tip', CAST(v.v AS VARCHAR), v.t, 'more or less than one base', 'add or remove base'
    FROM planted v LEFT JOIN oriented o ON o.graph_id = v.graph_id AND o.v = v.v WHERE node_type = 'TIP_NODE' AND coalesce(base_count, 0) <> 1
    """,
)
def rule_filament_size(spark, d):
    """The rule on the copy with violations."""
    v, e = planted(spark, d)
    return C.filament_size(v, e, G.orient(v, e))


@query("rule_match_ids", WITH + R_MATCH)
def rule_match_ids(spark, d):
    return C.repeated_match_ids(scene.vertices(spark, d))


@query("rule_object_gaps", WITH + R_GAPS)
def rule_object_gaps(spark, d):
    return C.object_gaps(*graph_of(spark, d))


@query(
    "rule_time_labels",
    WITH + """,
    stamped AS (SELECT graph_id, v, CASE WHEN bulbous = 'BULBOUS' THEN NULL ELSE t END AS t FROM vertices),
    ends AS (SELECT e.graph_id, e.e, a.t AS ts, b.t AS td FROM edges e JOIN stamped a ON a.graph_id = e.graph_id AND a.v = e.src JOIN stamped b ON b.graph_id = e.graph_id AND b.v = e.dst)
    SELECT graph_id, 'edge' AS component, CAST(e AS VARCHAR) AS id, -1 AS t, 'connects two timesteps' AS problem, 'delete' AS solution FROM ends WHERE ts IS DISTINCT FROM td
    UNION ALL SELECT graph_id, 'node', CAST(v AS VARCHAR), -1, 'no time label', 'delete' FROM stamped WHERE t IS NULL
    """,
)
def rule_time_labels(spark, d):
    """The rule on a copy whose bulbous bases lost their step."""
    v, e = graph_of(spark, d)
    return C.time_labels(v.withColumn("t", F.when(F.col("bulbous") == "BULBOUS", None).otherwise(F.col("t"))), e)


@query("rule_bulbous_gaps", WITH + R_BULB)
def rule_bulbous_gaps(spark, d):
    return C.bulbous_gaps(scene.vertices(spark, d))


R_STEPS = """
SELECT e.graph_id, 'edge' AS component, CAST(e.e AS VARCHAR) AS id, -1 AS t, 'connects two timesteps' AS problem, 'delete' AS solution
FROM edges e JOIN vertices a ON a.graph_id = e.graph_id AND a.v = e.src JOIN vertices b ON b.graph_id = e.graph_id AND b.v = e.dst WHERE a.t IS DISTINCT FROM b.t
UNION ALL SELECT graph_id, 'node', CAST(v AS VARCHAR), -1, 'no time label', 'delete' FROM vertices WHERE t IS NULL
"""
R_SIZE = f"""
SELECT b.graph_id, 'filopodium' AS component, {NAME} AS id, b.t, 'too few elements' AS problem, 'check if tip, base and one edge exist' AS solution
FROM vertices b LEFT JOIN (SELECT graph_id, base_v, count(*) AS n FROM oriented WHERE base_count = 1 GROUP BY 1, 2) k ON k.graph_id = b.graph_id AND k.base_v = b.v WHERE node_type = 'BASE_NODE' AND coalesce(n, 0) < 2
UNION ALL SELECT v.graph_id, 'tip', CAST(v.v AS VARCHAR), v.t, 'more or less than one base', 'add or remove base'
FROM vertices v LEFT JOIN oriented o ON o.graph_id = v.graph_id AND o.v = v.v WHERE node_type = 'TIP_NODE' AND coalesce(base_count, 0) <> 1
"""


@query(
    "violation_summary",
    PLANTED + " SELECT component, problem, solution, count(*) AS n FROM (" + " UNION ALL ".join([R_TIPS, R_DEGREE, R_MATCH, R_GAPS, R_BULB, R_STEPS, R_SIZE]).replace("vertices", "planted") + ") GROUP BY ALL",
)
def violation_summary(spark, d):
    """All rules on the copy with violations."""
    v, e = planted(spark, d)
    return C.violations(v, e).groupBy("component", "problem", "solution").agg(F.count(F.lit(1)).alias("n"))


# ---- dictionaries -----------------------------------------------------------------------


@query(
    "label_names",
    WITH + """ SELECT graph_id, v, CASE object_id WHEN 1 THEN 'UNASSIGNED' WHEN 2 THEN 'IGNORED' WHEN 3 THEN 'AXON' ELSE """ + NAME + """ END AS object_name,
    CASE match_id WHEN 1 THEN 'UNASSIGNED' ELSE printf('M_%04d', match_id - 3) END AS match_name,
    printf('GC_%03d', gc) AS core_name, printf('T_%03d', t) AS step_name FROM vertices""",
)
def label_names(spark, d):
    return scene.vertices(spark, d).select(
        "graph_id", "v", L.object_label("object_id").alias("object_name"), L.match_label("match_id").alias("match_name"), L.core_label("gc").alias("core_name"), L.time_label("t").alias("step_name")
    )


@query("dictionary_join", WITH + """ SELECT graph_id, printf('F_%04d', object_id - 3) AS name, count(*) AS n FROM vertices WHERE object_id > 3 GROUP BY 1, 2""")
def dictionary_join(spark, d):
    """Names from a label dictionary built from the customers, joined to the vertices."""
    v = scene.vertices(spark, d)
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = (F.col("c_custkey") + vocab.FIRST_OBJECT_ID).cast("int")
    labels = c.select(F.col("n_name").alias("graph_id"), F.lit("Filopodia").alias("grp"), i.alias("label_id"), F.lit(0).alias("parent_id"), L.object_label(i).alias("name"))
    return D.names_of(v.filter(L.is_real_object("object_id")), labels, "Filopodia", "object_id", "name").groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("n"))


USED = "used AS (SELECT DISTINCT n_name AS graph_id, c_custkey // 3 + 4 AS id FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def used_ids(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_name").alias("graph_id"), (F.floor(F.col("c_custkey") / 3) + 4).alias("id"))


@query("first_unused_id", f"WITH {USED} SELECT graph_id, min(id) + 1 AS next_id FROM (SELECT graph_id, id FROM used UNION SELECT graph_id, 3 FROM used) u WHERE NOT EXISTS (SELECT 1 FROM used x WHERE x.graph_id = u.graph_id AND x.id = u.id + 1) GROUP BY 1")
def first_unused_id(spark, d):
    return D.first_unused(used_ids(spark, d))


@query(
    "label_compaction",
    f"""
    WITH {USED}, n AS (SELECT graph_id, count(*) + 3 AS top FROM used GROUP BY 1),
    slots AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY id) + 3 AS id FROM used),
    holes AS (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS k FROM (SELECT * FROM slots EXCEPT SELECT * FROM used)),
    high AS (SELECT u.graph_id, id, row_number() OVER (PARTITION BY u.graph_id ORDER BY id DESC) AS k FROM used u JOIN n USING (graph_id) WHERE id > top)
    SELECT h.graph_id, h.id AS old_id, o.id AS new_id FROM high h JOIN holes o USING (graph_id, k)
    """,
)
def label_compaction(spark, d):
    return D.compaction(used_ids(spark, d))


@query(
    "successors",
    WITH + """
    SELECT a.graph_id, a.v, b.v AS successor FROM vertices a JOIN (
      SELECT graph_id, object_id, t, min(v) AS v FROM vertices WHERE node_type = 'BASE_NODE' GROUP BY 1, 2, 3 HAVING count(*) = 1) b
    ON b.graph_id = a.graph_id AND b.object_id = a.object_id AND b.t = a.t + 1 WHERE a.node_type = 'BASE_NODE'
    """,
)
def successors(spark, d):
    from tendril.operators.tracking import successors as succ

    return succ(scene.vertices(spark, d))


@query("unique_centres", WITH + " SELECT graph_id, gc, t, min(v) AS v FROM vertices WHERE node_type = 'ROOT_NODE' GROUP BY 1, 2, 3 HAVING count(*) = 1")
def unique_centres(spark, d):
    from tendril.operators.tracking import unique_centres as uc

    return uc(scene.vertices(spark, d).filter(F.col("node_type") == vocab.ROOT))
