"""Contour trees of the sales field: step = order year, x = nation, y = quarter, value = sales in cents.

Neighbours are those of the simplicial split of the lattice: on a mesh with holes the two trees need not have one merge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.operators import contour as C
from tendril.plans.registry import query
from tendril.plans.scene import FIRST_YEAR, table
from tendril.session import materialize

SALES = f"""
sold AS (
  SELECT CAST(year(o_orderdate) - {FIRST_YEAR} AS INT) AS t, c_nationkey AS x, CAST(quarter(o_orderdate) - 1 AS INT) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
sales AS MATERIALIZED (
  SELECT t, x, y, coalesce(value, 0) AS value FROM (SELECT DISTINCT t FROM sold) CROSS JOIN (SELECT CAST(unnest(range((SELECT max(x) + 1 FROM sold))) AS INT) AS x) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS y)
  LEFT JOIN sold USING (t, x, y)),
node AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY value, y, x) AS INT) AS i FROM sales),
size AS MATERIALIZED (SELECT t, CAST(count(*) AS INT) AS n FROM node GROUP BY 1),
near AS MATERIALIZED (SELECT a.t, a.i, list(b.i) AS js FROM node a JOIN node b ON b.t = a.t AND (abs(a.x - b.x) + abs(a.y - b.y) = 1 OR (a.x - b.x = a.y - b.y AND abs(a.x - b.x) = 1)) GROUP BY 1, 2)
"""

# The sequential merge, a node for each step: lists hold the piece (named by its last node) and the pointer of every node.
TREE = """
sweep_down AS (
  SELECT t, n AS k, list_transform(range(n), lambda x: 0) AS piece, list_transform(range(n), lambda x: 0) AS ptr FROM size
  UNION ALL
  SELECT t, k - 1, list_transform(piece, lambda x, j: CASE WHEN j = k OR list_contains(c, x) THEN k ELSE x END), list_transform(ptr, lambda x, j: CASE WHEN list_contains(c, j) THEN k ELSE x END)
  FROM (SELECT s.t, s.k, s.piece, s.ptr, coalesce(list_distinct(list_transform(list_filter(js, lambda j: j > s.k), lambda j: s.piece[j])), []) AS c
    FROM sweep_down s LEFT JOIN near USING (t) WHERE near.i = s.k AND s.k > 0)),
sweep_up AS (
  SELECT t, 1 AS k, list_transform(range(n), lambda x: 0) AS piece, list_transform(range(n), lambda x: 0) AS ptr FROM size
  UNION ALL
  SELECT t, k + 1, list_transform(piece, lambda x, j: CASE WHEN j = k OR list_contains(c, x) THEN k ELSE x END), list_transform(ptr, lambda x, j: CASE WHEN list_contains(c, j) THEN k ELSE x END)
  FROM (SELECT s.t, s.k, s.piece, s.ptr, coalesce(list_distinct(list_transform(list_filter(js, lambda j: j < s.k), lambda j: s.piece[j])), []) AS c
    FROM sweep_up s LEFT JOIN near USING (t) WHERE near.i = s.k)),
peel AS (
  SELECT d.t, d.ptr AS down, u.ptr AS up, 0 AS lo, 0 AS hi FROM sweep_down d JOIN size USING (t) JOIN sweep_up u ON u.t = d.t AND u.k = n + 1 WHERE d.k = 0
  UNION ALL
  SELECT t, list_transform(down, lambda x, j: CASE WHEN j = v THEN -1 WHEN x = v THEN down[v] ELSE x END), list_transform(up, lambda x, j: CASE WHEN j = v THEN -1 WHEN x = v THEN up[v] ELSE x END),
    CASE WHEN list_contains(down, v) THEN v ELSE down[v] END, CASE WHEN list_contains(down, v) THEN up[v] ELSE v END
  FROM (SELECT *, list_filter(range(1, len(down) + 1), lambda i: down[i] >= 0 AND len(list_filter(down, lambda x: x = i)) + len(list_filter(up, lambda x: x = i)) = 1)[1] AS v FROM peel) WHERE v IS NOT NULL),
arcs AS MATERIALIZED (SELECT t, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM peel WHERE hi > 0)
"""

DEGREES = """,
deg AS MATERIALIZED (SELECT t, i, (SELECT count(*) FROM arcs a WHERE a.t = node.t AND a.lo = i) AS n_up, (SELECT count(*) FROM arcs a WHERE a.t = node.t AND a.hi = i) AS n_down FROM node)
"""


def sales(spark, d):
    """The lattice without gaps: no sales are 0."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sold = orders.groupBy((F.year("o_orderdate") - FIRST_YEAR).alias("t"), F.col("c_nationkey").alias("x"), (F.quarter("o_orderdate") - 1).alias("y"))
    sold = materialize(sold.agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("value")), "sold")
    last = sold.agg(F.max("x")).scalar()
    cells = sold.select("t").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), last))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return cells.join(sold, ["t", "x", "y"], "left").select(F.lit("sales").alias("field_id"), "t", "x", "y", F.lit(0).alias("z"), F.coalesce("value", F.lit(0)).alias("value"))


def tree(spark, d):
    nodes, edges = C.numbered(*C.lattice_mesh(sales(spark, d), 14))
    return nodes, C.contour_arcs(nodes, edges)


def at(nodes, name, prefix=""):
    return nodes.select("t", F.col("node").alias(name), F.col("idx.x").alias(f"{prefix}x"), F.col("idx.y").alias(f"{prefix}y"))


@query(
    "contour_tree_arcs",
    "WITH RECURSIVE" + SALES + "," + TREE + """
    SELECT arcs.t, l.x AS lo_x, l.y AS lo_y, h.x AS hi_x, h.y AS hi_y FROM arcs JOIN node l ON l.t = arcs.t AND l.i = lo JOIN node h ON h.t = arcs.t AND h.i = hi
    """,
)
def contour_tree_arcs(spark, d):
    nodes, arcs = tree(spark, d)
    return arcs.join(at(nodes, "lo", "lo_"), ["t", "lo"]).join(at(nodes, "hi", "hi_"), ["t", "hi"]).select("t", "lo_x", "lo_y", "hi_x", "hi_y")


@query(
    "contour_components",
    "WITH RECURSIVE" + SALES + "," + TREE + DEGREES + """,
    kinds AS (SELECT *, CASE WHEN n_up > 1 OR n_down > 1 THEN 'saddle' WHEN n_up = 0 THEN 'maximum' WHEN n_down = 0 THEN 'minimum' ELSE 'regular' END AS kind FROM deg),
    one AS (SELECT a.* FROM arcs a JOIN deg ON deg.t = a.t AND deg.i = a.lo WHERE n_up = 1),
    climb AS (SELECT t, i, i AS here FROM node UNION ALL SELECT c.t, c.i, one.hi FROM climb c JOIN one ON one.t = c.t AND one.lo = c.here),
    summit AS (SELECT t, i, max(here) AS top FROM climb GROUP BY 1, 2),
    last AS (SELECT c.t, c.i, max(here) AS gate FROM climb c JOIN deg g ON g.t = c.t AND g.i = c.here WHERE n_up = 1 OR c.i = c.here GROUP BY 1, 2),
    below AS (SELECT t, i, i AS foot FROM node UNION SELECT b.t, a.hi, b.foot FROM below b JOIN arcs a ON a.t = b.t AND a.lo = b.i),
    least AS (SELECT t, i, min(foot) AS foot FROM below GROUP BY 1, 2)
    SELECT n.t, n.x, n.y, k.kind, k.n_up, k.n_down, CASE WHEN g.n_up = 0 AND l.foot = m.foot THEN p.x END AS top_x, CASE WHEN g.n_up = 0 AND l.foot = m.foot THEN p.y END AS top_y
    FROM node n JOIN kinds k USING (t, i) JOIN summit s USING (t, i) JOIN last e USING (t, i) JOIN least l USING (t, i) JOIN deg g ON g.t = n.t AND g.i = s.top
      JOIN least m ON m.t = n.t AND m.i = e.gate JOIN node p ON p.t = n.t AND p.i = s.top
    """,
)
def contour_components(spark, d):
    nodes, arcs = tree(spark, d)
    kinds = C.critical_tree(nodes, arcs)[0].select("t", "node", "kind", "n_up", "n_down")
    found = C.components(nodes, arcs).join(at(nodes, "node"), ["t", "node"]).join(at(nodes, "component", "top_"), ["t", "component"], "left").join(kinds, ["t", "node"], "left")
    return found.select("t", "x", "y", F.coalesce("kind", F.lit("regular")).alias("kind"), F.coalesce("n_up", F.lit(1)).alias("n_up"), F.coalesce("n_down", F.lit(1)).alias("n_down"), "top_x", "top_y")
