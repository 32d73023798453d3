"""Spatial graphs and fields derived from the given tables.

The tables hold no graphs, so the sales hierarchy is read as one: a graph per nation and a
time step per order year. Its root is the nation, a customer with orders in that year is a
base node, an order a branching node (a tip when it has no items), an item a tip. The
objects tracked over time are the customers. Coordinates come from balances, prices and
quantities, so every row of customer, orders and lineitem shapes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril import vocab
from tendril.session import size_joins

FIRST_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    size_joins(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cust = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_acctbal")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice", (F.year("o_orderdate") - FIRST_YEAR).alias("t"), F.dayofyear("o_orderdate").alias("day"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
    )
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax")
    )
    per_order = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    base = orders.groupBy("n_name", "n_regionkey", "c_custkey", "c_acctbal", "t").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top")
    )
    common = [F.col("n_name").alias("graph_id")]
    gc = (F.col("n_regionkey") + 1).cast("int").alias("gc")
    obj = (F.col("c_custkey") + vocab.FIRST_OBJECT_ID).cast("int").alias("object_id")
    bx, by = F.col("c_custkey") * 1.0, F.col("c_acctbal") / 100
    ox = bx + 1 + F.col("o_totalprice") / 100000
    oy = by + F.col("day") / 100

    def row(v, x, y, z, kind, object_id, match_id, bulbous):
        return [
            *common, v.cast("bigint").alias("v"), x.cast("double").alias("x"), y.cast("double").alias("y"),
            z.cast("double").alias("z"), F.col("t").cast("int").alias("t"), gc, kind.alias("node_type"),
            object_id, match_id.cast("int").alias("match_id"), bulbous.alias("bulbous"),
        ]

    none, free = F.lit("NONBULBOUS"), F.lit(vocab.UNASSIGNED_ID)
    roots = base.select("n_name", "n_regionkey", "t").distinct().select(
        *row(F.col("t") * 4, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(vocab.ROOT), F.lit(vocab.UNASSIGNED_ID).alias("object_id"), free, none)
    )
    match = F.when(F.col("c_custkey") % 5 == 0, F.floor(F.col("c_custkey") / 10) + vocab.FIRST_OBJECT_ID).otherwise(vocab.UNASSIGNED_ID)
    bases = base.select(
        *row((F.col("c_custkey") * 128 + F.col("t")) * 4 + 1, bx + F.col("n_orders") * 0.25, by, F.col("n_orders") * 0.1,
             F.lit(vocab.BASE), obj, match, F.when(F.col("top") > 400000, "BULBOUS").otherwise("NONBULBOUS"))
    )
    branch = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        *row(F.col("o_orderkey") * 4 + 2, ox, oy, F.lit(1.0), F.when(F.col("n_items") > 0, vocab.BRANCH).otherwise(vocab.TIP), obj, free, none)
    )
    tips = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        *row((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + 3, ox + F.col("qty") / 50, oy + F.col("disc") * 10,
             1 + F.col("tax") * 100, F.lit(vocab.TIP), obj, free, none)
    )
    return roots.unionByName(bases).unionByName(branch).unionByName(tips)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree edges, numbered like the vertex they lead to."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", (F.year("o_orderdate") - FIRST_YEAR).alias("t"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
    )
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()

    base_v = (F.col("c_custkey") * 128 + F.col("t")) * 4 + 1
    order_v = F.col("o_orderkey") * 4 + 2
    item_v = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + 3

    def line(src, dst):
        return [
            F.col("n_name").alias("graph_id"), dst.cast("bigint").alias("e"), src.cast("bigint").alias("src"),
            dst.cast("bigint").alias("dst"), F.col("t").cast("int").alias("t"),
            (F.col("c_custkey") + vocab.FIRST_OBJECT_ID).cast("int").alias("object_id"),
        ]

    down = orders.select("n_name", "c_custkey", "t").distinct().select(*line(F.col("t") * 4, base_v))
    mid = orders.select(*line(base_v, order_v))
    out = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(*line(order_v, item_v))
    return down.unionByName(mid).unionByName(out)


def points(verts: DataFrame, lines: DataFrame) -> DataFrame:
    """Three points per edge: both ends and a middle lifted by 0.5 in y."""
    v = verts.select("graph_id", "v", F.struct("x", "y", "z").alias("p"))
    joined = (
        lines.select("graph_id", "e", "src", "dst")
        .join(v.select("graph_id", F.col("v").alias("src"), F.col("p").alias("a")), ["graph_id", "src"])
        .join(v.select("graph_id", F.col("v").alias("dst"), F.col("p").alias("b")), ["graph_id", "dst"])
    )
    mid = F.struct(
        ((F.col("a.x") + F.col("b.x")) / 2).alias("x"),
        ((F.col("a.y") + F.col("b.y")) / 2 + 0.5).alias("y"),
        ((F.col("a.z") + F.col("b.z")) / 2).alias("z"),
    )
    return joined.select("graph_id", "e", F.posexplode(F.array("a", mid, "b")).alias("ord", "p")).select(
        "graph_id", "e", "ord", "p.x", "p.y", "p.z"
    )


# The same derivation as common table expressions, for the SQL counterparts.
SQL = f"""
sc_orders AS MATERIALIZED (
  SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) - {FIRST_YEAR} AS INT) AS t, dayofyear(o_orderdate) AS d,
         c_custkey, c_acctbal, n_name, n_regionkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sc_items AS MATERIALIZED (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty, max(l_discount) AS disc, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
sc_base AS MATERIALIZED (
  SELECT n_name, n_regionkey, c_custkey, c_acctbal, t, count(*) AS n_orders, max(o_totalprice) AS top
  FROM sc_orders GROUP BY ALL),
vertices AS MATERIALIZED (
  SELECT DISTINCT n_name AS graph_id, CAST(t * 4 AS BIGINT) AS v, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, t,
         CAST(n_regionkey + 1 AS INT) AS gc, 'ROOT_NODE' AS node_type, 1 AS object_id, 1 AS match_id, 'NONBULBOUS' AS bulbous
  FROM sc_base
  UNION ALL
  SELECT n_name, CAST((c_custkey * 128 + t) * 4 + 1 AS BIGINT), c_custkey * 1.0::DOUBLE + n_orders * 0.25::DOUBLE, c_acctbal / 100,
         n_orders * 0.1::DOUBLE, t, CAST(n_regionkey + 1 AS INT), 'BASE_NODE', CAST(c_custkey + 4 AS INT),
         CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey // 10 + 4 ELSE 1 END AS INT),
         CASE WHEN top > 400000 THEN 'BULBOUS' ELSE 'NONBULBOUS' END
  FROM sc_base
  UNION ALL
  SELECT n_name, CAST(o_orderkey * 4 + 2 AS BIGINT), c_custkey * 1.0::DOUBLE + 1 + o_totalprice / 100000, c_acctbal / 100 + d / 100.0::DOUBLE,
         1.0::DOUBLE, t, CAST(n_regionkey + 1 AS INT),
         CASE WHEN o_orderkey IN (SELECT l_orderkey FROM sc_items) THEN 'BRANCHING_NODE' ELSE 'TIP_NODE' END,
         CAST(c_custkey + 4 AS INT), 1, 'NONBULBOUS'
  FROM sc_orders
  UNION ALL
  SELECT n_name, CAST((o_orderkey * 8 + l_linenumber) * 4 + 3 AS BIGINT), c_custkey * 1.0::DOUBLE + 1 + o_totalprice / 100000 + qty / 50,
         c_acctbal / 100 + d / 100.0::DOUBLE + disc * 10, 1 + tax * 100, t, CAST(n_regionkey + 1 AS INT), 'TIP_NODE',
         CAST(c_custkey + 4 AS INT), 1, 'NONBULBOUS'
  FROM sc_items JOIN sc_orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (
  SELECT n_name AS graph_id, CAST((c_custkey * 128 + t) * 4 + 1 AS BIGINT) AS e, CAST(t * 4 AS BIGINT) AS src,
         CAST((c_custkey * 128 + t) * 4 + 1 AS BIGINT) AS dst, t, CAST(c_custkey + 4 AS INT) AS object_id FROM sc_base
  UNION ALL
  SELECT n_name, CAST(o_orderkey * 4 + 2 AS BIGINT), CAST((c_custkey * 128 + t) * 4 + 1 AS BIGINT),
         CAST(o_orderkey * 4 + 2 AS BIGINT), t, CAST(c_custkey + 4 AS INT) FROM sc_orders
  UNION ALL
  SELECT n_name, CAST((o_orderkey * 8 + l_linenumber) * 4 + 3 AS BIGINT), CAST(o_orderkey * 4 + 2 AS BIGINT),
         CAST((o_orderkey * 8 + l_linenumber) * 4 + 3 AS BIGINT), t, CAST(c_custkey + 4 AS INT)
  FROM sc_items JOIN sc_orders ON l_orderkey = o_orderkey),
points AS MATERIALIZED (
  SELECT e.graph_id, e.e, 0 AS ord, a.x, a.y, a.z FROM edges e JOIN vertices a ON a.graph_id = e.graph_id AND a.v = e.src
  UNION ALL
  SELECT e.graph_id, e.e, 1, (a.x + b.x) / 2, (a.y + b.y) / 2 + 0.5::DOUBLE, (a.z + b.z) / 2
  FROM edges e JOIN vertices a ON a.graph_id = e.graph_id AND a.v = e.src JOIN vertices b ON b.graph_id = e.graph_id AND b.v = e.dst
  UNION ALL
  SELECT e.graph_id, e.e, 2, b.x, b.y, b.z FROM edges e JOIN vertices b ON b.graph_id = e.graph_id AND b.v = e.dst)
"""

# Orientation of the same trees: parents and base counts by recursion from the roots.
ORIENTED_SQL = SQL + """,
oriented AS (
  SELECT graph_id, v, CAST(NULL AS BIGINT) AS parent, 0 AS depth, 0 AS base_count, CAST(NULL AS BIGINT) AS base_v
  FROM vertices WHERE node_type = 'ROOT_NODE'
  UNION ALL
  SELECT k.graph_id, k.v, o.v, o.depth + 1, o.base_count + CASE WHEN k.node_type = 'BASE_NODE' THEN 1 ELSE 0 END,
         CASE WHEN k.node_type = 'BASE_NODE' THEN k.v ELSE o.base_v END
  FROM oriented o JOIN edges e ON e.graph_id = o.graph_id AND e.src = o.v JOIN vertices k ON k.graph_id = e.graph_id AND k.v = e.dst)
"""
