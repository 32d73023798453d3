"""Queries on voxel fields derived from shipments.

One field; step = ship year, x = supplier, y = line number, z = month, value = quantity
shipped. The region of a voxel is its supplier's nation; the label is the region where the
quantity is above 40.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.functions import geometry as G
from tendril.operators import fields as V
from tendril.operators.skew import ranked
from tendril.plans.registry import query
from tendril.plans.scene import table
from tendril.session import materialize

FIELD = """
voxels AS (
  SELECT CAST(year(l_shipdate) - 1995 AS INT) AS t, CAST(l_suppkey AS INT) AS x, CAST(l_linenumber - 1 AS INT) AS y, CAST(month(l_shipdate) - 1 AS INT) AS z,
    sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
regions AS (SELECT v.t, v.x, v.y, v.z, value, s_nationkey + 1 AS label FROM voxels v JOIN supplier ON s_suppkey = v.x),
labels AS (SELECT * FROM regions WHERE value > 40)
"""
WITH = "WITH" + FIELD


def voxels(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.lit("shipments").alias("field_id"), (F.year("l_shipdate") - 1995).alias("t"), F.col("l_suppkey").cast("int").alias("x"),
        (F.col("l_linenumber") - 1).alias("y"), (F.month("l_shipdate") - 1).alias("z"),
    ).agg(F.sum("l_quantity").alias("value"))


def regions(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), (F.col("s_nationkey") + 1).alias("label"))
    return voxels(spark, d).join(s.withColumn("x", F.col("x").cast("int")), "x").select("field_id", "t", "x", "y", "z", "value", "label")


def labels(spark, d):
    return regions(spark, d).filter("value > 40")


@query("label_volumes", WITH + " SELECT t, label, count(*) AS volume FROM labels GROUP BY 1, 2")
def label_volumes(spark, d):
    return V.volumes(labels(spark, d)).drop("field_id")


CONT = """
cont AS (
  SELECT coalesce(a.t, b.t - 1) AS t, coalesce(a.label, 0) AS a, coalesce(b.label, 0) AS b, count(*) AS overlap
  FROM regions a FULL JOIN regions b ON b.t = a.t + 1 AND b.x = a.x AND b.y = a.y AND b.z = a.z GROUP BY 1, 2, 3)
"""


@query("label_contingency", WITH + "," + CONT + " SELECT * FROM cont WHERE t >= (SELECT min(t) FROM regions) AND t < (SELECT max(t) FROM regions)")
def label_contingency(spark, d):
    return V.contingency(materialize(regions(spark, d), "labels")).drop("field_id")


MAPPED = CONT + """,
vol AS (SELECT t, label, count(*) AS volume FROM regions GROUP BY 1, 2),
mapped AS (SELECT c.t, c.a, c.b, c.overlap FROM cont c JOIN vol p ON p.t = c.t AND p.label = c.a JOIN vol q ON q.t = c.t + 1 AND q.label = c.b
  WHERE overlap > 0.5 * p.volume AND overlap > 0.5 * q.volume)
"""


@query("label_overlap_map", WITH + "," + MAPPED + " SELECT * FROM mapped")
def label_overlap_map(spark, d):
    return V.overlap_mapping(materialize(regions(spark, d), "labels"), 0.5).drop("field_id")


CHAIN = WITH.replace("WITH", "WITH RECURSIVE", 1) + "," + MAPPED + """,
chain AS (
  SELECT t, a AS label, t AS ht, a AS hl FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM mapped p WHERE p.t = m.t - 1 AND p.b = m.a)
  UNION ALL SELECT m.t + 1, m.b, c.ht, c.hl FROM chain c JOIN mapped m ON m.t = c.t AND m.a = c.label),
newlab AS (SELECT t, label, CAST(dense_rank() OVER (ORDER BY ht, hl) AS INT) AS new_label FROM chain)
"""


@query("label_tracks", CHAIN + " SELECT t, label, new_label FROM newlab")
def label_tracks(spark, d):
    return V.track_labels(materialize(regions(spark, d), "labels"), 0.5).drop("field_id")


@query("relabelled_volumes", CHAIN + " SELECT t, new_label AS label, count(*) AS volume FROM regions JOIN newlab USING (t, label) GROUP BY 1, 2")
def relabelled_volumes(spark, d):
    lab = materialize(regions(spark, d), "labels")
    return V.volumes(V.relabel(lab, V.track_labels(lab, 0.5))).drop("field_id")


@query(
    "label_centres",
    WITH + """,
    n AS (SELECT DISTINCT l.t, l.label, l.x + o.dx AS x, l.y + o.dy AS y, l.z + o.dz AS z FROM labels l, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx,dy,dz)),
    outside AS (SELECT * FROM n WHERE (t, label, x, y, z) NOT IN (SELECT t, label, x, y, z FROM labels)),
    dist AS (SELECT l.t, l.label, l.x, l.y, l.z, min((l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y) + (l.z - o.z) * (l.z - o.z)) AS d2
             FROM labels l JOIN outside o ON o.t = l.t AND o.label = l.label GROUP BY ALL)
    SELECT t, label, x, y, z, round(sqrt(d2), 6) AS depth FROM dist QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY d2 DESC, z, y, x) = 1
    """,
)
def label_centres(spark, d):
    return V.label_centres(labels(spark, d)).drop("field_id").withColumn("depth", F.round("depth", 6))


@query("region_maxima", WITH + " SELECT t, label, x, y, z, value FROM labels QUALIFY rank() OVER (PARTITION BY t, label ORDER BY value DESC) = 1")
def region_maxima(spark, d):
    return V.region_maxima(labels(spark, d), ["t", "label"]).select("t", "label", "x", "y", "z", "value")


@query("interior_maxima", WITH + " SELECT t, label, x, y, z, value FROM labels WHERE y > 0 AND y < 6 AND z > 0 AND z < 11 QUALIFY rank() OVER (PARTITION BY t, label ORDER BY value DESC) = 1")
def interior_maxima(spark, d):
    inside = (F.col("y") > 0) & (F.col("y") < 6) & (F.col("z") > 0) & (F.col("z") < 11)
    return V.region_maxima(labels(spark, d), ["t", "label"], interior=inside).select("t", "label", "x", "y", "z", "value")


@query("brand_price_maxima", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) = 1")
def brand_price_maxima(spark, d):
    return V.region_maxima(table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", "p_partkey", "p_retailprice")


@query(
    "label_boxes",
    WITH + """ SELECT t, label, greatest(0, min(x) - 2) AS lo_x, greatest(0, min(y) - 2) AS lo_y, greatest(0, min(z) - 2) AS lo_z,
    max(x) + 2 AS hi_x, least(6, max(y) + 2) AS hi_y, least(11, max(z) + 2) AS hi_z FROM labels GROUP BY 1, 2""",
)
def label_boxes(spark, d):
    return V.bounding_box(labels(spark, d), ["t", "label"], {"x": F.lit(2**31 - 1), "y": 7, "z": 12}, 2)


@query(
    "cropped_sums",
    WITH + """, box AS (SELECT t, min(x) AS a, max(x) AS b, min(z) AS c, max(z) AS e FROM labels WHERE label = 1 GROUP BY 1)
    SELECT v.t, count(*) AS n, sum(value) AS total FROM voxels v JOIN box USING (t) WHERE x BETWEEN a AND b AND z BETWEEN c AND e GROUP BY 1""",
)
def cropped_sums(spark, d):
    """The image cropped to the box of the first nation's label in each step."""
    box = V.bounding_box(labels(spark, d).filter("label = 1"), ["t"]).withColumn("lo_y", F.lit(0)).withColumn("hi_y", F.lit(6))
    return V.crop(voxels(spark, d), box, ["t"]).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "root_crop_boxes",
    """SELECT s_suppkey AS k, CAST(greatest(0, s_suppkey - 5) AS INT) AS lo_x, CAST(least(999, s_suppkey + 4) AS INT) AS hi_x, CAST(greatest(0, s_nationkey - 2) AS INT) AS lo_y,
    CAST(least(24, s_nationkey + 2) AS INT) AS hi_y, CAST(0 AS INT) AS lo_z, CAST(least(11, 2) AS INT) AS hi_z FROM supplier""",
)
def root_crop_boxes(spark, d):
    roots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("x"), F.col("s_nationkey").alias("y"), F.lit(1).alias("z"))
    return V.crop_box(roots, (-5, -2, -3), (10, 5, 5), (1000, 25, 12)).drop("x", "y", "z")


@query("split_labels", WITH + " SELECT t, label AS part, count(*) AS n, sum(value) AS total FROM labels GROUP BY 1, 2")
def split_labels(spark, d):
    lab = labels(spark, d).drop("value")
    return V.split_labels(lab, lab, voxels(spark, d)).groupBy("t", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("seed_labels", WITH + " SELECT o.o_orderkey AS seed, l.label FROM orders o JOIN labels l ON l.t = year(o_orderdate) - 1995 AND l.x = o_custkey // 15 AND l.y = 2 AND l.z = month(o_orderdate) - 1")
def seed_labels(spark, d):
    o = table(spark, d, "orders").select(
        F.lit("shipments").alias("field_id"), (F.year("o_orderdate") - 1995).alias("t"), F.col("o_orderkey").alias("seed"), (F.col("o_custkey") / 15).alias("x"), F.lit(2.5).alias("y"), (F.month("o_orderdate") - 0.5).alias("z")
    )
    return V.labels_at(o, labels(spark, d)).select("seed", "label")


@query("channel_sums", WITH + " SELECT CAST((3 - z % 3) % 3 AS INT) AS channel, CAST(z // 3 AS INT) AS z, count(*) AS n, sum(value) AS total FROM voxels GROUP BY 1, 2")
def channel_sums(spark, d):
    return V.split_channels(voxels(spark, d), 3, 12).groupBy("channel", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


PSF = """
{n} AS (
  SELECT c.t, c.x, c.y, c.z, c.label, c.value FROM {p} c LEFT JOIN {p} u ON u.t = c.t AND u.x = c.x AND u.y = c.y AND u.z = c.z - 1
  LEFT JOIN {p} w ON w.t = c.t AND w.x = c.x AND w.y = c.y AND w.z = c.z + 1
  WHERE NOT coalesce((u.value IS NULL AND w.value > c.value) OR (w.value IS NULL AND u.value > c.value), false))
"""


@query("corrected_labels", WITH + "," + PSF.format(n="r1", p="labels") + "," + PSF.format(n="r2", p="r1") + " SELECT t, x, y, z, label FROM r2")
def corrected_labels(spark, d):
    lab = materialize(labels(spark, d), "labels")
    return V.correct_labels(lab.drop("value"), lab, 2).drop("field_id")


@query("rescaled_field", WITH + ", m AS (SELECT min(value) AS lo, max(value) AS hi FROM voxels) SELECT t, x, y, z, round(CASE WHEN lo < 0 OR hi > 255 THEN (value - lo) * (255 / (hi - lo)) ELSE value END, 6) AS value FROM voxels, m")
def rescaled_field(spark, d):
    return V.rescale_to_byte(materialize(voxels(spark, d), "voxels")).drop("field_id").withColumn("value", F.round("value", 6))


@query("rescaled_prices", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_returnflag AS flag, round(sum((l_extendedprice - lo) * (255 / (hi - lo))), 2) AS total FROM lineitem, m GROUP BY 1")
def rescaled_prices(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    return V.rescale_to_byte(li).groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("value"), 2).alias("total"))


@query("value_histogram", WITH + ", m AS (SELECT min(value) AS lo, max(value) AS hi FROM voxels) SELECT t, CAST(least(15, floor((value - lo) / ((hi - lo) / 16))) AS INT) AS bin, count(*) AS n FROM voxels, m GROUP BY 1, 2")
def value_histogram(spark, d):
    return V.histogram(materialize(voxels(spark, d), "voxels"), ["t"], 16)


@query("data_window", WITH + " SELECT t, min(value) AS lo, max(value) AS hi FROM voxels GROUP BY 1 HAVING min(value) < max(value)")
def data_window(spark, d):
    """Display window per step; a window needs lo < hi."""
    return voxels(spark, d).groupBy("t").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi")


@query(
    "majority_labels",
    WITH + """, v AS (SELECT a.t, a.x, a.y, a.z, b.label, count(*) AS n FROM voxels a JOIN labels b ON b.t = a.t AND abs(b.x - a.x) + abs(b.y - a.y) + abs(b.z - a.z) = 1
      AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)
    SELECT t, x, y, z, label, n FROM v QUALIFY row_number() OVER (PARTITION BY t, x, y, z ORDER BY n DESC, label) = 1""",
)
def majority_labels(spark, d):
    """The label most common among the six neighbours of every voxel."""
    lab = labels(spark, d)
    votes = V.neighbours_of(lab, 6, ["field_id", "t", "label"]).select("field_id", "t", "label", *[F.col(f"n_{c}").alias(c) for c in "xyz"])
    here = voxels(spark, d).select("field_id", "t", "x", "y", "z")
    return V.majority_label(votes.join(here, ["field_id", "t", "x", "y", "z"], "left_semi"), ["t", "x", "y", "z"])


for _kind, _name in ((6, "face"), (14, "simplicial"), (26, "full")):
    _offs = ", ".join(str(o) for o in V.OFFSETS[_kind])

    @query(
        f"{_name}_neighbourhood",
        WITH + f""" SELECT v.t, v.x, v.y, v.z, count(*) AS n FROM voxels v, (VALUES {_offs}) o(dx, dy, dz)
        WHERE v.x + dx BETWEEN 0 AND (SELECT max(x) FROM voxels) AND v.y + dy BETWEEN 0 AND 6 AND v.z + dz BETWEEN 0 AND 11 GROUP BY ALL""",
    )
    def _neighbourhood(spark, d, kind=_kind):
        v = materialize(voxels(spark, d), "voxels")
        dims = v.groupBy("field_id").agg((F.max("x") + 1).alias("nx"), F.lit(7).alias("ny"), F.lit(12).alias("nz"))
        return V.neighbours_of(v, kind, ["field_id", "t", "x", "y", "z"], dims=dims).groupBy("t", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


@query("voxel_order", WITH + " SELECT t, x, y, z, row_number() OVER (ORDER BY value, t, z, y, x) - 1 AS rank FROM voxels")
def voxel_order(spark, d):
    """Position of every voxel in the total order by value, then storage index."""
    return ranked(voxels(spark, d).select("t", "x", "y", "z", "value"), [F.col(c) for c in ("value", "t", "z", "y", "x")]).drop("value")


NCC = WITH + """,
pair AS (
  SELECT a.t, a.x, b.z - a.z AS s_z, b.y - a.y AS s_y, a.value AS tv, b.value AS iv, a.y AS ay, a.z AS az FROM voxels a JOIN voxels b ON b.t = a.t + 1 AND b.x = a.x
  WHERE a.z BETWEEN 4 AND 8 AND abs(b.z - a.z) <= 2 AND abs(b.y - a.y) <= 1),
ncc AS (
  SELECT t, x, s_y, s_z, count(*) AS n, max(CASE WHEN ay = 3 AND az = 6 THEN iv END) AS grey,
    CASE WHEN count(*) > 1 AND sum(tv * tv) - sum(tv) * sum(tv) / count(*) > 1e-9 AND sum(iv * iv) - sum(iv) * sum(iv) / count(*) > 1e-9 THEN corr(tv, iv) END AS c
  FROM pair GROUP BY ALL)
"""


def ncc_inputs(spark, d):
    v = materialize(voxels(spark, d), "voxels")
    rel = lambda df: df.select("t", F.col("x").alias("k"), F.lit(0).alias("x"), (F.col("y") - 3).alias("y"), (F.col("z") - 6).alias("z"), "value")
    return rel(v.filter("z BETWEEN 4 AND 8")), rel(v.withColumn("t", F.col("t") - 1))


@query("template_correlation", NCC + " SELECT t, x, CAST(s_y AS INT) AS s_y, CAST(s_z AS INT) AS s_z, n, round(c, 6) AS corr FROM ncc")
def template_correlation(spark, d):
    """Each supplier's mid-year pattern searched in the next year, shifted in line and month."""
    tmpl, img = ncc_inputs(spark, d)
    return V.correlate(tmpl, img, ["t", "k"], (0, 1, 2)).select("t", F.col("k").alias("x"), "s_y", "s_z", "n", F.round("corr", 6).alias("corr"))


@query(
    "best_template_shift",
    NCC + """, ref AS (SELECT t, x, value AS grey0 FROM voxels WHERE y = 3 AND z = 6),
    ok AS (SELECT ncc.*, row_number() OVER (PARTITION BY t, x ORDER BY round(c, 12) DESC, s_y * s_y + s_z * s_z DESC, s_z, s_y) AS place FROM ncc JOIN ref USING (t, x) WHERE grey > 0.75 * grey0 AND grey < 1.25 * grey0 AND c > 0)
    SELECT t, x AS k, 0 AS s_x, CAST(s_y AS INT) AS s_y, CAST(s_z AS INT) AS s_z, round(c, 6) AS corr FROM ok WHERE place = 1""",
)
def best_template_shift(spark, d):
    tmpl, img = ncc_inputs(spark, d)
    ref = tmpl.filter("y = 0 AND z = 0").select("t", "k", F.col("value").alias("grey0"))
    scores = V.correlate(tmpl, img, ["t", "k"], (0, 1, 2)).withColumn("corr", F.round("corr", 12))  # equal but for rounding is equal
    return V.best_shift(scores, ref, ["t", "k"], 0.0).withColumn("corr", F.round("corr", 6))


@query(
    "deconvolved_field",
    WITH + """,
    raw AS (SELECT CAST(r_regionkey - 2 AS INT) AS dz, exp(-0.5 * (r_regionkey - 2) * (r_regionkey - 2)) AS w FROM region),
    k AS (SELECT dz, w / (SELECT sum(w) FROM raw) AS w FROM raw),
    f0 AS MATERIALIZED (SELECT t, x, y, z, CAST(value AS DOUBLE) AS g, CAST(value AS DOUBLE) AS f FROM voxels),
    f1 AS MATERIALIZED (
      SELECT a.t, a.x, a.y, a.z, g, greatest(0, f + coalesce(b, 0)) AS f FROM f0 a LEFT JOIN (
        SELECT r.t, r.x, r.y, r.z - k.dz AS z, sum(r.r * k.w) AS b FROM (
          SELECT c.t, c.x, c.y, c.z, g - coalesce(b, 0) AS r FROM f0 c LEFT JOIN (
            SELECT m.t, m.x, m.y, m.z + k.dz AS z, sum(m.f * k.w) AS b FROM f0 m CROSS JOIN k GROUP BY ALL) USING (t, x, y, z)) r CROSS JOIN k GROUP BY ALL) USING (t, x, y, z)),
    f2 AS MATERIALIZED (
      SELECT a.t, a.x, a.y, a.z, g, greatest(0, f + coalesce(b, 0)) AS f FROM f1 a LEFT JOIN (
        SELECT r.t, r.x, r.y, r.z - k.dz AS z, sum(r.r * k.w) AS b FROM (
          SELECT c.t, c.x, c.y, c.z, g - coalesce(b, 0) AS r FROM f1 c LEFT JOIN (
            SELECT m.t, m.x, m.y, m.z + k.dz AS z, sum(m.f * k.w) AS b FROM f1 m CROSS JOIN k GROUP BY ALL) USING (t, x, y, z)) r CROSS JOIN k GROUP BY ALL) USING (t, x, y, z)),
    f3 AS MATERIALIZED (
      SELECT a.t, a.x, a.y, a.z, g, greatest(0, f + coalesce(b, 0)) AS f FROM f2 a LEFT JOIN (
        SELECT r.t, r.x, r.y, r.z - k.dz AS z, sum(r.r * k.w) AS b FROM (
          SELECT c.t, c.x, c.y, c.z, g - coalesce(b, 0) AS r FROM f2 c LEFT JOIN (
            SELECT m.t, m.x, m.y, m.z + k.dz AS z, sum(m.f * k.w) AS b FROM f2 m CROSS JOIN k GROUP BY ALL) USING (t, x, y, z)) r CROSS JOIN k GROUP BY ALL) USING (t, x, y, z))
    SELECT t, x, y, z, round(f, 6) AS value FROM f3""",
)
def deconvolved_field(spark, d):
    k = table(spark, d, "region").select(
        F.lit(0).alias("dx"), F.lit(0).alias("dy"), (F.col("r_regionkey") - 2).cast("int").alias("dz"), F.exp(-0.5 * (F.col("r_regionkey") - 2) * (F.col("r_regionkey") - 2)).alias("w")
    )
    return V.deconvolve(voxels(spark, d), k, rounds=3).select("t", "x", "y", "z", F.round("value", 6).alias("value"))


@query(
    "local_deviation",
    WITH + """ SELECT a.t, a.x, a.y, a.z, count(*) AS n, round(stddev_samp(b.value), 6) AS deviation FROM labels a JOIN voxels b ON b.t = a.t
    AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY ALL""",
)
def local_deviation(spark, d):
    """Deviation of values in the cube around every labelled voxel."""
    from tendril.operators.statistics import local_deviation as dev

    p = labels(spark, d).select("t", F.struct("x", "y", "z").alias("p"), "x", "y", "z")
    v = voxels(spark, d).select("t", "x", "y", "z", "value")
    out = dev(p, v, 1, ["t"])
    return out.select("t", "p.x", "p.y", "p.z", "n", F.round("deviation", 6).alias("deviation"))


@query(
    "trilinear_samples",
    WITH + """, k AS (SELECT n & 1 AS a, (n >> 1) & 1 AS b, (n >> 2) & 1 AS c FROM range(8) r(n))
    SELECT v.t, v.x, v.y, v.z, round(sum(coalesce(o.value, 0) * CASE WHEN a = 1 THEN 0.25 ELSE 0.75 END * 0.5 * CASE WHEN c = 1 THEN 0.125 ELSE 0.875 END), 6) AS value
    FROM voxels v CROSS JOIN k LEFT JOIN voxels o ON o.t = v.t AND o.x = v.x + a AND o.y = v.y + b AND o.z = v.z + c GROUP BY ALL""",
)
def trilinear_samples(spark, d):
    v = materialize(voxels(spark, d), "voxels")
    pts = v.select("t", F.struct("x", "y", "z").alias("id"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), (F.col("z") + 0.125).alias("z"))
    return V.sample_trilinear(pts, v, ["t"]).select("t", "id.x", "id.y", "id.z", F.round("value", 6).alias("value"))


@query(
    "voxel_arithmetic",
    WITH + """ SELECT t, x, y, z, CAST(x + y * 1000 + z * 7000 AS BIGINT) AS idx, (9 * (z % 3) + 3 * (y % 3) + x % 3) AS code, (x % 3) - 1 AS i, (y % 3) - 1 AS j, (z % 3) - 1 AS k,
    round(sqrt(x * x + y * y + z * z) + 100 / (1e-4 + 0.5 * (least(255, value) + least(255, value + 1))), 6) AS cost,
    round(value / (z + 1), 6) AS priority, (pow((x - 50) / 60.0, 2) + pow((y - 3) / 2.0, 2) + pow((z - 6) / 4.0, 2)) <= 1 AS inside FROM voxels""",
)
def voxel_arithmetic(spark, d):
    """Linear index, direction code and back, step cost, flood priority and ellipsoid test."""
    m = lambda c: F.col(c) % 3 - 1
    code = G.direction_code(m("x"), m("y"), m("z"))
    i, j, k = G.code_to_offset(code)
    return voxels(spark, d).select(
        "t", "x", "y", "z", (G.linear_index("x", "y", "z", F.lit(1000), F.lit(7))).alias("idx"), code.alias("code"), i.alias("i"), j.alias("j"), k.alias("k"),
        F.round(G.traversal_cost(G.distance(["x", "y", "z"], [F.lit(0), F.lit(0), F.lit(0)]), F.col("value"), F.col("value") + 1), 6).alias("cost"),
        F.round(G.flood_priority("value", "z", "value_over_distance"), 6).alias("priority"),
        G.in_ellipsoid(["x", "y", "z"], [F.lit(50), F.lit(3), F.lit(6)], [F.lit(60.0), F.lit(2.0), F.lit(4.0)]).alias("inside"),
    )
