"""Joins are planned from sizes of rows, not of packed files."""

import contextlib
import io
import math

import numpy as np
from pyspark.sql import functions as F

from tendril.functions import geometry
from tendril.operators import compare, costmap, fields, graph, spatial, topology
from tendril.session import materialize


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_packed_table_of_many_rows_is_not_broadcast(spark):
    many = materialize(spark.range(600_000).select("id", F.struct(F.col("id").alias("p"), F.lit("field").alias("f")).alias("node")), "many")
    more = materialize(spark.range(4_000_000).select((F.col("id") % 600_000).alias("id"), F.col("id").alias("k")), "more")
    joined = more.join(many, "id")
    assert "BroadcastHashJoin" not in plan_of(joined)
    few = materialize(spark.range(10).select("id", F.lit(1).alias("one")), "few")
    assert "BroadcastHashJoin" in plan_of(more.join(few, "id"))


def test_written_tables_leave_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    shuffled = spark.range(1000).repartition(4, "id")
    want, before = shuffled.count(), held()
    out = [materialize(shuffled.groupBy((F.col("id") % 7).alias("k")).count(), "few") for _ in range(3)]
    assert held() <= before
    assert [o.agg(F.sum("count")).first()[0] for o in out] == [want] * 3 and shuffled.count() == want
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_basins_alone_make_no_saddles(spark):
    rows = [("f", 0, x, 0, 0, float(v)) for x, v in enumerate([1, 5, 2, 4, 3])]
    tree = topology.MergeTree(spark.createDataFrame(rows, "field_id string, t int, x int, y int, z int, value double"))
    assert not {"saddles", "pairs"} & set(vars(tree))
    assert {(r.node.p.x, r.top.p.x) for r in tree.tops.collect()} == {(0, 1), (1, 1), (2, 1), (3, 3), (4, 3)}
    assert [(r.top.v, r.saddle.v) for r in tree.pairs.collect()] == [(4.0, 2.0)]


def test_lattice_bounds_go_to_every_task(spark):
    """A join by field put all neighbours of a field into one task."""
    rows = [("f", 0, x, y, 0) for x in range(3) for y in range(2)]
    v = materialize(spark.createDataFrame(rows, "field_id string, t int, x int, y int, z int"), "voxels")
    dims = v.groupBy("field_id").agg((F.max("x") + 1).alias("nx"), F.lit(2).alias("ny"), F.lit(1).alias("nz"))
    near = fields.neighbours_of(v, 6, ["field_id", "t", "x", "y", "z"], dims=dims)
    assert "BroadcastHashJoin" in plan_of(near)
    got = {(r.x, r.y): r.n for r in near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(x, y): 3 if x == 1 else 2 for x in range(3) for y in range(2)}


def test_resampled_lengths_list_no_points(spark):
    rows = [("g", 1, 0, 0.0, 0.0, 0.0), ("g", 1, 1, 3.0, 4.0, 0.0), ("g", 1, 2, 3.0, 4.0, 0.5), ("g", 2, 0, 1.0, 1.0, 1.0), ("g", 3, 0, 0.0, 0.0, 0.0), ("g", 3, 1, 1e9, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "graph_id string, e long, ord int, x double, y double, z double")
    got = {r.e: round(r.length, 6) for r in compare.resampled_lengths(pts, 2.0).collect()}  # edge 3 would have half a thousand million points
    assert got == {1: 5.5, 2: 0.0, 3: 1e9}
    short = pts.filter("e < 3")
    assert {r.e: round(r.length, 6) for r in graph.edge_lengths(compare.resample(short, 2.0)).collect()} == {1: 5.5, 2: 0.0}


def test_blocks_grow_along_a_thin_field(spark):
    assert costmap.block_shape((6000, 7, 12)) == (1024, 8, 16)  # 188 cubes of 32 along x, 6 blocks now
    assert costmap.block_shape((1, 1, 1)) == (2, 2, 2)
    x, y, z = costmap.block_shape((500, 500, 500))
    assert x * y * z <= costmap.LARGER * costmap.BLOCK**3 and min(x, y, z) >= costmap.BLOCK


def test_first_of_equal_ways(spark, monkeypatch):
    """Distances and directions do not depend on how a field is cut."""
    rng = np.random.default_rng(11)
    rows = [("f", 0, x, y, 0, float(rng.integers(1, 4))) for x in range(40) for y in range(5)]
    v = spark.createDataFrame(rows, "field_id string, t int, x int, y int, z int, value double")
    root = v.filter("x = 20 and y = 2")
    got = []
    for block in (4, 32):
        monkeypatch.setattr(costmap, "BLOCK", block)
        got.append({(r.x, r.y): (r.dist, r.prior) for r in costmap.cost_distance(v, root).collect()})
    assert got[0] == got[1]


def test_trilinear_samples_travel_once(spark):
    rng = np.random.default_rng(4)
    value = {(x, y, z): float(rng.integers(0, 50)) for x in range(-3, 7) for y in range(6) for z in range(5) if rng.random() < 0.8}
    v = spark.createDataFrame([(0, *p, w) for p, w in value.items()] + [(0, 40, 0, 0, float("nan")), (0, 41, 1, 1, 7.0)], "t int, x int, y int, z int, value double")
    at = [tuple(float(c) for c in rng.uniform(-4, 8, 3)) for _ in range(200)] + [(3.0, 3.0, 3.0), (-1.0, 0.5, 4.0), (41.5, 1.0, 1.0)]
    pts = materialize(spark.createDataFrame([(0, i, *p) for i, p in enumerate(at)], "t int, id int, x double, y double, z double"), "pts")
    out = fields.sample_trilinear(pts, v, ["t"])
    assert "Expand" not in plan_of(out) and plan_of(out).count("explode") == 3  # the voxels' three axes; points are not multiplied
    got = {r.id: r.value for r in out.collect()}
    value[(41, 1, 1)] = 7.0
    for i, p in enumerate(at):
        want, low = 0.0, [math.floor(c) for c in p]
        for n in range(8):
            o = [(n >> k) & 1 for k in range(3)]
            w = math.prod((c - l) if b else 1 - (c - l) for c, l, b in zip(p, low, o))
            want += w * value.get(tuple(l + b for l, b in zip(low, o)), 0.0)
        assert math.isclose(got[i], want, abs_tol=1e-9), (i, p)


def test_label_centres_search_from_inside_only(spark, monkeypatch):
    """Voxels next to a free place are settled; before, every voxel met all points of the tiles around it."""
    block = [(0, 1, x, y, z) for x in range(7) for y in range(5) for z in range(5)]
    flat = [(0, 2, x, y, 0) for x in range(20) for y in range(4)]
    lab = spark.createDataFrame([("f", *r) for r in block + flat + flat[:3]], "field_id string, t int, label int, x int, y int, z int")
    asked = []
    real = fields.spatial.nearest
    monkeypatch.setattr(fields.spatial, "nearest", lambda left, right: asked.append(left.count()) or real(left, right))
    got = {r.label: (r.x, r.y, r.z, r.depth) for r in fields.label_centres(lab).collect()}
    assert got == {1: (2, 2, 2, 3.0), 2: (0, 0, 0, 1.0)} and asked == [5 * 3 * 3]
    size = (1.0, 2.5, 1.0)
    got = {r.label: (r.x, r.y, r.z, round(r.depth, 9)) for r in fields.label_centres(lab, size).collect()}
    for label, cells in ((1, block), (2, flat)):
        cells = {c[2:] for c in cells}
        free = {tuple(p[k] + (s if k == a else 0) for k in range(3)) for p in cells for a in range(3) for s in (-1, 1)} - cells
        depth = {p: min(math.sqrt(sum(((a - b) * w) ** 2 for a, b, w in zip(p, q, size))) for q in free) for p in cells}
        best = min(cells, key=lambda p: (-round(depth[p], 9), p[2], p[1], p[0]))
        assert got[label] == (*best, round(depth[best], 9))


def test_nearest_lists_no_pairs_of_points(spark):
    rng = np.random.default_rng(8)
    at = {s: [(i % 2, i, *p) for i, p in enumerate(np.round(rng.normal(0, 1, (n, 3)), 2).tolist())] for s, n in (("l", 700), ("r", 900))}
    side = {s: spark.createDataFrame(rows, "g int, id long, x double, y double, z double") for s, rows in at.items()}
    holes = spark.createDataFrame([(0, 5000, None, 0.0, 0.0), (1, 5001, float("nan"), 0.0, 0.0)], "g int, id long, x double, y double, z double")
    out = spatial.nearest(side["l"].unionByName(holes), side["r"].unionByName(holes))
    assert "closest(" in plan_of(out)  # tiles meet, one row each
    got = {r.l_id: (r.r_id, round(r.dist, 9)) for r in out.collect()}
    for g, i, *p in at["l"]:
        d, r = min((sum((a - b) ** 2 for a, b in zip(p, q)), j) for h, j, *q in at["r"] if h == g)
        assert got[i] == (r, round(math.sqrt(d), 9))
    assert len(got) == 700
    assert {r.l_id for r in spatial.nearest(side["l"], side["r"], 0.2).collect()} == {i for i, (_, d) in got.items() if d < 0.2}


def test_far_lattice_points_have_a_distance(spark):
    """Squares of whole numbers above 46340 do not fit an int."""
    df = spark.createDataFrame([(60_000, 80_000, 0), (3, 4, 12)], "x int, y int, z int")
    zero = [F.lit(0)] * 3
    got = [tuple(r) for r in df.select(geometry.distance(["x", "y", "z"], zero), geometry.linear_index("x", "y", "z", F.lit(1000), F.lit(7)), geometry.linear_index("x", "y", "y", F.lit(100_000), F.lit(7))).collect()]
    assert got == [(100_000.0, 80_060_000, 56_000_000_000 + 8_000_000_000 + 60_000), (13.0, 88_003, 3 + 400_000 + 2_800_000)]
