"""Statistics, rules, edits, labels, comparison and files on hand-worked fixtures."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendril import schema, vocab
from tendril.functions import labels as L
from tendril.functions import ordered as O
from tendril.operators import compare, consistency, dictionary, edits, fields, graph, placement, spatial, statistics, tracking
from tendril.operators.skew import ranked, skew_join
from tendril.sources import files
from tendril.streaming.steps import append_steps

# Vertex rows: v, x, y, kind
NODES = [
    (1, 5, 4, vocab.ROOT), (2, 9, 8, vocab.TIP), (3, 2, 1, vocab.TIP), (4, 1, 2, vocab.TIP), (5, 5, 7, vocab.TIP), (6, 1, 7, vocab.TIP),
    (7, 7, 6, vocab.BASE), (8, 4, 3, vocab.BASE), (9, 4, 6, vocab.BASE), (10, 2, 6, vocab.BASE), (11, 3, 2, vocab.BRANCH), (12, 3, 5, vocab.BRANCH),
]
LINES = {
    1: (1, 7, [(5, 4), (6, 5), (7, 6)]), 2: (7, 2, [(7, 6), (8, 7), (9, 8)]), 3: (1, 8, [(5, 4), (4, 3)]), 4: (8, 11, [(4, 3), (3, 2)]),
    5: (11, 3, [(3, 2), (2, 1)]), 6: (11, 4, [(3, 2), (2, 2), (1, 2)]), 7: (1, 12, [(5, 4), (4, 4.5), (3, 5)]), 8: (12, 9, [(3, 5), (4, 6)]),
    9: (9, 5, [(4, 6), (5, 7)]), 10: (12, 10, [(3, 5), (2, 6)]), 11: (10, 6, [(2, 6), (1, 7)]),
}


@pytest.fixture(scope="module")
def scene(spark):
    v = spark.createDataFrame(
        [("g", v, float(x), float(y), 0.0, 8, 1, k, 4 if v == 2 or v == 7 else 5, 1, "NONBULBOUS") for v, x, y, k in NODES],
        "graph_id string, v bigint, x double, y double, z double, t int, gc int, node_type string, object_id int, match_id int, bulbous string",
    )
    e = spark.createDataFrame([("g", e, s, d, 8, 5) for e, (s, d, _) in LINES.items()], "graph_id string, e bigint, src bigint, dst bigint, t int, object_id int")
    p = spark.createDataFrame(
        [("g", e, i, float(x), float(y), 0.0) for e, (_, _, pts) in LINES.items() for i, (x, y) in enumerate(pts)], schema.POINTS
    )
    return v.cache(), e.cache(), p.cache()


def test_lengths_and_filaments(scene):
    v, e, p = scene
    got = {r.e: r.length for r in graph.edge_lengths(p).collect()}
    want = {1: 2 * math.sqrt(2), 2: 2 * math.sqrt(2), 3: math.sqrt(2), 6: 2.0, 7: math.sqrt(5)}
    assert all(math.isclose(got[k], x) for k, x in want.items())
    rows = {r.base_v: r for r in statistics.filament_table(v, e, p).collect()}
    assert math.isclose(rows[8].total_length, 2 * math.sqrt(2) + 2) and rows[8].n_branch == 1 and rows[8].n_tips == 2
    assert math.isclose(rows[9].total_length, math.sqrt(2)) and [rows[b].filament_id for b in (7, 8, 9, 10)] == [0, 1, 2, 3]
    # Base at (7,6), root at (5,4): direction (-1,-1)/sqrt2, 135 degrees from (0,1).
    assert math.isclose(rows[7].angle, 135.0)
    nodes, lines = graph.location_labels(graph.orient(v, e), v, e)
    assert {r.e for r in lines.filter("location = 'GROWTHCONE'").collect()} == {1, 3, 7, 8, 10}
    assert {r.v for r in nodes.filter("location = 'GROWTHCONE'").collect()} == {1, 12}
    assert consistency.violations(v, e).filter("component <> 'filopodium' AND component <> 'filopodia'").count() == 0


def test_growth_events(spark):
    lengths = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.05), (1, 3, 0.5), (2, 0, 1.0), (2, 4, 1.0)], "object_id int, t int, length double")
    ev = statistics.speeds(lengths, ["object_id"], lengths.agg(F.max("t")))
    first = [round(r.speed, 9) for r in ev.filter("object_id = 1").orderBy("t").collect()]
    assert first == [-1.0, -0.05, 0.55, 0.5]
    row = statistics.speed_table(ev, ["object_id"], 0.1).filter("object_id = 1").first()
    assert (row.n_events, row.n_filtered, row.n_extensions, row.n_retractions, row.n_static, row.static_share) == (4, 3, 1, 2, 1, 0.25)
    assert math.isclose(row.retraction_std_compat, math.sqrt(((0.55 - 1) ** 2 + (0.5 - 1) ** 2) / 2))


def test_ordered_runs_cross_boundaries(spark, monkeypatch):
    monkeypatch.setattr(O, "RUN", 3)
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "k int, pos int, v double")
    got = [r.s for r in O.running_sums(df, ["k"], "pos", {"s": F.col("v")}).orderBy("pos").collect()]
    assert got == list(np.cumsum(range(10)).astype(float))
    rows = O.neighbours(df, ["k"], "pos", ["v"], back="b", ahead="a").orderBy("pos").collect()
    assert [r.b.v if r.b else None for r in rows] == [None, *map(float, range(9))]
    assert [r.a.v if r.a else None for r in rows] == [*map(float, range(1, 10)), None]


def test_best_split(spark):
    y = [10.0, 8.0, 6.0, 4.0, 2.0, 2.1, 1.9, 2.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(y)], "k int, pos int, err double")
    scores = {}
    for s in range(2, len(y) - 1):
        x = np.arange(s)
        line = np.polyfit(x, y[:s], 1)
        scores[s] = (((np.polyval(line, x) - y[:s]) ** 2).sum() + ((np.array(y[s:]) - np.mean(y[s:])) ** 2).sum()) / len(y)
    assert O.best_split(df, ["k"], "pos", "err", 1e-9).first().split == min(scores, key=scores.get) - 1
    assert O.best_split(df, ["k"], "pos", "err", 1e9).first().split == -1


def test_opacity_above_one_is_not_a_number(spark):
    alpha = {1: [0.2, 1.1, 0.3], 2: [0.2, 0.6, 1.1], 3: [0.2, 1.0, 1.1], 4: [0.2, 0.1], 5: [1.2]}
    df = spark.createDataFrame([(k, i, a) for k, row in alpha.items() for i, a in enumerate(row)], "k int, pos int, alpha double")
    got = {r.k: (r.pos, r.opacity) for r in O.opacity_hit(df, ["k"], "pos", "alpha").collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1][0] == 1 and math.isnan(got[1][1]) and got[5][0] == 0 and math.isnan(got[5][1])
    assert got[2][0] == 1 and math.isclose(got[2][1], 0.68) and got[3] == (1, 1.0)


def test_sums_follow_the_order_of_the_rows(spark, monkeypatch):
    big = [1e16, 1.0, 1.0, -1e16, None, 3.0]  # one after another 1.0 is lost twice
    rows = [(k, i, v) for i, v in enumerate(big) for k in range(50)] + [(99, 0, None)]
    df = spark.createDataFrame(rows[::-1], "k int, at long, v double").repartition(7)
    want = {k: 3.0 for k in range(50)} | {99: None}
    for stretch in (1 << 20, 1):
        monkeypatch.setattr(O, "STRETCH", stretch)
        assert {r.k: r.s for r in O.sums_in_order(df, ["k"], "at", "v", "s").collect()} == want


def test_speeds_at_the_limit(spark, tmp_path):
    """134.8 added up in another order is 134.80000000000001, and 25 above 109.8 no more."""
    import datetime as dt

    from tendril.plans.series import speed_classes, speed_events

    a, b, c = next((a / 100, b / 100, c / 100) for a in range(1, 4000, 7) for b in range(3, 4000, 11) for c in (333, 1777)
                   if (a / 100 + b / 100) + c / 100 - ((a + b + c - 2500) / 100) <= 25.0 < a / 100 + (b / 100 + c / 100) - ((a + b + c - 2500) / 100) and a + b + c > 2600)
    day = lambda t: dt.datetime(2024, 1, 1 + t, 12)
    rows = [(3 * u + i, day(0), u, v) for u in range(40) for i, v in enumerate((a, b, c))]
    rows += [(1000 + u, day(1), u, (round(100 * (a + b + c)) - 2500) / 100) for u in range(40)]
    # Many files, so that a plain sum would add up the values of a day as their tasks end.
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, user_id long, value double").withColumn("event_type", F.lit("view")).repartition(40).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.n_static for r in speed_events(spark, str(tmp_path)).collect()} == {1}
    assert {(r["class"], r.n) for r in speed_classes(spark, str(tmp_path)).collect()} == {("static", 40)}


def test_skew_join_and_rank(spark):
    facts = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k int, v int")
    dims = spark.createDataFrame([(i, i * 10) for i in range(300)], "k int, w int")
    from tendril.operators import skew

    assert skew.hot_keys(facts, ["k"], 0.3, 10).count() == 1
    want = sorted(map(tuple, facts.join(dims, "k").collect()))
    monkey = skew.hot_keys
    skew.hot_keys = lambda df, keys: monkey(df, keys, 0.3, 10)
    try:
        assert sorted(map(tuple, skew_join(facts, dims, ["k"]).collect())) == want
    finally:
        skew.hot_keys = monkey
    assert [r.rank for r in ranked(facts, [F.col("v")]).orderBy("v").collect()] == list(range(300))


def test_split_contract_and_undo(spark, scene):
    v, e, p = scene
    g = edits.Graph(v, e, p)
    before = tuple(g.counts().first())
    cut = spark.createDataFrame([("g", 2, 1, 100, 101, 102, vocab.BRANCH)], "graph_id string, e bigint, ord int, v bigint, e1 bigint, e2 bigint, node_type string")
    split = edits.split_edges(g, cut, 0)
    after = edits.apply(g, split)
    assert tuple(after.counts().first()) == (before[0] + 1, before[1] + 1, before[2] + 1)
    assert tuple(edits.apply(g, split.until(-1)).counts().first()) == before
    # Deleting tip 3 leaves branch 11 with two edges: they become one.
    gone = edits.delete(g, v.filter("v = 3"), None, 0)
    out = edits.apply(g, gone)
    assert {r.v for r in out.vertices.collect()} == {n[0] for n in NODES} - {3, 11}
    line = out.points.filter("e = 4").orderBy("ord").collect()
    assert [(r.x, r.y) for r in line] == [(4, 3), (3, 2), (2, 2), (1, 2)]
    moved = edits.apply(g, edits.move_vertices(g, spark.createDataFrame([("g", 2, 9.0, 9.0, 0.0)], "graph_id string, v bigint, x double, y double, z double"), 0))
    assert moved.points.filter("e = 2 AND ord = 2").first().y == 9.0
    last, log = edits.replay(g, [("ConvertPoint", {"cuts": cut}), ("AddAndAssignLabel", {"selection": v.filter("v = 2"), "column": "match_id", "value": F.lit(9)})])
    assert last.vertices.filter("match_id = 9").count() == 1
    assert edits.apply(g, log.until(0)).vertices.filter("match_id = 9").count() == 0


def test_labels_and_dictionary(spark):
    names = ["p/x_gc001_t012.am", "GrowthCone3_07.tif", "a_12_GrowthCone4", "q_gc009.am"]
    got = [tuple(r.m) for r in spark.createDataFrame([(n,) for n in names], "p string").select(L.object_and_time("p").alias("m")).collect()]
    assert got == [(1, 12), (3, 7), (4, 12), (9, None)]
    with pytest.raises(Exception, match="no object and time"):
        spark.createDataFrame([("x.am",)], "p string").select(L.object_and_time("p")).collect()
    used = spark.createDataFrame([("g", i) for i in (4, 5, 8, 11)], "graph_id string, id int")
    assert dictionary.first_unused(used).first().next_id == 6
    assert sorted((r.old_id, r.new_id) for r in dictionary.compaction(used).collect()) == [(8, 7), (11, 6)]
    labels = dictionary.create_group(spark.createDataFrame([("g",)], "graph_id string"), "NodeType")
    assert {r.grp for r in schema.missing_labels(labels).collect()} >= {"Filopodia", "TimeStep"}


def test_manual_tracking(spark):
    items = spark.createDataFrame(
        [("g", t, i, x, 0.0, 0.0, m) for t, i, x, m in [(0, 1, 0.0, 4), (0, 2, 0.5, 1), (1, 3, 0.1, 5), (1, 4, 0.6, 1), (2, 5, 0.1, 5), (2, 6, 3.0, 4)]],
        "graph_id string, t int, id bigint, x double, y double, z double, match_id int",
    )
    got = {r.id: r.track for r in tracking.with_manual_matches(items, 1.0).collect()}
    # 1 and 6 share id 4, so 1 cannot take 3 (id 5); 2 is the nearest free end for 4.
    assert got[1] == got[6] == 1 and got[3] == got[5] != got[1] and got[2] == got[4]


def test_comparison_totals(spark, scene):
    _, _, p = scene
    both = p.unionByName(p.withColumn("graph_id", F.lit("h")).withColumn("x", F.col("x") + 0.01))
    stats = compare.compare(both, 3.0, 1.0).toPandas()
    total = graph.edge_lengths(p).agg(F.sum("length")).first()[0]
    assert np.allclose(stats.groupby("graph_id").length.sum(), total)
    assert set(stats.k) == {1}


def test_label_correction_drops_single_sided_smear(spark):
    lab = spark.createDataFrame([("f", 0, 0, 0, z, 1) for z in (1, 2, 3)], "field_id string, t int, x int, y int, z int, label int")
    img = spark.createDataFrame([("f", 0, 0, 0, z, v) for z, v in ((1, 5.0), (2, 9.0), (3, 9.0))], "field_id string, t int, x int, y int, z int, value double")
    assert {r.z for r in fields.correct_labels(lab, img).collect()} == {2, 3}


def test_clip_by_closed_surface(spark):
    c = [(x, y, z) for x in (0.0, 2.0) for y in (0.0, 2.0) for z in (0.0, 2.0)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    tri = [(i * 2 + k, *c[q[0]], *c[q[1 + k]], *c[q[2 + k]]) for i, q in enumerate(quads) for k in (0, 1)]
    T = spark.createDataFrame(tri, "tri_id int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    P = spark.createDataFrame([("g", 1, 0, -1.0, 0.7, 0.9), ("g", 1, 1, 1.0, 0.7, 0.9), ("g", 1, 2, 3.0, 0.7, 0.9)], schema.POINTS)
    inside = placement.clip_by_surface(P, T, 1.0).orderBy("ord").collect()
    assert [r.x for r in inside] == [0.0, 1.0, 2.0]
    outside = placement.clip_by_surface(P, T, 1.0, keep_inside=False).orderBy("ord").collect()
    assert [r.x for r in outside] == [-1.0, 0.0, 2.0, 3.0]


def test_files(spark, tmp_path):
    (tmp_path / "s_gc001_t000.am").write_text(
        '# Mesh ASCII 1.0\n\ndefine VERTEX 3\ndefine EDGE 2\ndefine POINT 5\n\nParameters { ContentType "HxSpatialGraph" }\n\n'
        "VERTEX { float[3] VertexCoordinates } @1\nEDGE { int[2] EdgeConnectivity } @2\nEDGE { int NumEdgePoints } @3\nPOINT { float[3] EdgePointCoordinates } @4\n\n"
        "# Data section follows\n@1\n0 0 0\n1 0 0\n2 0 0\n\n@2\n0 1\n1 2\n\n@3\n2\n3\n\n@4\n0 0 0\n1 0 0\n1 0 0\n1.5 0 0\n2 0 0\n"
    )
    v, e, p = files.read_graphs(spark, str(tmp_path))
    assert v.count() == 3 and [(r.src, r.dst) for r in e.orderBy("e").collect()] == [(0, 1), (1, 2)]
    assert [(r.e, r.ord, r.x) for r in p.orderBy("e", "ord").collect()] == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.5), (1, 2, 2.0)]
    assert files.file_per_step(files.list_files(spark, str(tmp_path), "am")).first().t == 0
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path), "hoc")
    hoc = tmp_path / "h"
    hoc.mkdir()
    (hoc / "n.hoc").write_text("create a, b\na {\n pt3dadd(0,0,0,1)\n pt3dadd(1,0,0,1)\n}\nb {\n pt3dadd(1,0,0,0.5)\n}\nconnect b(0), a(1)\n")
    pts, links = files.read_traces(spark, str(hoc))
    assert pts.count() == 3 and tuple(links.select("child", "parent").first()) == ("b", "a")
    page = np.arange(6, dtype=np.uint8).reshape(2, 3)
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 6)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", x, 0) if k == 3 else struct.pack("<I", x)) for t, k, n, x in tags) + struct.pack("<I", 0)
    tif = tmp_path / "t"
    tif.mkdir()
    (tif / "i.tif").write_bytes(struct.pack("<2sHI", b"II", 42, 14) + page.tobytes() + ifd)
    img = files.read_images(spark, str(tif))
    assert [r.value for r in img.orderBy("z", "y", "x").collect()] == [0, 1, 2, 3, 4, 5]
    files.convert_images(spark, str(tif), str(tmp_path / "out"), window=(0, 5))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_streamed_steps(spark, tmp_path):
    for i in range(2):
        pd.DataFrame({"x": [float(i)], "id": [i]}).to_parquet(tmp_path / f"in{i}.parquet")
    src = spark.readStream.schema("x double, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    append_steps(src, str(tmp_path / "steps"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.t, r.id) for r in spark.read.parquet(str(tmp_path / "steps")).collect()) in ([(0, 0), (1, 1)], [(0, 1), (1, 0)])


def test_roots_follow_a_moving_blob(spark):
    from tendril.operators.propagation import propagate_roots

    rows = []
    for t in range(3):
        for x in range(12):
            for y in range(7):
                d2 = (x - 3 - t) ** 2 + (y - 3) ** 2
                rows.append(("f", t, x, y, 0, 100 * math.exp(-d2 / 4)))
    img = spark.createDataFrame(rows, "field_id string, t int, x int, y int, z int, value double")
    root = spark.createDataFrame([("f", 1, 3, 3, 0)], "field_id string, id int, x int, y int, z int")
    got = propagate_roots(img, root, 2, (2, 2, 0), (2, 1, 0)).orderBy("t").collect()
    assert [(r.x, r.y) for r in got] == [(3, 3), (4, 3), (5, 3)]


def chain_graph(spark, n, ring=False, seed=3):
    """A root, n branching nodes with a side tip each, a tip; edges in random directions with shuffled ids."""
    rng = random.Random(seed)
    ids = rng.sample(range(1, 10 * n + 20), n + 1)
    flips = [rng.random() < 0.5 for _ in ids]
    verts = [("g", 0, 0.0, 0.0, 0.0, vocab.ROOT)] + [("g", i, float(i), 0.0, 0.0, vocab.BRANCH) for i in range(1, n + 1)] + [("g", n + 1, n + 1.0, 0.0, 0.0, vocab.TIP)]
    edges, points = [], []
    for i, (e, f) in enumerate(zip(ids, flips)):
        a, b = (i + 1, i) if f else (i, i + 1)
        if ring and i in (0, n):
            continue
        edges.append(("g", e, a, b))
        points += [("g", e, k, a + (b - a) * k / 2, 0.0, 0.0) for k in range(3)]
    for i in range(1, n + 1):
        verts.append(("g", 10_000 + i, float(i), 1.0, 0.0, vocab.TIP))
        edges.append(("g", 100_000 + i, i, 10_000 + i))
        points += [("g", 100_000 + i, k, float(i), float(k), 0.0) for k in range(2)]
    if ring:
        edges.append(("g", 200_000, n, 1))
        points += [("g", 200_000, 0, float(n), 0.0, 0.0), ("g", 200_000, 1, 1.0, 0.0, 0.0)]
    g = edits.Graph(
        spark.createDataFrame(verts, "graph_id string, v bigint, x double, y double, z double, node_type string"),
        spark.createDataFrame(edges, "graph_id string, e bigint, src bigint, dst bigint"),
        spark.createDataFrame(points, "graph_id string, e bigint, ord int, x double, y double, z double"),
    )
    return g, ids


@pytest.mark.parametrize("n", [1, 3, 300])
def test_chains_become_one_edge(spark, n):
    g, ids = chain_graph(spark, n)
    out = edits.apply(g, edits.delete(g, g.vertices.filter("v > 10000"), None, 0))
    assert {r.v for r in out.vertices.collect()} == {0, n + 1}
    (edge,) = out.edges.collect()
    first, last = (0, n + 1) if ids[0] < ids[-1] else (n + 1, 0)
    assert (edge.e, edge.src, edge.dst) == (min(ids), first, last)
    line = [(r.ord, r.x) for r in out.points.orderBy("ord").collect()]
    assert line == [(k, k / 2 if first == 0 else n + 1 - k / 2) for k in range(2 * n + 3)]


def test_ring_keeps_its_highest_node(spark):
    g, _ = chain_graph(spark, 6, ring=True)
    out = edits.apply(g, edits.delete(g, g.vertices.filter("v > 10000"), None, 0))
    assert {r.v for r in out.vertices.collect()} == {0, 6, 7}
    (edge,) = out.edges.collect()
    assert (edge.src, edge.dst) == (6, 6)
    xs = [r.x for r in out.points.orderBy("ord").collect()]
    assert xs[0] == xs[-1] == 6.0 and len(xs) == 12 and set(xs) == {k / 2 for k in range(2, 13)}


def test_one_far_point_leaves_tiles_as_they_are(spark):
    """Tile order by quantiles: pairs of tiles in reach grow little with one outlier, and results stay exact."""
    rng = np.random.default_rng(5)
    xyz = rng.uniform(0, 100, (4000, 3))
    rows = [(0, i, *map(float, p)) for i, p in enumerate(xyz)]
    far = [(0, 99_999, 1e12, -1e12, 1e12)]
    schema_ = "g int, id bigint, x double, y double, z double"

    def tiles(rows):
        tree = spatial.TileTree(spark.createDataFrame(rows, schema_), "t")
        return [r.asDict() for r in tree.leaves().collect()]

    def near(leaves, radius=3.0):
        gap = lambda a, b: sum(max(0.0, a[f"l{c}"] - b[f"h{c}"], b[f"l{c}"] - a[f"h{c}"]) ** 2 for c in "xyz")
        return sum(gap(a, b) < radius**2 for a in leaves for b in leaves)

    assert near(tiles(rows + far)) <= 1.5 * near(tiles(rows))
    df = spark.createDataFrame(rows + far, schema_)
    found = {(r.l_id, r.r_id) for r in spatial.near_pairs(df, df, 3.0).collect()}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 < 9.0))} | {(99_999, 99_999)}
