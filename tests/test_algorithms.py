"""Distributed algorithms against plain sequential ones on small fixtures."""

import heapq
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendril.operators import costmap, fields, graph, matching, spatial, topology, tracking
from tendril.operators.fields import FULL


def points(rng, n, hot=0.33, groups=2):
    df = pd.DataFrame({"g": rng.integers(0, groups, n), "id": np.arange(n), "x": rng.random(n) * 5, "y": rng.random(n) * 5, "z": rng.random(n)})
    df.loc[: int(n * hot), ["g", "x", "y", "z"]] = [0, 1.0, 1.0, 0.5]  # a third of all points on one spot
    return df


def brute(a, b, radius=None):
    j = a.merge(b, on="g", suffixes=("_a", "_b"))
    j["d"] = np.sqrt(sum((j[f"{c}_a"] - j[f"{c}_b"]) ** 2 for c in "xyz"))
    return j if radius is None else j[j.d < radius]


def test_distance_joins_with_a_hot_spot(spark):
    rng = np.random.default_rng(3)
    a, b = points(rng, 240), points(rng, 200)
    A, B = spark.createDataFrame(a), spark.createDataFrame(b)
    want = brute(a, b, 0.4)
    got = spatial.near_pairs(A, B, 0.4).toPandas()
    assert set(zip(got.l_id, got.r_id)) == set(zip(want.id_a, want.id_b))
    counts = spatial.near_counts(A, B, 0.4).toPandas().set_index("id").n
    expect = want.groupby("id_a").size().reindex(a.id, fill_value=0)
    assert (counts.loc[a.id].to_numpy() == expect.to_numpy()).all()
    near = spatial.nearest(A, B).toPandas().set_index("l_id")
    best = brute(a, b).sort_values(["id_a", "d", "id_b"]).drop_duplicates("id_a").set_index("id_a")
    assert (near.r_id.loc[best.index] == best.id_b).all()


def greedy_by_hand(pairs):
    used_l, used_r, out = set(), set(), set()
    for d, l, r in sorted(pairs):
        if l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), out.add((l, r))
    return out


def test_greedy_rounds_equal_sequential_greedy(spark):
    rng = np.random.default_rng(5)
    a, b = points(rng, 24, hot=0.1, groups=1), points(rng, 20, hot=0.1, groups=1)
    A, B = spark.createDataFrame(a), spark.createDataFrame(b)
    want = greedy_by_hand(brute(a, b, 1.0)[["d", "id_a", "id_b"]].itertuples(index=False, name=None))
    got = tracking.greedy_pairs(spatial.near_pairs(A, B, 1.0)).toPandas()
    assert set(zip(got.l_id, got.r_id)) == want
    dense = tracking.nearest_first(A, B, 1.0).toPandas()
    assert len(dense) == len(want)
    assert math.isclose(dense.dist.sum(), got.dist.sum(), rel_tol=1e-9)


def test_components_and_spanning_forest(spark):
    rng = np.random.default_rng(7)
    n, m = 80, 90
    e = pd.DataFrame({"e": np.arange(m), "a": rng.integers(0, n, m), "b": rng.integers(0, n, m), "w": rng.random(m)})
    hub = pd.DataFrame({"e": np.arange(m, m + 30), "a": 0, "b": np.arange(30) + 40, "w": rng.random(30)})
    e = pd.concat([e, hub])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    tree = set()
    for r in e.sort_values(["w", "e"]).itertuples():
        p, q = find(r.a), find(r.b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            tree.add(r.e)
    E = spark.createDataFrame(e)
    got = {r.id: r.component for r in graph.components(E, "a", "b").collect()}
    assert got == {v: find(v) for v in got}
    assert {r.e for r in graph.spanning_forest(E).collect()} == tree


def test_shortest_paths(spark):
    e = pd.DataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0), (8, 9, 1.0)], columns=["a", "b", "w"])
    got = {r.v: (r.dist, r.pred) for r in graph.shortest_paths(spark.createDataFrame(e), spark.createDataFrame([(0,)], "source bigint")).collect()}
    assert got == {0: (0.0, None), 1: (1.0, 0), 2: (2.0, 1), 3: (3.0, 2)}


def test_cliques(spark):
    e = [(a, b) for a, b in itertools.combinations(range(5), 2)] + [(4, 5), (5, 6)]
    E = spark.createDataFrame(e, "a int, b int")
    assert graph.triangles(E).count() == math.comb(5, 3)
    assert {tuple(r.members) for r in graph.cliques(E, 4).collect()} == set(itertools.combinations(range(5), 4))


def lattice(shape, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 60, shape).astype(float)
    x, y, z = np.indices(shape)
    return pd.DataFrame({"field_id": "f", "t": 0, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "value": v.ravel()}), v


def dijkstra(v, root, weight=100.0, top=255.0):
    dist, heap = {root: 0.0}, [(0.0, root)]
    while heap:
        d, p = heapq.heappop(heap)
        if d > dist[p]:
            continue
        for o in FULL:
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= a < n for a, n in zip(q, v.shape)):
                c = d + math.sqrt(sum(a * a for a in o)) + weight / (1e-4 + 0.5 * (min(top, v[p]) + min(top, v[q])))
                if c < dist.get(q, math.inf) - 1e-12:
                    dist[q] = c
                    heapq.heappush(heap, (c, q))
    return dist


def test_cost_distance_over_several_cubes(spark, monkeypatch):
    monkeypatch.setattr(costmap, "BLOCK", 4)
    pdf, v = lattice((9, 7, 6), 11)
    V = spark.createDataFrame(pdf).selectExpr("field_id", "cast(t as int) t", "cast(x as int) x", "cast(y as int) y", "cast(z as int) z", "value")
    root = spark.createDataFrame([("f", 0, 1, 2, 3)], "field_id string, t int, x int, y int, z int")
    costs = costmap.cost_distance(V, root)
    got = {(r.x, r.y, r.z): r for r in costs.collect()}
    want = dijkstra(v, (1, 2, 3))
    assert all(math.isclose(got[p].dist, d, rel_tol=1e-9) for p, d in want.items())
    seed = spark.createDataFrame([("f", 0, 5, 8, 6, 5)], "field_id string, t int, seed int, x int, y int, z int")
    path = [(r.x, r.y, r.z) for r in costmap.trace(costs, seed).orderBy("ord").collect()]
    assert path[0] == (8, 6, 5) and path[-1] == (1, 2, 3)
    assert all(max(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
    cost = sum(math.dist(p, q) + 100 / (1e-4 + 0.5 * (v[p] + v[q])) for p, q in zip(path, path[1:]))
    assert math.isclose(cost, want[(8, 6, 5)], rel_tol=1e-9)


def face(p, shape):
    for o in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)):
        q = tuple(a + b for a, b in zip(p, o))
        if all(0 <= a < n for a, n in zip(q, shape)):
            yield q


def sweep(v, limit):
    """Sequential sweep: voxels from high to low, merging segments of low persistence."""
    key = lambda p: (v[p], p[::-1])
    seg, parent, peak = {}, {}, {}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for p in sorted(np.ndindex(v.shape), key=key, reverse=True):
        near = [q for q in face(p, v.shape) if q in seg]
        if not near:
            seg[p], parent[p], peak[p] = p, p, p
            continue
        best = max(near, key=key)
        seg[p] = seg[best]
        for q in sorted(near, key=key, reverse=True):
            a, b = find(seg[p]), find(seg[q])
            if a != b:
                lo, hi = sorted((a, b), key=lambda s: key(peak[s]))
                if v[peak[lo]] - v[p] <= limit:
                    parent[lo] = hi
    return {p: peak[find(s)] for p, s in seg.items()}


@pytest.mark.parametrize("limit", [0.0, 15.0])
def test_segments_equal_sequential_sweep(spark, limit):
    pdf, v = lattice((7, 6, 4), 13)
    V = spark.createDataFrame(pdf).selectExpr("field_id", "cast(t as int) t", "cast(x as int) x", "cast(y as int) y", "cast(z as int) z", "value")
    seg = topology.MergeTree(V).segments(limit).select("node.p.*", F.col("top.p").alias("q")).collect()
    got = {(r.x, r.y, r.z): (r.q.x, r.q.y, r.q.z) for r in seg}
    assert got == sweep(v, limit)


def test_flood_takes_the_brightest_way(spark, monkeypatch):
    monkeypatch.setattr(costmap, "BLOCK", 4)
    pdf, v = lattice((7, 6, 4), 17)
    V = spark.createDataFrame(pdf).selectExpr("field_id", "cast(t as int) t", "cast(x as int) x", "cast(y as int) y", "cast(z as int) z", "value")
    seeds = {(0, 0, 0): 1, (6, 5, 3): 2}
    S = spark.createDataFrame([("f", 0, *p, l) for p, l in seeds.items()], "field_id string, t int, x int, y int, z int, label int")
    got = {(r.x, r.y, r.z): r.level for r in costmap.flood(V, S, 5.0).collect()}
    level, heap = {}, [(-v[p], p) for p in seeds if v[p] >= 5]
    heapq.heapify(heap)
    while heap:
        l, p = heapq.heappop(heap)
        if p in level:
            continue
        level[p] = -l
        for q in face(p, v.shape):
            if q not in level and v[q] >= 5:
                heapq.heappush(heap, (max(l, -v[q]), q))
    assert got == level


def test_exact_matching_is_optimal(spark):
    rng = np.random.default_rng(19)
    a = pd.DataFrame({"g": 0, "id": range(5), "x": rng.random(5), "y": rng.random(5), "z": 0.0})
    b = pd.DataFrame({"g": 0, "id": range(5), "x": rng.random(5), "y": rng.random(5), "z": 0.0})
    A, B = spark.createDataFrame(a), spark.createDataFrame(b)
    got = matching.exact_matching(A, B, 5.0).toPandas()
    c = ((a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2)
    best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert len(got) == 5 and math.isclose((got.dist**2).sum(), best, rel_tol=1e-9)
    greedy = tracking.greedy_pairs(spatial.near_pairs(A, B, 5.0)).toPandas()
    assert (greedy.dist**2).sum() >= best - 1e-12


def test_rigid_fit_recovers_a_motion(spark):
    rng = np.random.default_rng(23)
    q = rng.random((6, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    p = q @ r.T + [1.0, -2.0, 0.5]
    make = lambda m: spark.createDataFrame(pd.DataFrame({"g": 0, "id": range(6), "x": m[:, 0], "y": m[:, 1], "z": m[:, 2]}))
    pairs = spark.createDataFrame([(0, i, i, 0.0) for i in range(6)], "g bigint, l_id bigint, r_id bigint, dist double")
    moved = matching.transform(make(q), matching.rigid_fit(pairs, make(p), make(q))).orderBy("id").toPandas()
    assert np.allclose(moved[["x", "y", "z"]].to_numpy(), p)


def test_skeleton_of_a_bar_with_an_arm(spark):
    vox = {(x, y, z) for x in range(24) for y in range(3) for z in range(3)} | {(12, y, z) for y in range(3, 16) for z in range(3)}
    V = spark.createDataFrame([("f", 0, *p, 1.0) for p in vox], "field_id string, t int, x int, y int, z int, value double")
    root = spark.createDataFrame([("f", 0, 0, 1, 1)], "field_id string, t int, x int, y int, z int")
    rows = costmap.skeleton(V, root).toPandas()
    assert rows.branch.nunique() == 2
    assert rows[rows.branch == 0].y.max() >= 14 and rows[rows.branch == 1].x.max() >= 22


def test_augmentations_are_cheapest_at_every_size():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        cost, some = rng.random((n, m)), rng.random((n, m)) < 0.6
        if not some.any():
            continue
        i, j = np.nonzero(some)
        left, right = np.unique(i, return_inverse=True)[1], np.unique(j, return_inverse=True)[1]
        got = dict(enumerate(np.cumsum([a for a, _ in matching._augmentations(left, right, cost[i, j])]), 1))
        pairs, best = list(zip(i.tolist(), j.tolist())), {}
        for k in range(1, min(n, m) + 1):
            for s in itertools.combinations(pairs, k):
                if len({x for x, _ in s}) == k == len({y for _, y in s}):
                    best[k] = min(best.get(k, np.inf), sum(cost[p] for p in s))
        assert best.keys() == got.keys() and all(abs(best[k] - got[k]) < 1e-9 for k in best)


def test_exact_matching_of_many_connected_points(spark):
    """700 points in one connected part: a chain in which every point must move on by one place."""
    n = 700
    left = spark.createDataFrame([(0, i, 1.0 * i, 0.0, 0.0) for i in range(n)], "g bigint, id bigint, x double, y double, z double")
    right = spark.createDataFrame([(0, i, i + 0.4, 0.0, 0.0) for i in range(n)], "g bigint, id bigint, x double, y double, z double")
    got = matching.exact_matching(left, right, 0.7).toPandas()
    assert len(got) == n and (got.l_id == got.r_id).all()


def test_overlap_below_one_half_maps_each_label_once(spark):
    """Two labels that become one, and one that becomes two: the larger overlap stays, ties go to the lower label."""
    before = [1] * 6 + [2] * 5 + [3] * 8 + [4] * 4 + [5] * 4
    after = [7] * 11 + [8] * 4 + [9] * 4 + [6] * 8
    rows = [(0, t, x, 0, 0, label) for t, line in enumerate((before, after)) for x, label in enumerate(line)]
    labels = spark.createDataFrame(rows, "field_id bigint, t int, x int, y int, z int, label bigint")
    got = {tuple(r) for r in fields.overlap_mapping(labels, 0.4).select("t", "a", "b", "overlap").collect()}
    assert got == {(0, 1, 7, 6), (0, 3, 8, 4), (0, 4, 6, 4)}
