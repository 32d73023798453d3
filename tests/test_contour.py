"""Contour trees against the sequential merge of join and split tree."""

import random

import pytest

from tendril.operators import contour as C

# The 18-node mesh of the fixtures, values and neighbours.
VALUES = [10, 9, 8.3, 8, 7.2, 7, 6.9, 6.5, 6.1, 6, 5, 4.9, 4.6, 4, 3, 2.1, 2, 1]
NEAR = {
    0: [10, 2, 13], 1: [10, 7, 14, 15, 17], 2: [0, 4, 8], 3: [17, 15, 14, 6, 9], 4: [2, 8, 10], 5: [9, 13], 6: [11, 14, 3, 9], 7: [1, 10, 14],
    8: [4, 2, 13], 9: [3, 6, 11, 16, 13, 5], 10: [0, 4, 13, 12, 16, 14, 7, 1], 11: [16, 9, 6, 14], 12: [16, 10, 13], 13: [0, 8, 10, 12, 16, 9, 5],
    14: [16, 11, 6, 3, 15, 1, 7, 10], 15: [1, 14, 3, 17], 16: [10, 12, 13, 9, 11, 14], 17: [1, 15, 3],
}


def sweep(order, near):
    """Tree pointers: a node joins the pieces of its neighbours that came before; each piece's last node points at it."""
    piece, last, pointer = {}, {}, {}
    for v in order:
        for p in {piece[n] for n in near[v] if n in piece}:
            pointer[last[p]] = v
            for n in [n for n in piece if piece[n] == p]:
                piece[n] = v
        piece[v], last[v] = v, v
    return pointer


def slow_arcs(values, near):
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    down, up = sweep(order[::-1], near), sweep(order, near)
    left, arcs = set(order), set()

    def cut(tree, v):
        for n in [n for n in tree if tree[n] == v]:
            if v in tree:
                tree[n] = tree[v]
            else:
                del tree[n]
        tree.pop(v, None)

    while True:
        for v in order:
            above, below = (sum(t == v for t in tree.values()) for tree in (down, up))
            if v in left and above + below == 1:
                arcs.add((down[v], v) if not above else (v, up[v]))
                cut(down, v)
                cut(up, v)
                left.remove(v)
                break
        else:
            return arcs, order


def slow_components(arcs, order):
    above = {v: [h for lo, h in arcs if lo == v] for v in order}
    done, out = set(), dict.fromkeys(order)

    def find(v):
        seen = []
        while len(above[v]) == 1:
            if v in done:
                return
            done.add(v)
            seen.append(v)
            v = above[v][0]
        if above[v]:
            for h in above[v]:
                find(h)
        else:
            out.update(dict.fromkeys([*seen, v], v))

    for v in order:
        if v not in done:
            find(v)
    return out


def compare(spark, fields):
    nodes = spark.createDataFrame([("f", t, i, float(x)) for t, (values, _) in enumerate(fields) for i, x in enumerate(values)], "field_id string, t int, idx int, value double")
    links = spark.createDataFrame([("f", t, i, n) for t, (_, near) in enumerate(fields) for i, ns in near.items() for n in ns] or [("f", 0, 0, 0)], "field_id string, t int, idx int, nbr int")
    known, edges = C.numbered(nodes, links)
    name = {(r.t, r.node): r.idx for r in known.collect()}
    arcs = C.contour_arcs(known, edges)
    points, contracted = C.critical_tree(known, arcs)
    parts = C.components(known, arcs)
    got = {t: set() for t in range(len(fields))}
    for r in arcs.collect():
        got[r.t].add((name[r.t, r.lo], name[r.t, r.hi]))
    comp = {(r.t, name[r.t, r.node]): name.get((r.t, r.component)) for r in parts.collect()}
    kinds = {(r.t, name[r.t, r.node]): r.kind for r in points.collect()}
    short = [(r.t, name[r.t, r.lo], name[r.t, r.hi]) for r in contracted.collect()]
    for t, (values, near) in enumerate(fields):
        want, order = slow_arcs(values, near)
        assert got[t] == want
        assert {v: comp[t, v] for v in order} == slow_components(want, order)
        degree = {v: (sum(lo == v for lo, _ in want), sum(h == v for _, h in want)) for v in order}
        regular = [v for v in order if degree[v] == (1, 1)]
        assert {v for s, v in kinds if s == t} == set(order) - set(regular)
        assert all(kinds[t, v] == ("saddle" if max(degree[v]) > 1 else "maximum" if not degree[v][0] else "minimum") for v in order if v not in regular)
        assert sum(s == t for s, _, _ in short) == len(want) - len(regular)
        assert all(kinds.get((t, v)) for s, lo, hi in short if s == t for v in (lo, hi))
    return got


def test_contour_tree_of_the_mesh(spark):
    got = compare(spark, [(VALUES, NEAR)])
    assert len(got[0]) == 17


def test_contour_trees_of_random_fields(spark):
    """Triangulated grids with ties, a path that goes up and down, two pieces, a star and a single node."""
    rng = random.Random(6)
    fields = []
    for size in (4, 5):
        near = {}
        for i in range(size * size):
            around = [(i // size + dy, i % size + dx) for dy, dx in ((0, 1), (1, 0), (1, 1), (0, -1), (-1, 0), (-1, -1))]
            near[i] = [y * size + x for y, x in around if 0 <= y < size and 0 <= x < size]
        fields.append(([rng.randrange(9) for _ in range(size * size)], near))
    path = [5, 1, 7, 2, 9, 0, 8, 3, 6, 4]
    fields.append((path, {i: [j for j in (i - 1, i + 1) if 0 <= j < 10] for i in range(10)}))
    fields.append((path, {i: [j for j in (i - 1, i + 1) if 0 <= j < 10 and {i, j} != {4, 5}] for i in range(10)}))
    fields.append(([3, 1, 2, 4, 5, 6], {0: [1, 2, 3, 4, 5], **{i: [0] for i in range(1, 6)}}))
    fields.append(([1], {0: []}))
    compare(spark, fields)


def test_skeleton_of_an_empty_field(spark):
    from tendril.operators import costmap

    voxels = spark.createDataFrame([("f", 0, 1, 1, 1, 0.0)], "field_id string, t int, x int, y int, z int, value double")
    out = costmap.skeleton(voxels, voxels.select("field_id", "t", "x", "y", "z"))
    assert out.columns == ["field_id", "t", "branch", "ord", "x", "y", "z"] and out.collect() == []
