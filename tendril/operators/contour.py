"""Contour trees: join and split tree of a mesh put together, with critical points and components.

Nodes are numbered by their order of value, so both trees see the same order, ties included. A tree is one pointer per
node: to the next lower node in the join tree, to the next higher one in the split tree. The two are merged in
rounds. A round takes off every leaf with the whole chain of regular nodes behind it, on the upper side and then on
the lower one, and closes the gap that this leaves in the other tree; chains and gaps are walked by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.operators.costmap import KEY, follow
from tendril.operators.fields import POS, neighbours_of
from tendril.operators.skew import ranked
from tendril.operators.topology import basins, merge_pairs, saddles
from tendril.session import materialize


def lattice_mesh(voxels: DataFrame, connectivity: int = 14) -> tuple[DataFrame, DataFrame]:
    """``nodes(keys, idx, value)`` and ``links(keys, idx, nbr)`` of a voxel field; ``idx`` holds the position."""
    me = voxels.select(*KEY, *POS, "value")
    near = neighbours_of(me, connectivity, [*KEY, *POS])
    there = me.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in POS])
    idx, nbr = F.struct("z", "y", "x").alias("idx"), F.struct(*[F.col(f"n_{c}").alias(c) for c in ("z", "y", "x")]).alias("nbr")
    links = near.join(there, [*KEY, "n_x", "n_y", "n_z"], "left_semi").select(*KEY, idx, nbr)
    return me.select(*KEY, idx, "value"), links


def numbered(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(keys, idx, value, node)`` with nodes counted in order of value, then ``idx``; and ``edges(keys, hi, lo)`` of them."""
    order = [F.col(c) for c in (*KEY, "value", "idx")]
    found = materialize(ranked(nodes.select(*KEY, "idx", "value"), order, "node"), "nodes")
    a = found.select(*KEY, "idx", F.col("node").alias("_a"))
    b = found.select(*KEY, F.col("idx").alias("nbr"), F.col("node").alias("_b"))
    pairs = links.join(a, [*KEY, "idx"]).join(b, [*KEY, "nbr"]).filter("_a <> _b")
    return found, materialize(pairs.select(*KEY, F.greatest("_a", "_b").alias("hi"), F.least("_a", "_b").alias("lo")).distinct(), "edges")


def owners(tops: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(keys, node, branch)``: the highest node of the piece of the mesh at or above each node that holds it.

    A node leaves a basin's branch where it lies at or below the saddle at which that branch ends. Tables of 1, 2,
    4, ... such steps with the lowest saddle on the way are built first; each node then takes the longest steps
    whose saddles all lie at or above it.
    """
    jump = pairs.select(*KEY, F.col("top").alias("branch"), F.col("into").alias("to"), F.col("saddle").alias("least"))
    jumps = [materialize(jump, "jump")]
    while True:
        last = jumps[-1]
        second = last.select(*KEY, F.col("branch").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        longer = last.join(second, [*KEY, "to"]).select(*KEY, "branch", F.col("_to").alias("to"), F.least("least", "_least").alias("least"))
        longer = materialize(longer, "jump")
        if longer.isEmpty():
            break
        jumps.append(longer)
    at = tops.select(*KEY, "node", F.col("top").alias("branch"))
    for jump in reversed(jumps):
        ahead = at.join(jump, [*KEY, "branch"], "left")
        at = ahead.select(*KEY, "node", F.when(F.col("least") >= F.col("node"), F.col("to")).otherwise(F.col("branch")).alias("branch"))
    return materialize(at, "owners")


def merge_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(keys, node, next)``: every node of the join tree with the next lower one, null at the lowest of a piece.

    Along a branch that is the next lower node of the branch, and behind its last node the saddle.
    """
    tops = materialize(basins(nodes.select(*KEY, "node"), edges), "basins")
    pairs = materialize(merge_pairs(materialize(saddles(edges, tops), "saddles")), "pairs")
    own = owners(tops, pairs).join(pairs.select(*KEY, F.col("top").alias("branch"), "saddle"), [*KEY, "branch"], "left")
    placed = materialize(ranked(own, [F.col("branch"), F.col("node").desc()], "at"), "placed")
    below = placed.select((F.col("at") - 1).alias("at"), F.col("branch").alias("_branch"), F.col("node").alias("_node"))
    found = placed.join(below, "at", "left")
    return found.select(*KEY, "node", F.when(F.col("_branch") == F.col("branch"), F.col("_node")).otherwise(F.col("saddle")).alias("next"))


def _roots(pointers: DataFrame) -> DataFrame:
    """Pointers of the nodes at which a chain ends without a leaf."""
    ends = pointers.filter("next <> node").select(*KEY, F.col("next").alias("node")).distinct()
    return pointers.filter("next = node AND NOT leaf").join(ends, [*KEY, "node"], "left_semi").select(*KEY, "node", "next")


def _peel(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One side of a round on ``(keys, node, down, up)``: the arcs ``(keys, lo, hi)`` taken off at the top, and what is left."""
    above = trees.filter("down is not null").groupBy(*KEY, F.col("down").alias("node")).agg(F.count(F.lit(1)).alias("n_above"), F.min("node").alias("parent"))
    below = trees.filter("up is not null").groupBy(*KEY, F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_below"))
    known = trees.join(above, [*KEY, "node"], "left").join(below, [*KEY, "node"], "left").na.fill(0, ["n_above", "n_below"])
    leaf, regular = F.expr("n_above = 0 AND n_below = 1"), F.expr("n_above = 1 AND n_below = 1")
    pointers = materialize(known.select(*KEY, "node", F.when(regular, F.col("parent")).otherwise(F.col("node")).alias("next"), leaf.alias("leaf")), "pointers")
    leaves = pointers.filter("leaf").select(*KEY, F.col("node").alias("end"))
    off = materialize(follow(pointers.filter("leaf OR next <> node").select(*KEY, "node", "next").unionByName(_roots(pointers)), KEY).join(leaves, [*KEY, "end"], "left_semi").select(*KEY, "node").join(trees, [*KEY, "node"]), "off")
    arcs = off.filter("down is not null").select(*KEY, F.col("down").alias("lo"), F.col("node").alias("hi"))
    # Gaps in the other tree: whoever pointed at a node that is off goes on to the first one that is not.
    gone = off.select(*KEY, F.col("node").alias("up"), F.lit(True).alias("_off"))
    chain = off.select(*KEY, "node", "up").join(gone, [*KEY, "up"], "left")
    ends = follow(materialize(chain.select(*KEY, "node", F.when(F.col("_off"), F.col("up")).otherwise(F.col("node")).alias("next")), "gaps"), KEY)
    beyond = ends.join(off.select(*KEY, F.col("node").alias("end"), F.col("up").alias("_up")), [*KEY, "end"]).select(*KEY, F.col("node").alias("up"), "_up", F.lit(True).alias("_off"))
    left = trees.join(off.select(*KEY, "node"), [*KEY, "node"], "left_anti").join(beyond, [*KEY, "up"], "left")
    return arcs, materialize(left.select(*KEY, "node", "down", F.when(F.col("_off"), F.col("_up")).otherwise(F.col("up")).alias("up")), "trees")


def contour_arcs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(keys, lo, hi)``: arcs of the contour tree over all nodes; both tables as ``numbered`` gives them.

    Each piece of the mesh gives a tree of its own; a node without neighbours has no arc. A mesh with holes is an error where the
    two trees have no merge.
    """
    turned = edges.select(*KEY, (-F.col("lo")).alias("hi"), (-F.col("hi")).alias("lo"))
    join = merge_tree(nodes, edges).select(*KEY, "node", F.col("next").alias("down"))
    split = merge_tree(nodes.select(*KEY, (-F.col("node")).alias("node")), turned).select(*KEY, (-F.col("node")).alias("node"), (-F.col("next")).alias("up"))
    trees = materialize(join.join(split, [*KEY, "node"]), "trees")
    parts = []
    swap = lambda df: df.select(*KEY, "node", F.col("up").alias("down"), F.col("down").alias("up"))
    open_ = trees.filter("down is not null or up is not null").count()
    while open_:
        arcs, trees = _peel(trees)
        parts.append(arcs)
        arcs, turned_trees = _peel(swap(trees))
        parts.append(arcs.select(*KEY, F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        trees = swap(turned_trees)
        before, open_ = open_, trees.filter("down is not null or up is not null").count()
        if open_ == before:
            raise ValueError("no leaf is left: the mesh has holes, so its two trees have no merge")
    out = edges.select(*KEY, "lo", "hi").limit(0)
    for part in parts:
        out = out.unionByName(part)
    return materialize(out, "arcs")


def _degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(keys, node, n_up, n_down, above, below)``; the last two are the neighbours where there is one on that side."""
    up = arcs.groupBy(*KEY, F.col("lo").alias("node")).agg(F.count(F.lit(1)).alias("n_up"), F.min("hi").alias("above"))
    down = arcs.groupBy(*KEY, F.col("hi").alias("node")).agg(F.count(F.lit(1)).alias("n_down"), F.min("lo").alias("below"))
    found = nodes.select(*KEY, "node").join(up, [*KEY, "node"], "left").join(down, [*KEY, "node"], "left")
    return materialize(found.na.fill(0, ["n_up", "n_down"]), "degrees")


def critical_tree(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(keys, node, kind, n_up, n_down)`` of maxima, minima and saddles, and the arcs ``(keys, lo, hi)`` between them.

    A saddle has several neighbours on one side. A node alone is a maximum.
    """
    known = _degrees(nodes, arcs)
    kind = F.when((F.col("n_up") > 1) | (F.col("n_down") > 1), "saddle").when(F.col("n_up") == 0, "maximum").when(F.col("n_down") == 0, "minimum")
    points = known.select(*KEY, "node", kind.alias("kind"), "n_up", "n_down").filter("kind is not null")
    climb = known.select(*KEY, "node", F.when((F.col("n_up") == 1) & (F.col("n_down") == 1), F.col("above")).otherwise(F.col("node")).alias("next"))
    tops = follow(materialize(climb, "climb"), KEY).select(*KEY, F.col("node").alias("hi"), F.col("end").alias("top"))
    starts = arcs.join(points.select(*KEY, F.col("node").alias("lo")), [*KEY, "lo"], "left_semi")
    return points, materialize(starts.join(tops, [*KEY, "hi"]).select(*KEY, "lo", F.col("top").alias("hi")), "contracted")


def components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(keys, node, component)``: nodes from which the way up leads to a maximum without a choice carry that maximum.

    Where several ways meet below one maximum, the one counts that comes from the lowest minimum; nodes of the others and
    nodes below a fork have none.
    """
    known = _degrees(nodes, arcs)
    points, edges = critical_tree(nodes, arcs)
    # The lowest node from which a critical point is reached by going up only, handed on while it falls.
    least = materialize(points.select(*KEY, "node", F.col("node").alias("least")), "least")
    front = least
    while True:
        offer = front.join(edges.withColumnRenamed("lo", "node"), [*KEY, "node"]).groupBy(*KEY, F.col("hi").alias("node")).agg(F.min("least").alias("_offer"))
        front = materialize(offer.join(least, [*KEY, "node"]).filter(F.col("_offer") < F.col("least")).select(*KEY, "node", F.col("_offer").alias("least")), "front")
        if front.isEmpty():
            break
        least = materialize(least.join(front.withColumnRenamed("least", "_new"), [*KEY, "node"], "left").select(*KEY, "node", F.coalesce("_new", "least").alias("least")), "least")
    drop = known.select(*KEY, "node", F.when((F.col("n_up") == 1) & (F.col("n_down") == 1), F.col("below")).otherwise(F.col("node")).alias("next"))
    origin = follow(materialize(drop, "drop"), KEY).select(*KEY, "node", F.col("end").alias("_foot")).join(least.select(*KEY, F.col("node").alias("_foot"), F.col("least")), [*KEY, "_foot"])
    # The last node before the way up ends or forks; ways that meet before it compete, those that meet at a maximum do not.
    over = known.select(*KEY, F.col("node").alias("above"), F.col("n_up").alias("_over"))
    steps = materialize(known.join(over, [*KEY, "above"], "left").select(*KEY, "node", "n_up", "above", "_over", F.when((F.col("n_up") == 1) & (F.col("_over") == 1), F.col("above")).otherwise(F.col("node")).alias("next")), "climb")
    reached = origin.select(*KEY, "node", "least")
    last = steps.join(reached, [*KEY, "node"]).select(*KEY, F.col("node").alias("end"), F.when(F.col("n_up") == 0, F.col("node")).when((F.col("n_up") == 1) & (F.col("_over") == 0), F.col("above")).alias("_top"), F.col("least").alias("_best"))
    found = follow(steps.select(*KEY, "node", "next"), KEY).join(last, [*KEY, "end"]).join(reached, [*KEY, "node"])
    return found.select(*KEY, "node", F.when(F.col("least") == F.col("_best"), F.col("_top")).alias("component"))
