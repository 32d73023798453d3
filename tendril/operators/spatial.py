"""Distance joins on points: pairs, counts, existence and nearest neighbour.

Points are packed along a space-filling curve into leaf tiles of ``FAN`` points, tiles into
parents of ``FAN`` tiles, and so on; every tile keeps its bounding box and point count. A
join walks down the tile tree of the right side for each leaf tile of the left side:

* a right tile whose nearest corner is out of reach is dropped,
* a right tile that lies wholly within reach counts at once, without listing its points,
* only the rest is opened.

Tiles hold at most ``FAN`` members by construction, so a third of all points in one place
(or on one spot) gives more tiles, never a larger one. No step lists all pairs of a cell.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.operators.skew import ranked
from tendril.session import materialize

FAN = 64
AXES = ("x", "y", "z")
_BITS = 16
#: Intervals of an axis with about as many points each; inside one a cell is its linear share.
_CUTS = 64


def _cell(axis: str, cuts: list[float]) -> str:
    """Place of a coordinate: its interval between the cuts, found by halving, and its share of that interval.

    One far point stretches the interval it lies in and leaves the order of all others as it is.
    """
    fine = (1 << _BITS) // _CUTS - 1

    def among(lo: int, hi: int) -> str:
        if hi - lo == 1:
            low, span = cuts[lo], cuts[hi] - cuts[lo]
            return f"({lo}L * {fine + 1}L + cast(greatest(0D, least(1D, ({axis} - {low!r}D) / {span!r}D)) * {fine} as bigint))"
        mid = (lo + hi) // 2
        return f"(CASE WHEN {axis} < {cuts[mid]!r}D THEN {among(lo, mid)} ELSE {among(mid, hi)} END)"

    return among(0, len(cuts) - 1) if len(cuts) > 1 else "0L"


def _curve_code(cuts: dict[str, list[float]]) -> tuple[Column, Column]:
    """(``_cells``, position on a z-order curve): the bits of the places on the axes, interleaved."""
    cells = F.expr("named_struct(" + ", ".join(f"'{a}', {_cell(a, cuts[a])}" for a in AXES) + ")")
    bits = " | ".join(f"shiftleft(shiftright(_cells.{a}, i) & 1L, 3 * i + {k})" for k, a in enumerate(AXES))
    return cells, F.expr(f"aggregate(sequence(0, {_BITS - 1}), 0L, (acc, i) -> acc | {bits})")


class TileTree:
    """A packed tile tree over ``points(g, id, x, y, z)``; ``g`` is the matching group."""

    def __init__(self, points: DataFrame, prefix: str):
        self.prefix = prefix
        src = points.select("g", "id", *[F.col(a).cast("double").alias(a) for a in AXES])
        shares = [k / _CUTS for k in range(_CUTS + 1)]
        found = src.agg(*[F.percentile_approx(a, shares, 10_000).alias(a) for a in AXES]).first()
        cells, code = _curve_code({a: sorted(set(found[a] or [])) for a in AXES})
        coded = src.withColumn("_cells", cells).withColumn("_code", code).drop("_cells")
        self.points = ranked(coded, [F.col("g"), F.col("_code"), F.col("id")], "_rank").select(
            "g", "id", *AXES, F.floor(F.col("_rank") / FAN).cast("bigint").alias("tile")
        )
        self._levels: list[DataFrame] = []

    def leaves(self) -> DataFrame:
        return self.level(0)

    def level(self, k: int) -> DataFrame:
        """Tiles of level k: ``g, tile, parent, n`` and the box."""
        while len(self._levels) <= k:
            if not self._levels:
                src = self.points.select("g", "tile", F.lit(1).alias("n"), *[F.col(a).alias(f"l{a}") for a in AXES], *[F.col(a).alias(f"h{a}") for a in AXES])
            else:
                src = self._levels[-1].withColumn("tile", F.col("parent"))
            tiles = src.groupBy("g", "tile").agg(
                F.sum("n").cast("bigint").alias("n"),
                *[F.min(f"l{a}").alias(f"l{a}") for a in AXES],
                *[F.max(f"h{a}").alias(f"h{a}") for a in AXES],
            )
            tiles = tiles.withColumn("parent", F.floor(F.col("tile") / FAN).cast("bigint"))
            if not self._levels:
                tiles = materialize(tiles, "tiles")
            self._levels.append(tiles)
        return self._levels[k]

    def height(self) -> int:
        """Levels needed until every group has at most two top tiles or so."""
        largest = self.leaves().groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        return max(0, math.ceil(math.log(largest, FAN)))


def _gap(a: str, b: str) -> Column:
    """Squared distance between two boxes (0 when they touch)."""
    total = F.lit(0.0)
    for ax in AXES:
        d = F.greatest(F.lit(0.0), F.col(f"{a}l{ax}") - F.col(f"{b}h{ax}"), F.col(f"{b}l{ax}") - F.col(f"{a}h{ax}"))
        total = total + d * d
    return total


def _reach(a: str, b: str) -> Column:
    """Squared distance between the farthest corners of two boxes."""
    total = F.lit(0.0)
    for ax in AXES:
        d = F.greatest(F.col(f"{a}h{ax}") - F.col(f"{b}l{ax}"), F.col(f"{b}h{ax}") - F.col(f"{a}l{ax}"))
        total = total + d * d
    return total


def _boxed(tiles: DataFrame, p: str, extra: list[str]) -> DataFrame:
    return tiles.select(
        F.col("g"), *[F.col(c).alias(f"{p}{c}") for c in extra], *[F.col(f"{s}{a}").alias(f"{p}{s}{a}") for s in "lh" for a in AXES]
    )


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Join against a right side that is ``FAN**k`` times smaller than the points: spread all keys."""
    if salts <= 1:
        return left.join(right, keys)
    l = left.withColumn("_salt", F.pmod(F.xxhash64("a_tile"), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_salt"]).drop("_salt")


_LBOX = [f"a_{s}{a}" for s in "lh" for a in AXES]
_RBOX = [f"b_{s}{a}" for s in "lh" for a in AXES]


def _descend(left: TileTree, right: TileTree, limit: float | None, counting: bool, nearest: bool):
    """Leaf tile pairs that must be compared point by point, and tiles counted whole.

    For ``nearest`` the pairs carry ``gap`` and ``far``, the least and largest squared distance of their boxes.
    """
    lt = _boxed(left.leaves(), "a_", ["tile"])
    height = right.height()
    whole: DataFrame | None = None
    front: DataFrame | None = None
    found = ["_gap", "_far", "_bound"] if nearest else []
    for k in range(height, -1, -1):
        rt = _boxed(right.level(k), "b_", ["tile", "parent", "n"])
        salts = min(64, FAN**k)  # upper levels are tiny, so copying them is cheap
        if front is None:
            pairs = _salted(lt, rt, ["g"], salts).withColumn("_bound", F.lit(float("inf")))
        else:
            pairs = _salted(front, rt, ["g", "b_parent"], salts)
        if limit is not None:
            pairs = pairs.filter(_gap("a_", "b_") < limit * limit)
        if nearest:
            # Every tile is non-empty: the nearest point is no farther than the nearest tile's far corner. The bound
            # of the level above drops most tiles before they are shuffled.
            pairs = pairs.withColumn("_gap", _gap("a_", "b_")).withColumn("_far", _reach("a_", "b_")).filter("_gap <= _bound")
            pairs = pairs.withColumn("_bound", F.min("_far").over(Window.partitionBy("g", "a_tile"))).filter("_gap <= _bound")
        if counting:
            # Both branches below read this level, so it is written once instead of being joined twice.
            pairs = materialize(pairs.withColumn("_inside", _reach("a_", "b_") < limit * limit), "level")
            inside = F.col("_inside")
            got = pairs.filter(inside).select("g", "a_tile", "b_n")
            whole = got if whole is None else whole.unionByName(got)
            pairs = pairs.filter(~inside)
        front = pairs.select("g", "a_tile", *_LBOX, F.col("b_tile").alias("b_parent"), *found[-1:], *(found[:-1] if k == 0 else []))
    return front.select("g", "a_tile", F.col("b_parent").alias("b_tile"), *[F.col(c).alias(c[1:]) for c in found[:-1]]), whole


def _point_pairs(front: DataFrame, left: TileTree, right: TileTree) -> DataFrame:
    a = left.points.select("g", F.col("tile").alias("a_tile"), F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in AXES])
    b = right.points.select("g", F.col("tile").alias("b_tile"), F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in AXES])
    d2 = F.lit(0.0)
    for c in AXES:
        d = F.col(f"l_{c}") - F.col(f"r_{c}")
        d2 = d2 + d * d
    return front.join(a, ["g", "a_tile"]).join(b, ["g", "b_tile"]).withColumn("d2", d2)


def _trees(left: DataFrame, right: DataFrame) -> tuple[TileTree, TileTree]:
    return TileTree(left, "l"), TileTree(right, "r")


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs ``(g, l_id, r_id, dist)`` of one group closer than ``radius``.

    The output is the caller's own pair list; use ``near_counts``, ``near_exists`` or
    ``nearest`` where a count, a flag or the best partner is enough.
    """
    a, b = _trees(left, right)
    front, _ = _descend(a, b, radius, counting=False, nearest=False)
    return (
        _point_pairs(front, a, b)
        .filter(F.col("d2") < radius * radius)
        .select("g", "l_id", "r_id", F.sqrt("d2").alias("dist"))
    )


def near_counts(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(g, id, n)`` for every left point: right points of its group closer than ``radius``."""
    return _counts(*_trees(left, right), radius)


def _counts(a: TileTree, b: TileTree, radius: float) -> DataFrame:
    front, whole = _descend(a, b, radius, counting=True, nearest=False)
    tested = (
        _point_pairs(front, a, b)
        .filter(F.col("d2") < radius * radius)
        .groupBy("g", F.col("l_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_tile = whole.groupBy("g", "a_tile").agg(F.sum("b_n").alias("n"))
    inside = a.points.select("g", "id", F.col("tile").alias("a_tile")).join(by_tile, ["g", "a_tile"]).select("g", "id", "n")
    none = a.points.select("g", "id", F.lit(0).cast("bigint").alias("n"))
    return none.unionByName(tested).unionByName(inside).groupBy("g", "id").agg(F.sum("n").cast("bigint").alias("n"))


def near_exists(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(g, id)`` of left points with some right point of their group closer than ``radius``."""
    return near_counts(left, right, radius).filter(F.col("n") > 0).select("g", "id")


def _packed(tree: TileTree, side: str) -> DataFrame:
    """One row per leaf tile with its points in order of id, ``FAN`` at most: ``(g, <side>_tile, <side>_points)``."""
    point = F.struct("id", *AXES)
    return tree.points.groupBy("g", F.col("tile").alias(f"{side}_tile")).agg(F.array_sort(F.collect_list(point)).alias(f"{side}_points"))


def _nearest_in_tiles(front: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``(g, a_tile, l_id, m)``: for each left point and tile pair the closest right point ``m(d2, r_id)``."""

    @F.pandas_udf("d2 array<double>, at array<int>")
    def closest(ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series) -> pd.DataFrame:
        found = []
        for lx, ly, lz, rx, ry, rz in zip(ax, ay, az, bx, by, bz):
            d2 = (lx[:, None] - rx) ** 2
            d2 += (ly[:, None] - ry) ** 2
            d2 += (lz[:, None] - rz) ** 2
            at = d2.argmin(1)  # the first of equal ones has the lowest id
            found.append((d2[range(len(at)), at], at))
        return pd.DataFrame(found, columns=["d2", "at"])

    # Tile pairs are few bytes and much work, so their number of tasks does not follow the bytes.
    tasks = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = front.select("g", "a_tile", "b_tile").join(a, ["g", "a_tile"]).join(b, ["g", "b_tile"]).repartition(tasks, "a_tile", "b_tile")
    axes = [F.col(f"{s}_points.{c}") for s in "ab" for c in AXES]
    met = pairs.select("g", "a_tile", F.col("a_points.id").alias("l"), F.col("b_points.id").alias("r"), closest(*axes).alias("c"))
    each = met.select("g", "a_tile", F.explode(F.arrays_zip("l", F.col("c.d2").alias("d2"), F.transform("c.at", lambda i: F.get("r", i)).alias("r_id"))).alias("p"))
    return each.select("g", "a_tile", F.col("p.l").alias("l_id"), F.struct("p.d2", "p.r_id").alias("m"))


def nearest(left: DataFrame, right: DataFrame, radius: float | None = None) -> DataFrame:
    """``(g, l_id, r_id, dist)``: the closest right point; the lowest id wins ties.

    With ``radius`` only partners strictly closer than it count. The most promising right tile of a left tile is
    compared first; after that only tiles count that lie no farther than the worst of its points still has to look.
    No step lists pairs of points: tiles meet as one row each. A point without a finite position takes no part.
    """
    placed = " AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('infinity')" for c in AXES)
    a, b = _trees(left.filter(placed), right.filter(placed))
    front = materialize(_descend(a, b, radius, counting=False, nearest=True)[0], "front")
    a, b = materialize(_packed(a, "a"), "packed"), materialize(_packed(b, "b"), "packed")
    promising = front.groupBy("g", "a_tile").agg(F.min(F.struct("far", "b_tile")).alias("_p"))
    first = promising.select("g", "a_tile", "_p.b_tile")
    bound = _nearest_in_tiles(first, a, b).groupBy("g", "a_tile").agg(F.max("m.d2").alias("_worst"))
    best = _nearest_in_tiles(front.join(bound, ["g", "a_tile"]).filter("gap <= _worst"), a, b).groupBy("g", "l_id").agg(F.min("m").alias("_m"))
    if radius is not None:
        best = best.filter(F.col("_m.d2") < radius * radius)
    return best.select("g", "l_id", F.col("_m.r_id").alias("r_id"), F.sqrt("_m.d2").alias("dist"))


def unique_partners(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs in which either side is the other's only partner within ``radius``.

    Counting comes first; only points with exactly one partner are then listed, so at most
    one pair per point is ever produced.
    """
    a, b = _trees(left, right)
    one_l = _counts(a, b, radius).filter(F.col("n") == 1).select("g", "id")
    one_r = _counts(b, a, radius).filter(F.col("n") == 1).select("g", "id")
    return near_pairs(left.join(one_l, ["g", "id"], "left_semi"), right.join(one_r, ["g", "id"], "left_semi"), radius)


def step_sides(points: DataFrame, group: list[str], t: str = "t") -> tuple[DataFrame, DataFrame]:
    """The two sides of a join between consecutive steps: ends at t, starts at t + 1."""
    cols = ["id", *AXES]
    ends = points.select(F.struct(*group, F.col(t).cast("int").alias("t")).alias("g"), *cols)
    starts = points.select(F.struct(*group, (F.col(t) - 1).cast("int").alias("t")).alias("g"), *cols)
    return ends, starts
