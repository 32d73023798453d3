"""Operators on voxel fields in sparse form: ``voxels(field_id, t, x, y, z, value|label)``.

Background (label 0) has no rows. Neighbours are found by equality joins on shifted
positions, which spread evenly however large one label or one column of voxels is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import geometry as G
from tendril.operators import graph, spatial
from tendril.session import materialize

POS = ["x", "y", "z"]

# Neighbour offsets of the supported lattices.
FACE = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
FULL = [(i, j, k) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
# One diagonal direction per cell: the 14 edges of the usual split of a cube into simplices.
SIMPLICIAL = [o for o in FULL if min(o) >= 0 or max(o) <= 0]
OFFSETS = {6: FACE, 14: SIMPLICIAL, 26: FULL}


def neighbours_of(voxels: DataFrame, kind: int, keep: list[str], prefix: str = "n_", dims: DataFrame | None = None) -> DataFrame:
    """Every voxel once per neighbour position (``n_x, n_y, n_z``), inside the lattice if
    ``dims(field_id, nx, ny, nz)`` is given. That is one row per field and goes to every task:
    a shuffle by field would put a whole field into one."""
    offs = F.array(*[F.struct(*[F.lit(o[i]).alias(c) for i, c in enumerate(POS)]) for o in OFFSETS[kind]])
    out = voxels.withColumn("_o", F.explode(offs)).select(
        *keep, *[(F.col(c) + F.col(f"_o.{c}")).alias(f"{prefix}{c}") for c in POS]
    )
    if dims is not None:
        out = out.join(F.broadcast(dims.select("field_id", "nx", "ny", "nz")), "field_id")
        for c in POS:
            out = out.filter((F.col(f"{prefix}{c}") >= 0) & (F.col(f"{prefix}{c}") < F.col(f"n{c}")))
        out = out.drop("nx", "ny", "nz")
    return out


def volumes(labels: DataFrame) -> DataFrame:
    """``(field_id, t, label, volume)`` in voxels, background left out."""
    return labels.filter("label <> 0").groupBy("field_id", "t", "label").agg(F.count(F.lit(1)).alias("volume"))


def contingency(labels: DataFrame) -> DataFrame:
    """``(field_id, t, a, b, overlap)`` of each step with the next; 0 stands for background."""
    a = labels.filter("label <> 0").select("field_id", "t", *POS, F.col("label").alias("a"))
    b = labels.filter("label <> 0").select("field_id", (F.col("t") - 1).alias("t"), *POS, F.col("label").alias("b"))
    last = labels.agg(F.max("t")).scalar()
    first = labels.agg(F.min("t")).scalar()
    return (
        a.join(b, ["field_id", "t", *POS], "full")
        .filter((F.col("t") >= first) & (F.col("t") < last))
        .groupBy("field_id", "t", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
        .agg(F.count(F.lit(1)).alias("overlap"))
    )


def overlap_mapping(labels: DataFrame, fraction: float = vocab.OVERLAP_FRACTION) -> DataFrame:
    """``(field_id, t, a, b, overlap)`` where the overlap exceeds the fraction of both volumes.

    Below one half several successors could map; the largest overlap, then the lowest label
    wins, first for each predecessor and then, among those, for each successor.
    """
    pairs = contingency(labels).filter("a <> 0 AND b <> 0")
    vol = volumes(labels)
    va = vol.select("field_id", "t", F.col("label").alias("a"), F.col("volume").alias("va"))
    vb = vol.select("field_id", (F.col("t") - 1).alias("t"), F.col("label").alias("b"), F.col("volume").alias("vb"))
    out = (
        pairs.join(va, ["field_id", "t", "a"]).join(vb, ["field_id", "t", "b"])
        .filter((F.col("overlap") > fraction * F.col("va")) & (F.col("overlap") > fraction * F.col("vb")))
        .select("field_id", "t", "a", "b", "overlap")
    )
    if fraction < 0.5:
        best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("b"))).alias("m")
        out = out.groupBy("field_id", "t", "a").agg(best).select("field_id", "t", "a", "m.b", (-F.col("m.o")).alias("overlap"))
        best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("a"))).alias("m")
        out = out.groupBy("field_id", "t", "b").agg(best).select("field_id", "t", "m.a", "b", (-F.col("m.o")).alias("overlap"))
    return out


def relabel(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced through ``mapping(field_id, t, label, new_label)``; unmapped become 0
    and so disappear. Spark broadcasts the mapping when its size allows."""
    return (
        labels.join(mapping, ["field_id", "t", "label"])
        .select("field_id", "t", *POS, F.col("new_label").alias("label"))
        .filter("label <> 0")
    )


def track_labels(labels: DataFrame, fraction: float = vocab.OVERLAP_FRACTION) -> DataFrame:
    """``(field_id, t, label, new_label)``: labels linked over time share a new number.

    Numbers follow the least (t, label) of each chain; labels in no link are not mapped.
    """
    links = overlap_mapping(labels, fraction)
    node = lambda t, c: F.struct("field_id", t.cast("int").alias("t"), F.col(c).cast("int").alias("label"))
    comp = materialize(
        graph.components(links.select(node(F.col("t"), "a").alias("p"), node(F.col("t") + 1, "b").alias("q")), "p", "q"), "chains"
    )
    from tendril.operators.statistics import dense_ids

    heads = dense_ids(
        comp.select("component").distinct().select("component.field_id", F.struct("component.t", "component.label").alias("head")), ["field_id"], "head", "k"
    )
    return comp.select("id.field_id", "id.t", "id.label", F.struct("component.t", "component.label").alias("head")).join(
        heads, ["field_id", "head"]
    ).select("field_id", "t", "label", (F.col("k") + 1).cast("int").alias("new_label"))


def label_centres(labels: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``(field_id, t, label, x, y, z, depth)``: the voxel of each label farthest from outside.

    The nearest outside voxel always touches the label, so only touching positions are
    searched. A voxel with a free neighbour along an axis of the least spacing cannot be
    nearer to the outside, so only the others look for it. Ties go to the lowest x-fastest position.
    """
    keys = ["field_id", "t", "label"]
    lab = labels.filter("label <> 0").select(*keys, *POS)
    least = min(voxel)
    close = [c for c, s in zip(POS, voxel) if s == least]
    side = "CASE " + " ".join(f"WHEN n_{c} < {c} THEN {1 << 2 * k} WHEN n_{c} > {c} THEN {2 << 2 * k}" for k, c in enumerate(close)) + " ELSE 0 END"
    closed = (1 << 2 * len(close)) - 1
    # Every voxel and its neighbours' places together: a place without a voxel of its own is outside.
    around = neighbours_of(lab, 6, [*keys, *POS]).select(*keys, *[F.col(f"n_{c}").alias(c) for c in POS], F.lit(0).alias("own"), F.expr(side).alias("near"))
    places = lab.select(*keys, *POS, F.lit(1).alias("own"), F.lit(0).alias("near")).unionByName(around)
    places = materialize(places.groupBy(*keys, *POS).agg(F.max("own").alias("own"), F.bit_or("near").alias("near")), "places")
    inner = places.filter((F.col("own") == 1) & (F.col("near") == closed))
    outside = places.filter("own = 0").join(inner.select(*keys).distinct(), keys, "left_semi")
    g = F.struct(*keys).alias("g")
    scaled = [(F.col(c) * float(s)).alias(c) for c, s in zip(POS, voxel)]
    order = F.struct("z", "y", "x").alias("id")
    rim = places.filter((F.col("own") == 1) & (F.col("near") != closed)).select(g, order.alias("l_id"), F.lit(float(least)).alias("dist"))
    depth = rim.unionByName(spatial.nearest(inner.select(g, order, *scaled), outside.select(g, order, *scaled)).select("g", "l_id", "dist"))
    best = depth.groupBy("g").agg(F.min(F.struct((-F.col("dist")).alias("d"), F.col("l_id").alias("p"))).alias("m"))
    return best.select("g.field_id", "g.t", "g.label", "m.p.x", "m.p.y", "m.p.z", (-F.col("m.d")).alias("depth"))


def region_maxima(voxels: DataFrame, keys: list[str], value: str = "value", interior: Column | None = None) -> DataFrame:
    """All positions holding the largest value of their region, ties included.

    Values not above the smallest positive float never win; ``interior`` may exclude lattice
    borders. The maximum is a partial aggregate and meets the voxels on (region, value), so a
    huge region is not gathered anywhere.
    """
    rows = voxels.filter(F.col(value) > 1.17549435e-38)
    if interior is not None:
        rows = rows.filter(interior)
    top = rows.groupBy(*keys).agg(F.max(value).alias(value))
    return rows.join(top, [*keys, value])


def bounding_box(voxels: DataFrame, keys: list[str], dims: dict[str, Column | int] | None = None, margin: int = 0) -> DataFrame:
    """Box of values above 0 per key, padded by ``margin`` and kept inside the lattice."""
    box = voxels.filter("value > 0").groupBy(*keys).agg(
        *[F.min(c).alias(f"lo_{c}") for c in POS], *[F.max(c).alias(f"hi_{c}") for c in POS]
    )
    for c in POS:
        box = box.withColumn(f"lo_{c}", F.greatest(F.lit(0), F.col(f"lo_{c}") - margin).cast("int"))
        hi = F.col(f"hi_{c}") + margin
        if dims is not None:
            hi = F.least(G._c(dims[c]) - 1, hi)
        box = box.withColumn(f"hi_{c}", hi.cast("int"))
    return box


def crop_box(roots: DataFrame, offset: tuple[int, int, int], size: tuple[int, int, int], dims: tuple[int, int, int]) -> DataFrame:
    """Boxes at ``offset`` from root voxels, kept inside the lattice."""
    out = roots
    for c, o, s, n in zip(POS, offset, size, dims):
        out = out.withColumn(f"lo_{c}", F.greatest(F.lit(0), F.col(c) + o).cast("int"))
        out = out.withColumn(f"hi_{c}", F.least(F.lit(n - 1), F.col(c) + o + s - 1).cast("int"))
    return out


def crop(voxels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels inside the box of their key. Boxes are one row per key."""
    inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in POS])
    extra = [c for c in boxes.columns if c not in voxels.columns]
    return voxels.join(boxes.select(*keys, *extra), keys).filter(inside)


def split_labels(labels: DataFrame, wanted: DataFrame, image: DataFrame | None = None) -> DataFrame:
    """One field per wanted label: ``part`` names it. With ``image`` its values replace the
    labels (the image masked by each label)."""
    out = labels.join(wanted.select("field_id", "t", "label").distinct(), ["field_id", "t", "label"]).withColumn("part", F.col("label"))
    if image is not None:
        out = out.join(image.select("field_id", "t", *POS, "value"), ["field_id", "t", *POS])
    return out


def labels_at(seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels under seed points given in voxel units; seeds outside or on background drop out."""
    at = seeds.select("field_id", "t", "seed", *[F.floor(c).cast("int").alias(c) for c in POS])
    return at.join(labels.filter("label <> 0"), ["field_id", "t", *POS]).select("field_id", "t", "seed", "label")


def split_channels(voxels: DataFrame, channels: int, nz: int) -> DataFrame:
    """Interleaved slices separated: ``channel`` and the new z. ``nz`` must be a multiple."""
    if nz % channels:
        raise ValueError("number of slices is not a multiple of the number of channels")
    return voxels.withColumn("channel", G.slice_channel("z", F.lit(channels))).withColumn("z", F.floor(F.col("z") / channels).cast("int"))


def correct_labels(labels: DataFrame, image: DataFrame, rounds: int = 1) -> DataFrame:
    """Removes axial smear from label fields.

    A label voxel with background on exactly one z side is dropped when its z neighbour on
    the object side is brighter. All voxels of a round are judged on the same input.
    ``image`` must cover the label voxels.
    """
    key = ["field_id", "t", *POS]
    cur = labels.filter("label >= 1").select(*key, "label").join(image.select(*key, "value"), key)
    for _ in range(rounds):
        if rounds > 1:
            cur = materialize(cur, "labels")
        above = cur.select("field_id", "t", "x", "y", (F.col("z") + 1).alias("z"), F.col("value").alias("_up"))
        below = cur.select("field_id", "t", "x", "y", (F.col("z") - 1).alias("z"), F.col("value").alias("_down"))
        both = cur.join(above, key, "left").join(below, key, "left")
        top = F.col("_up").isNull() & F.col("_down").isNotNull() & (F.col("_down") > F.col("value"))
        bottom = F.col("_down").isNull() & F.col("_up").isNotNull() & (F.col("_up") > F.col("value"))
        cur = both.filter(~F.coalesce(top | bottom, F.lit(False))).select(*key, "label", "value")
    return cur.drop("value")


def rescale_to_byte(voxels: DataFrame) -> DataFrame:
    """Values mapped to 0..255 when any lies outside; otherwise unchanged."""
    lo, hi = voxels.agg(F.min("value")).scalar(), voxels.agg(F.max("value")).scalar()
    factor = F.when(hi == lo, 1.0).otherwise(255.0 / F.nullif(hi - lo, F.lit(0.0)))
    return voxels.withColumn("value", F.when((lo < 0) | (hi > 255), (F.col("value") - lo) * factor).otherwise(F.col("value")))


def histogram(voxels: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``(keys, bin, n)`` over the global value range; the top value falls in the last bin."""
    lo, hi = voxels.agg(F.min("value")).scalar(), voxels.agg(F.max("value")).scalar()
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / width)).cast("int")
    return voxels.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def majority_label(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent label per key; the lowest label wins ties."""
    n = votes.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("label"), F.col("b.n").alias("n"))


def correlate(template: DataFrame, image: DataFrame, keys: list[str], search: tuple[int, int, int]) -> DataFrame:
    """Normalised cross-correlation of a template at every shift within ``search``.

    ``template`` and ``image`` carry positions relative to the template centre. Each image
    voxel meets the template voxels it would cover, by equality on the shifted position;
    only sums travel. NULL where either side is constant.
    """
    shifts = template
    for c, r in zip(POS, search):
        shifts = shifts.withColumn(f"s_{c}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    moved = shifts.select(*keys, "s_x", "s_y", "s_z", *[(F.col(c) + F.col(f"s_{c}")).cast("int").alias(c) for c in POS], F.col("value").alias("_t"))
    both = moved.join(image.select(*keys, *POS, F.col("value").alias("_i")), [*keys, *POS])
    t, i = F.col("_t"), F.col("_i")
    sums = both.groupBy(*keys, "s_x", "s_y", "s_z").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(t).alias("st"), F.sum(i).alias("si"),
        F.sum(t * t).alias("tt"), F.sum(i * i).alias("ii"), F.sum(t * i).alias("ti"),
        F.max(F.when((F.col("x") == F.col("s_x")) & (F.col("y") == F.col("s_y")) & (F.col("z") == F.col("s_z")), i)).alias("grey"),
    )
    vt, vi = F.col("tt") - F.col("st") * F.col("st") / F.col("n"), F.col("ii") - F.col("si") * F.col("si") / F.col("n")
    cov = F.col("ti") - F.col("st") * F.col("si") / F.col("n")
    ok = (F.col("n") > 1) & (vt > 1e-9) & (vi > 1e-9)
    return sums.select(*keys, "s_x", "s_y", "s_z", F.col("n").cast("bigint").alias("n"), "grey", F.when(ok, cov / F.sqrt(F.when(ok, vt * vi))).alias("corr"))


def best_shift(scores: DataFrame, reference: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The best shift per key among candidates of similar brightness.

    The grey value must lie strictly between 0.75 and 1.25 of the template centre's
    (``reference.grey0``); the highest correlation above ``threshold`` wins, of equals the one
    farther from the centre, then the lowest shift.
    """
    d2 = F.col("s_x") * F.col("s_x") + F.col("s_y") * F.col("s_y") + F.col("s_z") * F.col("s_z")
    ok = scores.join(reference.select(*keys, "grey0"), keys).filter(
        (F.col("grey") > 0.75 * F.col("grey0")) & (F.col("grey") < 1.25 * F.col("grey0")) & (F.col("corr") > threshold)
    )
    pick = F.max(F.struct("corr", d2.alias("d2"), (-F.col("s_z")).alias("z"), (-F.col("s_y")).alias("y"), (-F.col("s_x")).alias("x"))).alias("m")
    return ok.groupBy(*keys).agg(pick).select(
        *keys, (-F.col("m.x")).alias("s_x"), (-F.col("m.y")).alias("s_y"), (-F.col("m.z")).alias("s_z"), F.col("m.corr").alias("corr")
    )


def deconvolve(image: DataFrame, kernel: DataFrame, rounds: int = 10, step: float = 1.0) -> DataFrame:
    """Projected Landweber iterations: ``f <- max(0, f + step * K'(g - K f))``.

    ``kernel(dx, dy, dz, w)`` is a parameter and goes to every task as one value, normalised to sum 1; a
    convolution hands each voxel's weighted value to its neighbours and sums there.
    """
    key = ["field_id", "t", *POS]
    total = kernel.agg(F.sum("w")).scalar()
    shape = kernel.agg(F.collect_list(F.struct("dx", "dy", "dz", "w"))).scalar()

    def blur(f: DataFrame, value: str, sign: int) -> DataFrame:
        moved = f.select(*key, value, F.explode(shape).alias("k")).select(
            "field_id", "t", *[(F.col(c) + sign * F.col(f"k.d{c}")).cast("int").alias(c) for c in POS], (F.col(value) * F.col("k.w") / total).alias("_b")
        )
        return moved.groupBy(*key).agg(F.sum("_b").alias("_b"))

    g = image.select(*key, F.col("value").cast("double").alias("g"))
    est = g.withColumn("f", F.col("g"))
    for _ in range(rounds):
        est = materialize(est, "estimate")
        residual = est.join(blur(est, "f", 1), key, "left").withColumn("r", F.col("g") - F.coalesce("_b", F.lit(0.0)))
        back = blur(residual, "r", -1)
        est = est.join(back, key, "left").select(*key, "g", F.greatest(F.lit(0.0), F.col("f") + step * F.coalesce("_b", F.lit(0.0))).alias("f"))
    return est.select(*key, F.col("f").alias("value"))


#: Edge of the blocks of voxels that points are sampled in.
CELL = 4


def sample_trilinear(points: DataFrame, voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Field values at fractional positions: the eight corners of a point, weighted and summed;
    positions without data count as 0. ``points`` needs a unique ``id``.

    Voxels are gathered in blocks of ``CELL**3`` with the upper faces of the next ones, at most
    ``(CELL + 1)**3`` positions, and each point meets the one block that has all its corners. So a
    point travels once, and a voxel twice on average, instead of eight corners twice each.
    """
    cell = [f"_b{c}" for c in POS]
    near = voxels.select(*keys, *POS, "value").filter(F.col("value").isNotNull())
    for c, b in zip(POS, cell):
        own = F.floor(F.col(c) / CELL).cast("int")
        near = near.withColumn(b, F.explode(F.when(F.pmod(F.col(c), F.lit(CELL)) == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    blocks = near.groupBy(*keys, *cell).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in POS], F.col("value").cast("double").alias("value"))).alias("_near"))
    at = points.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in POS], *[F.floor(F.floor(c) / CELL).cast("int").alias(b) for c, b in zip(POS, cell)])

    def part(v):
        """What a voxel gives to the point: nothing unless it is one of the eight corners."""
        weight, corner = F.lit(1.0), F.lit(True)
        for c in POS:
            frac, off = F.col(c) - F.floor(c), v[c] - F.floor(c)
            weight = weight * F.when(off == 1, frac).otherwise(1 - frac)
            corner = corner & off.isin(0, 1)
        return F.when(corner, weight * v["value"]).otherwise(0.0)

    total = F.aggregate("_near", F.lit(0.0), lambda acc, v: acc + part(v))
    got = at.join(blocks, [*keys, *cell], "left")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return got.select(*keys, "id", F.when(known, F.coalesce(total, F.lit(0.0))).alias("value"))
