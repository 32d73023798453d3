"""Length, life-time and growth statistics of tracked objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import geometry as G
from tendril.functions import labels as L
from tendril.functions import moments as M
from tendril.operators import graph
from tendril.operators.skew import ranked


def dense_ids(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """0-based number of each row within its group, by a parallel global sort.

    Unlike ``row_number`` over the group, no task sorts a whole group.
    """
    pos = ranked(df, [F.col(c) for c in (*group, order)], "_rank")
    first = pos.groupBy(*group).agg(F.min("_rank").alias("_first"))
    return pos.join(first, group).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def life_time(vertices: DataFrame, edges: DataFrame, id_col: str = "object_id") -> DataFrame:
    """``(graph_id, id, first_t, last_t, life)`` over all elements that carry the id."""
    both = vertices.select("graph_id", id_col, "t").unionByName(edges.select("graph_id", id_col, "t"))
    return both.groupBy("graph_id", id_col).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), (F.max("t") - F.min("t") + 1).alias("life")
    )


def match_life_time(vertices: DataFrame) -> DataFrame:
    """Life time per manual match id, from vertices alone."""
    return vertices.groupBy("graph_id", "match_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def time_range_from_labels(labels: DataFrame) -> DataFrame:
    """``(graph_id, min_t, max_t)`` of the time label dictionary, not of the data."""
    t = L.parse_time_label(F.col("name"))
    return labels.filter(F.col("grp") == "TimeStep").groupBy("graph_id").agg(F.min(t).alias("min_t"), F.max(t).alias("max_t"))


def root_of_step(vertices: DataFrame) -> DataFrame:
    """``(graph_id, t, root)``: the root vertex of a step, -1 unless there is exactly one."""
    return (
        vertices.filter(F.col("node_type") == vocab.ROOT)
        .groupBy("graph_id", "t")
        .agg(F.when(F.count(F.lit(1)) == 1, F.min("v")).otherwise(F.lit(-1)).cast("bigint").alias("root"))
    )


def filament_table(vertices: DataFrame, edges: DataFrame, points: DataFrame, oriented: DataFrame | None = None) -> DataFrame:
    """One row per base node: length, angle, bulbous flag and the number of branches and tips.

    In a tree whose paths carry one base, the filament of a base is everything that hangs on
    it, so the base carried along the orientation is the grouping key.
    """
    oriented = graph.orient(vertices, edges) if oriented is None else oriented
    nodes, lines = graph.location_labels(oriented, vertices, edges)
    inside = F.col("location") == vocab.FILAMENT_LOCATION
    lengths = (
        lines.filter(inside)
        .join(graph.edge_lengths(points), ["graph_id", "e"])
        .groupBy("graph_id", "base_v")
        .agg(F.sum("length").alias("total_length"))
    )
    kinds = (
        nodes.filter(inside)
        .join(vertices.select("graph_id", "v", "node_type"), ["graph_id", "v"])
        .groupBy("graph_id", "base_v")
        .agg(
            F.count_if(F.col("node_type") == vocab.BRANCH).alias("n_branch"),
            F.count_if(F.col("node_type") == vocab.TIP).alias("n_tips"),
        )
    )
    root_xy = vertices.filter(F.col("node_type") == vocab.ROOT).groupBy("graph_id", "t").agg(
        F.min_by(F.struct("x", "y"), "v").alias("root")
    )
    base = vertices.filter(F.col("node_type") == vocab.BASE).select(
        "graph_id", F.col("v").alias("base_v"), "t", "object_id", L.object_label("object_id").alias("object_name"),
        F.when(F.col("bulbous") == "BULBOUS", 1).otherwise(0).alias("bulbous"), "x", "y", "z",
    )
    out = (
        base.join(lengths, ["graph_id", "base_v"], "left")
        .join(kinds, ["graph_id", "base_v"], "left")
        .join(root_xy, ["graph_id", "t"], "left")
        .withColumn("total_length", F.coalesce("total_length", F.lit(0.0)))
        .withColumn("angle", G.compass_angle("root.x", "root.y", "x", "y"))
        .withColumn("n_branch", F.coalesce("n_branch", F.lit(0)).cast("bigint"))
        .withColumn("n_tips", F.coalesce("n_tips", F.lit(0)).cast("bigint"))
        .drop("root")
    )
    return dense_ids(out, ["graph_id"], "base_v", "filament_id")


def filament_tips(vertices: DataFrame, oriented: DataFrame) -> DataFrame:
    """Numbered tips per filament in long form: ``(graph_id, base_v, tip_no, v, x, y, z)``."""
    tips = vertices.filter(F.col("node_type") == vocab.TIP).select("graph_id", "v", "x", "y", "z")
    owned = tips.join(oriented.filter("base_count = 1").select("graph_id", "v", "base_v"), ["graph_id", "v"])
    return dense_ids(owned, ["graph_id", "base_v"], "v", "tip_no").withColumn("tip_no", F.col("tip_no") + 1)


def object_lengths(filaments: DataFrame) -> DataFrame:
    """``(graph_id, object_id, t, length)`` of tracked objects; of several bases in one step
    the last one counts."""
    return (
        filaments.filter(L.is_real_object("object_id"))
        .groupBy("graph_id", "object_id", "t")
        .agg(F.max_by("total_length", "base_v").alias("length"))
    )


def length_pivot(lengths: DataFrame, steps: list[int]) -> DataFrame:
    """One column ``length_t<NN>`` per time step."""
    return lengths.groupBy("graph_id", "object_id").agg(
        *[F.max(F.when(F.col("t") == s, F.col("length"))).alias(f"length_t{s:02d}") for s in steps]
    )


def length_table(filaments: DataFrame, life: DataFrame, steps: list[int]) -> DataFrame:
    """Per object: first and last step, angle at birth, its filaments and its length per step."""
    real = filaments.filter(L.is_real_object("object_id"))
    # An object has at most one filament per step, hence at most 1000 ids in the string.
    per = real.groupBy("graph_id", "object_id").agg(
        F.min_by("angle", F.struct("t", -F.col("base_v"))).alias("angle"),
        F.array_join(F.transform(F.array_sort(F.collect_list("filament_id")), lambda i: i.cast("string")), ", ").alias("filaments"),
    )
    return (
        per.join(life, ["graph_id", "object_id"])
        .join(length_pivot(object_lengths(filaments), steps), ["graph_id", "object_id"])
        .withColumn("object_name", L.object_label("object_id"))
    )


def speeds(lengths: DataFrame, keys: list[str], max_t: DataFrame, t: str = "t", value: str = "length") -> DataFrame:
    """Differences previous - next between consecutive lengths, with zero padding.

    A series not starting at step 0 grows from 0, one ending before the last step shrinks to
    0, so birth and death are events too. ``max_t`` is a one-value table. A series has one row
    per step and steps are bounded by the label format, so the window is bounded.
    """
    life = lengths.groupBy(*keys).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    zero = F.lit(0.0)
    born = life.filter(F.col("_first") != 0).select(*keys, (F.col("_first") - 1).alias(t), zero.alias(value))
    gone = life.filter(F.col("_last") < max_t.scalar()).select(*keys, (F.col("_last") + 1).alias(t), zero.alias(value))
    padded = lengths.select(*keys, t, value).unionByName(born).unionByName(gone)
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(t))
    return padded.withColumn("speed", before - F.col(value)).filter(F.col("speed").isNotNull()).select(*keys, t, "speed")


def speed_class(speed: str, threshold: float):
    """Events above the threshold: negative differences extend, others retract; rest is static."""
    s = F.col(speed)
    return F.when(F.abs(s) <= threshold, "static").when(s < 0, "extension").otherwise("retraction")


def speed_table(events: DataFrame, keys: list[str], threshold: float = vocab.SPEED_THRESHOLD) -> DataFrame:
    """Event counts, mean and deviation of speeds per object.

    ``retraction_std`` is about the retraction mean; ``retraction_std_compat`` is about the
    extension mean, as the published tables have it. Means of empty sets are NULL here.
    """
    s = F.col("speed")
    kept = F.abs(s) > threshold
    ext, ret = kept & (s < 0), kept & (s >= 0)
    a_ext, a_ret = F.when(ext, F.abs(s)), F.when(ret, F.abs(s))
    n, n_static = F.count("speed"), F.count_if(~kept)
    return events.groupBy(*keys).agg(
        n.alias("n_events"),
        F.avg(F.abs(s)).alias("speed_mean"),
        F.stddev_pop(F.abs(s)).alias("speed_std"),
        F.count_if(kept).alias("n_filtered"),
        F.avg(F.when(kept, F.abs(s))).alias("filtered_mean"),
        F.stddev_pop(F.when(kept, F.abs(s))).alias("filtered_std"),
        F.count_if(ext).alias("n_extensions"),
        F.avg(a_ext).alias("extension_mean"),
        F.stddev_pop(a_ext).alias("extension_std"),
        F.count_if(ret).alias("n_retractions"),
        F.avg(a_ret).alias("retraction_mean"),
        F.stddev_pop(a_ret).alias("retraction_std"),
        M.std_abs_about(a_ret, F.avg(a_ext)).alias("retraction_std_compat"),
        n_static.alias("n_static"),
        F.when(n > 0, n_static / n).otherwise(0.0).alias("static_share"),
    )


def object_table(filaments: DataFrame, life: DataFrame, max_t: DataFrame, threshold: float = vocab.SPEED_THRESHOLD) -> DataFrame:
    """Per object: bulbous steps, life time, length moments and the speed statistics."""
    keys = ["graph_id", "object_id"]
    lengths = object_lengths(filaments)
    bulb = (
        filaments.filter(L.is_real_object("object_id"))
        .groupBy(*keys, "t")
        .agg(F.min_by("bulbous", "base_v").alias("b"), F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.sum("b").alias("n_bulbous"), (F.max("n") > 1).alias("inconsistent"))
    )
    size = lengths.groupBy(*keys).agg(
        F.avg("length").alias("length_mean"), F.stddev_pop("length").alias("length_std"), F.max_by("length", "t").alias("final_length")
    )
    return (
        life.filter(L.is_real_object("object_id"))
        .join(bulb, keys)
        .join(size, keys)
        .join(speed_table(speeds(lengths, keys, max_t), keys, threshold), keys, "left")
        .withColumn("object_name", L.object_label("object_id"))
        .withColumn("bulbous_share", F.col("n_bulbous") / F.col("life"))
    )


def local_deviation(points: DataFrame, samples: DataFrame, radius: int, field: list[str]) -> DataFrame:
    """Sample deviation of field values in the cube of ``radius`` voxels around each point.

    Positions are integers and ``field`` names the columns that tell fields apart. Offsets are
    expanded on the point side and values meet by equality. Fewer than two samples is NULL.
    """
    probe = points
    for a in ("x", "y", "z"):
        probe = probe.withColumn(a, F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius)))
    keys = [c for c in points.columns if c not in ("x", "y", "z")]
    return probe.join(samples, [*field, "x", "y", "z"]).groupBy(*keys).agg(
        F.count("value").alias("n"), F.when(F.count("value") > 1, F.stddev_samp("value")).alias("deviation")
    )


def retrace_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Length changes of retraced edges: totals and mean absolute, signed and relative differences."""
    d = F.col("_after") - F.col("_before")
    return (
        before.select("graph_id", "e", F.col("length").alias("_before"))
        .join(after.select("graph_id", "e", F.col("length").alias("_after")), ["graph_id", "e"])
        .groupBy("graph_id")
        .agg(
            F.count(F.lit(1)).alias("n_edges"),
            F.sum("_before").alias("total_before"),
            F.sum("_after").alias("total_after"),
            F.avg(F.abs(d)).alias("mean_abs"),
            F.avg(d).alias("mean_signed"),
            F.avg(F.try_divide(F.abs(d), "_before")).alias("mean_relative"),
            F.avg(F.try_divide(d, "_before")).alias("mean_signed_relative"),
        )
    )
