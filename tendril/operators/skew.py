"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import materialize

HOT_SHARE = 1e-3
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = 100_000) -> DataFrame:
    """Keys that hold more than ``share`` of all rows (and more than ``floor`` rows).

    At most ``1 / share`` keys can do so, whatever the size of the data: the result is a
    proven-small table, safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1)).alias("_n"))
    return counts.filter((F.col("_n") > floor) & (F.col("_n") > total.scalar() * share)).select(*keys)


def skew_join(
    facts: DataFrame, dims: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Rows of hot keys are spread over ``salts`` buckets by a hash of the row; only the
    matching ``dims`` rows of those keys (at most ``1 / HOT_SHARE`` keys) are copied.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    hot = F.broadcast(hot_keys(facts, keys).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    left = facts.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dims.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based position in a global total order, without a single-task sort.

    A range shuffle sorts in parallel; the position is the row number inside a partition
    plus the sizes of the partitions before it. The sorted rows go to scratch first, so that
    both steps see the same partition bounds even when tasks are retried.
    """
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    stored = materialize(ordered, "ranked")
    part = F.shiftright(F.col("_id"), 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition: a window over it, and its broadcast, are bounded.
    before = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint"))
        .drop("_part", "_id", "_before")
    )
