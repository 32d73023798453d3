"""Label dictionaries: rows ``(graph_id, grp, label_id, parent_id, name)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions import labels as L
from tendril.operators.skew import ranked
from tendril.session import materialize


def create_group(graphs: DataFrame, grp: str, members: tuple[str, ...] = ()) -> DataFrame:
    """A fresh group with its mandatory members for every graph; ids start at 1 under root 0."""
    members = members or vocab.MANDATORY_GROUPS.get(grp, ())
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("label_id"), F.lit(m).alias("name")) for i, m in enumerate(members)]))
    return graphs.select("graph_id").distinct().withColumn("_m", rows).select(
        "graph_id", F.lit(grp).alias("grp"), "_m.label_id", F.lit(0).alias("parent_id"), "_m.name"
    )


def names_of(elements: DataFrame, labels: DataFrame, grp: str, id_col: str, name_col: str) -> DataFrame:
    """Label names for an id column. Spark broadcasts the dictionary when its size allows."""
    dim = labels.filter(F.col("grp") == grp).select("graph_id", F.col("label_id").alias(id_col), F.col("name").alias(name_col))
    return elements.join(dim, ["graph_id", id_col], "left")


def ids_of(elements: DataFrame, labels: DataFrame, grp: str, name_col: str, id_col: str) -> DataFrame:
    dim = labels.filter(F.col("grp") == grp).select("graph_id", F.col("name").alias(name_col), F.col("label_id").alias(id_col))
    return elements.join(dim, ["graph_id", name_col], "left")


def member_counts(labels: DataFrame) -> DataFrame:
    return labels.filter("parent_id = 0").groupBy("graph_id", "grp").agg(F.count(F.lit(1)).alias("n"))


def rename(labels: DataFrame, grp: str, old: str, new: str) -> DataFrame:
    hit = (F.col("grp") == grp) & (F.col("name") == old)
    return labels.withColumn("name", F.when(hit, new).otherwise(F.col("name")))


def remove(labels: DataFrame, gone: DataFrame) -> DataFrame:
    return labels.join(gone.select("graph_id", "grp", "label_id"), ["graph_id", "grp", "label_id"], "left_anti")


def first_unused(used: DataFrame, reserved: int = vocab.AXON_ID) -> DataFrame:
    """``(graph_id, next_id)``: the least free id above the reserved ones.

    An id is the start of a gap when the next one is not used; the least such end plus one is
    the answer. This needs one self join on (graph, id), no list of all possible ids.
    """
    ids = used.select("graph_id", "id").filter(F.col("id") > reserved).distinct()
    seeded = ids.unionByName(used.select("graph_id").distinct().withColumn("id", F.lit(reserved).cast(ids.schema["id"].dataType)))
    follows = ids.select("graph_id", (F.col("id") - 1).alias("id"))
    return seeded.join(follows, ["graph_id", "id"], "left_anti").groupBy("graph_id").agg((F.min("id") + 1).alias("next_id"))


def compaction(used: DataFrame, reserved: int = vocab.AXON_ID) -> DataFrame:
    """``(graph_id, old_id, new_id)`` moving the highest used ids into the lowest empty ones.

    With n used ids above the reserved ones, the compact range is reserved+1 .. reserved+n.
    Ids above the range, from the top, pair with the holes inside it, from the bottom.
    """
    ids = materialize(used.select("graph_id", F.col("id").cast("bigint").alias("id")).filter(F.col("id") > reserved).distinct(), "ids")
    n = ids.groupBy("graph_id").agg((F.count(F.lit(1)) + reserved).alias("top"))
    high = ids.join(n, "graph_id").filter(F.col("id") > F.col("top")).select("graph_id", "id")
    # Slots come from ids by position, so that no graph's slot list is built in one row.
    pos = ranked(ids, [F.col("graph_id"), F.col("id")], "_r")
    first = pos.groupBy("graph_id").agg(F.min("_r").alias("_f"))
    slots = pos.join(first, "graph_id").select("graph_id", (F.col("_r") - F.col("_f") + reserved + 1).alias("id"))
    holes = slots.join(ids, ["graph_id", "id"], "left_anti")

    def numbered(df: DataFrame, order, name: str) -> DataFrame:
        r = ranked(df, [F.col("graph_id"), order], "_r")
        f = r.groupBy("graph_id").agg(F.min("_r").alias("_f"))
        return r.join(f, "graph_id").select("graph_id", (F.col("_r") - F.col("_f")).alias("k"), F.col("id").alias(name))

    return numbered(high, F.col("id").desc(), "old_id").join(numbered(holes, F.col("id"), "new_id"), ["graph_id", "k"]).select(
        "graph_id", "old_id", "new_id"
    )


def apply_mapping(elements: DataFrame, mapping: DataFrame, id_col: str = "object_id") -> DataFrame:
    m = mapping.select("graph_id", F.col("old_id").cast("int").alias(id_col), F.col("new_id").cast("int").alias("_new"))
    kind = elements.schema[id_col].dataType
    return elements.join(m, ["graph_id", id_col], "left").withColumn(id_col, F.coalesce("_new", id_col).cast(kind)).drop("_new").select(*elements.columns)


def next_match_name(labels: DataFrame) -> DataFrame:
    """``(graph_id, name)`` of the next manual match label."""
    top = labels.filter(F.col("grp") == "ManualNodeMatch").groupBy("graph_id").agg((F.max("label_id") + 1).alias("id"))
    return top.select("graph_id", L.match_label("id").alias("name"))
