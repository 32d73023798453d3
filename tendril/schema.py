"""Canonical tables and their checks.

Every element lives in a graph (``graph_id``) at an integer time step ``t``. Polylines are
kept in long form (``points``), one row per point, so an edge of any length is split over
tasks like everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril import vocab

VERTICES = (
    "graph_id string, v bigint, x double, y double, z double, t int, gc int, node_type string,"
    " location string, object_id int, match_id int, manual string, bulbous string"
)
EDGES = (
    "graph_id string, e bigint, src bigint, dst bigint, t int, gc int, location string,"
    " object_id int, manual string, bulbous string"
)
POINTS = "graph_id string, e bigint, ord int, x double, y double, z double"
LABELS = "graph_id string, grp string, label_id int, parent_id int, name string"
FIELDS = (
    "field_id string, t int, nx int, ny int, nz int, x0 double, y0 double, z0 double,"
    " dx double, dy double, dz double, dtype string"
)
VOXELS = "field_id string, t int, x int, y int, z int, value double"

# Storage type for each lattice type.
LATTICE_TYPES = {
    "int8": "byte", "uint8": "short", "int16": "short", "uint16": "int", "int32": "int",
    "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float": "float",
    "double": "double", "string": "string",
}


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Attributes two tables share in name and type, in the order of the first."""
    other = dict(b.dtypes)
    return [n for n, kind in a.dtypes if other.get(n) == kind]


def merge_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union that drops attributes the two tables do not share."""
    cols = common_columns(a, b)
    return a.select(*cols).unionByName(b.select(*cols))


def missing_labels(labels: DataFrame, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(graph_id, grp, name)`` of mandatory groups and members a graph lacks; empty means valid."""
    groups = vocab.MANDATORY_GROUPS if groups is None else groups
    need = [(g, None) for g in groups] + [(g, m) for g, members in groups.items() for m in members]
    wanted = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(m).alias("name")) for g, m in need]))
    graphs = labels.select("graph_id").distinct().withColumn("_w", wanted).select("graph_id", "_w.grp", "_w.name")
    have = labels.select("graph_id", "grp", "name").unionByName(
        labels.select("graph_id", "grp", F.lit(None).cast("string").alias("name"))
    ).distinct()
    a, b = graphs.alias("a"), have.alias("b")
    same = (
        (F.col("a.graph_id") == F.col("b.graph_id"))
        & (F.col("a.grp") == F.col("b.grp"))
        & F.coalesce(F.col("a.name"), F.lit("")).eqNullSafe(F.coalesce(F.col("b.name"), F.lit("")))
    )
    return a.join(b, same, "left_anti")


def is_root_graph(labels: DataFrame) -> DataFrame:
    """Missing parts of the smaller schema of root-node graphs."""
    return missing_labels(labels, {g: vocab.MANDATORY_GROUPS[g] for g in vocab.ROOT_GRAPH_GROUPS})
