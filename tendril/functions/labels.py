"""Label names, ids and metadata carried in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendril import vocab
from tendril.functions.geometry import _c

# Naming patterns of the files, tried in this order.
OBJECT_TIME_PATTERNS = (
    (r"_gc([0-9]{1,3})_t([0-9]{1,3})\.am", 1, 2),
    (r"GrowthCone([0-9])_([0-9]{1,2})", 1, 2),
    (r"_([0-9]{1,2})_GrowthCone([0-9])", 2, 1),
    (r"_gc([0-9]{1,3})\.am", 1, None),
)
TIME_PATTERNS = (r"_t([0-9]{1,3})\.am", r"_t([0-9]{1,3})", r"_T([0-9]{1,3})\.am")


def time_label(t) -> Column:
    return F.format_string("T_%03d", _c(t).cast("int"))


def parse_time_label(name) -> Column:
    """Step of a time label; NULL unless it is ``T_`` and exactly three digits."""
    digits = F.regexp_extract(_c(name), r"^T_([0-9]{3})$", 1)
    return F.when(digits != "", digits.cast("int"))


def _numbered(prefix: str, pattern: str, label_id) -> Column:
    i = _c(label_id).cast("int")
    return (
        F.when(i == vocab.UNASSIGNED_ID, "UNASSIGNED")
        .when(i == vocab.IGNORED_ID, "IGNORED")
        .when(i == vocab.AXON_ID, "AXON")
        .when(i >= vocab.FIRST_OBJECT_ID, F.format_string(prefix + pattern, i - 3))
    )


def object_label(label_id) -> Column:
    return _numbered("F_", "%04d", label_id)


def match_label(label_id) -> Column:
    return _numbered("M_", "%04d", label_id)


def object_id_from_label(name) -> Column:
    n = _c(name)
    digits = F.regexp_extract(n, r"^[FM]_([0-9]{4,})$", 1)
    return (
        F.when(n == "UNASSIGNED", vocab.UNASSIGNED_ID)
        .when(n == "IGNORED", vocab.IGNORED_ID)
        .when(n == "AXON", vocab.AXON_ID)
        .when(digits != "", digits.cast("int") + 3)
    )


def core_label(number) -> Column:
    return F.format_string("GC_%03d", _c(number).cast("int"))


def is_real_object(label_id, max_id=None) -> Column:
    """An id that names a tracked object rather than a reserved label."""
    i = _c(label_id)
    ok = (i > 0) & ~i.isin(list(vocab.RESERVED_IDS.values()))
    return ok if max_id is None else ok & (i <= _c(max_id))


def migrate_label(name) -> Column:
    """Old label names mapped to the current vocabulary."""
    n = _c(name)
    out = F.when(F.lit(False), n)
    for old, new in vocab.LABEL_MIGRATIONS.items():
        out = out.when(n == old, new)
    return out.otherwise(F.regexp_replace(n, r"^Object_([0-9]{3})$", "GC_$1"))


def _checked(path: Column, pattern: str) -> Column:
    """TRUE on a single hit, FALSE on none, an error on several."""
    hits = F.regexp_count(path, F.lit(pattern))
    return F.when(hits > 1, F.raise_error(F.concat(F.lit("several time marks in "), path)).cast("boolean")).otherwise(
        hits == 1
    )


def object_and_time(path) -> Column:
    """``STRUCT<obj, t>`` from a file name; the first pattern that hits wins, none is an error."""
    p = _c(path)
    out = None
    for pattern, obj_at, time_at in OBJECT_TIME_PATTERNS:
        value = F.struct(
            F.regexp_extract(p, pattern, obj_at).cast("int").alias("obj"),
            (F.regexp_extract(p, pattern, time_at).cast("int") if time_at else F.lit(None).cast("int")).alias("t"),
        )
        hit = _checked(p, pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no object and time in "), p)).cast("struct<obj:int,t:int>"))


def time_only(path) -> Column:
    p = _c(path)
    out = None
    for pattern in TIME_PATTERNS:
        value = F.regexp_extract(p, pattern, 1).cast("int")
        hit = _checked(p, pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no time in "), p)).cast("int"))


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def output_name(path, folder) -> Column:
    """Target file: known suffixes dropped, ``.am`` appended."""
    stem = F.regexp_replace(base_name(path), r"\.(tif|hoc|am)", "")
    return F.concat(_c(folder), F.lit("/"), stem, F.lit(".am"))
