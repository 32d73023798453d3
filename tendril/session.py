"""Session set-up and shared scratch storage for iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, tempfile.TemporaryDirectory] = {}
#: Files larger than this are not broadcast for their size on disk: packed voxels are a hundred times larger as rows.
PACKED = 256 << 10
UNPACKED = 10 << 20
#: Bytes of a batch of rows on their way to a Python worker.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, skew handling).

    Master, memory and the number of shuffle partitions are the submitter's, unless given here.
    """
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.appName("tendril")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def size_joins(spark: SparkSession) -> None:
    """Broadcast joins are planned from the size of files only for small files.

    All others are left to the adaptive execution, which has measured the rows it would send. A lower
    threshold of the submitter stays.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    if int(number) * _UNITS[unit] > PACKED:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", f"{min(int(number) * _UNITS[unit], UNPACKED)}b")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", f"{PACKED}b")


def size_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of at most BATCH bytes, not only of 10000 rows: a batch of long texts stands
    in the memory of the JVM and of the worker at the same time. A lower limit of the submitter stays.
    """
    limit = spark.conf.get(_BATCH, None) or "-1"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", limit.strip().lower()).groups()
    if not 0 < int(number) * _UNITS[unit] <= BATCH:
        spark.conf.set(_BATCH, f"{BATCH}b")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; a
    cluster without it is an error, because executors do not share local disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.TemporaryDirectory(prefix="tendril-", ignore_cleanup_errors=True)  # goes with the process
    return _LOCAL_SCRATCH[app].name


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written or collected inside go at its end.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new scratch table and read it back.

    Cuts the lineage of iterative plans in a way that outlives lost executors, and gives
    the next plan true sizes, so Spark picks broadcast or shuffle joins from facts. These tables
    stay until the run has ended, so they are packed well.
    """
    spark = df.sparkSession
    size_joins(spark)
    path = f"{scratch_root(spark)}/tendril/{tag}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
