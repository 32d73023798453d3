"""Centres appended as the next time step.

Each micro-batch becomes one step. The step number comes from the batch number, and a batch
writes its own partition, so a batch replayed after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_step(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch form: ``existing`` plus ``batch`` stamped with the step after the last one."""
    nxt = existing.agg(F.coalesce(F.max("t") + 1, F.lit(0))).scalar()
    return existing.unionByName(batch.withColumn("t", nxt.cast("int")).select(*existing.columns))


def append_steps(centres: DataFrame, path: str, checkpoint: str, first_step: int = 0) -> StreamingQuery:
    """The streaming form: writes ``path/t=<step>`` per micro-batch until the source is drained."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/t={first_step + number}")

    return centres.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
