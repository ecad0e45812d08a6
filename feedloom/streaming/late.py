"""The multiset state of late_events kept by a stream: every batch is a delta of counts, appended to a table.

The state is the sum of the deltas. A batch writes its own folder, named by its batch id, and overwrites it when it is
run again after a failure, so replays change nothing. compact() folds all deltas into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import late_events as le


def batch_writer(state_path: str, value: str, **ledger_args):
    """A function for foreachBatch. The stream must hold each key once (put sources.store.idempotent before it)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = le.multiset(le.ledger(batch, values=(value,), **ledger_args), value)
        delta.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return write


def read_state(spark: SparkSession, state_path: str, group: str = "project_id") -> DataFrame:
    deltas = spark.read.parquet(state_path).drop("batch")
    return deltas.groupBy(group, "day", "value").agg(F.sum("on_time").alias("on_time"), F.sum("corrections").alias("corrections"))


def compact(spark: SparkSession, state_path: str, to_path: str, group: str = "project_id") -> None:
    read_state(spark, state_path, group).write.mode("overwrite").parquet(f"{to_path}/batch=-1")
