"""A bounded outbox as a query: which events a client may keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bounded(events: DataFrame, max_events: int = 100, max_bytes: int = 1_000_000) -> DataFrame:
    """The newest events of each client that fit both bounds, oldest first; attachments are given up before any event is.

    events: (client, seq, payload STRING, capture_ref STRING). The window is per client, whose outbox is small by nature.
    """
    w = W.partitionBy("client").orderBy(F.desc("seq"))
    size = F.length("payload") + F.length(F.coalesce("capture_ref", F.lit("")))
    whole = events.withColumn("all_bytes", F.sum(size).over(W.partitionBy("client"))).withColumn("all_n", F.count("*").over(W.partitionBy("client")))
    fits = (F.col("all_bytes") <= max_bytes) & (F.col("all_n") <= max_events)
    lean = whole.withColumn("capture_ref", F.when(fits, F.col("capture_ref")))
    size = F.length("payload") + F.length(F.coalesce("capture_ref", F.lit("")))
    kept = lean.withColumn("k", F.row_number().over(w)).withColumn("upto", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return kept.filter((F.col("k") <= max_events) & (F.col("upto") <= max_bytes)).select("client", "seq", "payload", "capture_ref").orderBy("client", "seq")


def acknowledge(events: DataFrame, acks: DataFrame) -> DataFrame:
    return events.join(acks.select("client", "seq"), ["client", "seq"], "left_anti")


def peek(events: DataFrame, limit: int) -> DataFrame:
    """The oldest events of each client, at most limit."""
    k = F.row_number().over(W.partitionBy("client").orderBy("seq"))
    return events.withColumn("k", k).filter(F.col("k") <= limit).drop("k")


BATCH, MAX_ATTEMPTS = 20, 4


def batches(events: DataFrame, size: int = BATCH) -> DataFrame:
    """Events with the number of the batch they are sent in, per client in order of seq."""
    return events.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("client").orderBy("seq")) - 1) / size).cast("int"))


def flush_action(status: Column, attempt: Column, stripped: Column, size: Column) -> Column:
    """What a client does after an answer: acknowledge, drop, disable, strip attachments, halve the batch, wait as told, retry, or keep for later.

    status is null where there was no answer; attempt counts from 0.
    """
    last = attempt >= MAX_ATTEMPTS
    return (
        F.when(status.between(200, 299), "acknowledge").when(status.isin(401, 403), "disable")
        .when((status == 413) & ~stripped, "strip").when((status == 413) & (size > 1), "halve").when(status == 413, "drop")
        .when((status == 429) & ~last, "wait").when((status.isNull() | (status >= 500)) & ~last, "retry")
        .when(status.isNull() | (status >= 500) | (status == 429), "keep").otherwise("drop")
    )
