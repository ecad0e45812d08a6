"""Demonstration data: a time shift for any table, and a seeded generator of feedback."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shift_to(df: DataFrame, column: str, now: str) -> DataFrame:
    """All times moved so that the newest equals now; gaps stay. The newest time is one aggregated row."""
    newest = df.agg(F.max(column).alias("newest_"))
    moved = F.timestamp_micros(F.unix_micros(column) + F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("newest_"))
    return df.crossJoin(F.broadcast(newest)).withColumn(column, moved).drop("newest_")  # one row


def generate(spark: SparkSession, n: int, seed: int = 1, days: int = 120, ends_at: str = "2026-09-09T12:00:00+00:00", topics: int = 25) -> DataFrame:
    """n feedback rows about topics that are steady, growing, fading or sudden, from accounts of unequal size.

    Every row is made from its number and the seed, on the workers: the same arguments give the same rows.
    """
    end = datetime.fromisoformat(ends_at).astimezone(UTC)
    shapes = ("steady", "growing", "fading", "sudden")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = random.Random(seed * 1_000_003 + int(k))
                topic = min(int(rng.paretovariate(1.1)) - 1, topics - 1)
                u = rng.random()
                at = {"steady": u, "growing": u ** 0.5, "fading": 1 - u ** 0.5, "sudden": 1 - u / 8}[shapes[topic % 4]]
                account = min(int(rng.paretovariate(1.2)), 500)
                when = end - timedelta(seconds=round((1 - at) * days * 86_400))
                out.append((f"g{k}", f"topic-{topic:02d}", f"u:acct_{account:03d}", round(50 * (501 - account) ** 0.5, 2), when))
            yield pd.DataFrame(out, columns=["id", "topic", "user_id", "mrr", "client_ts"])

    return spark.range(n).mapInPandas(run, "id string, topic string, user_id string, mrr double, client_ts timestamp")
