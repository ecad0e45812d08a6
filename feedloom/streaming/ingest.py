"""Streams: idempotent ingest of envelopes, and write-time cluster assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.clustering import Leader
from feedloom.sources import envelopes


def idempotent_writer(spark: SparkSession, path: str, policy: str = "per-day"):
    """A foreachBatch function that appends envelopes' new submissions to a Parquet store.

    Ids are unique for ever, so they are held against the store, not against a watermark. Each batch writes its own
    folder and replaces it when it is run again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = envelopes.to_submissions(envelopes.parse(batch), policy).withColumn("batch", F.lit(batch_id))
        rest = [c for c in rows.columns if c not in ("project_id", "id")]
        order = F.struct(*[c for c in rest if c not in envelopes.NESTED], *[F.to_json(c).alias(c) for c in envelopes.NESTED])  # maps have no order
        once = rows.groupBy("project_id", "id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("project_id", "id", "r.*")
        try:
            stored = spark.read.parquet(path).filter(F.col("batch") != batch_id).select("project_id", "id")
            once = once.join(stored, ["project_id", "id"], "left_anti")
        except Exception as problem:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(problem):
                raise
        once.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def assign_stream(docs: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(project_id, id, cluster_id, similarity) of a stream (project_id, id, tokens, seq): one assignment per id, never changed.

    The state of a project is that of its clusters; a repeated id gets its first cluster with similarity 1.
    """
    import json

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        leader, seen = Leader(threshold), {}
        if state.exists:
            leader, seen = Leader.from_json(state.get[0]), json.loads(state.get[1])
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if r.id in seen:
                out.append((key[0], r.id, seen[r.id], 1.0))
                continue
            c, s = leader.assign(list(r.tokens))
            seen[r.id] = f"c{c}"
            out.append((key[0], r.id, seen[r.id], s))
        state.update((leader.to_json(), json.dumps(seen)))
        yield pd.DataFrame(out, columns=["project_id", "id", "cluster_id", "similarity"])

    return docs.groupBy("project_id").applyInPandasWithState(run, "project_id string, id string, cluster_id string, similarity double", "leader string, seen string", "append", "NoTimeout")
