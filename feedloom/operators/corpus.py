"""A labelled corpus: integrity checks, and a parameter sweep scored against its labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import metrics


def validate(items: DataFrame, clusters: DataFrame, pairs: DataFrame, min_size: int = 2) -> DataFrame:
    """(code, subject) of every problem. items: (id, cluster, body, client_ts STRING); clusters: (id); pairs: (a, b, same)."""
    label = items.groupBy("id").agg(F.min("cluster").alias("cluster"), F.count("*").alias("n"))
    size = items.groupBy("cluster").agg(F.count("*").alias("n"))
    single = F.col("cluster").startswith("singleton-")
    ends = pairs.join(label.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b", "left")
    name = F.concat_ws("+", "a", "b")
    known = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    found = [
        label.filter("n > 1").select(F.lit("duplicate-id").alias("code"), F.col("id").alias("subject")),
        items.join(clusters.select(F.col("id").alias("cluster")), "cluster", "left_anti").filter(~single).select(F.lit("undeclared-cluster"), "id"),
        items.filter(F.trim(F.coalesce("body", F.lit(""))) == "").select(F.lit("empty-body"), "id"),
        items.filter(F.try_to_timestamp("client_ts").isNull()).select(F.lit("bad-timestamp"), "id"),
        clusters.join(size, clusters["id"] == size["cluster"], "left_anti").select(F.lit("empty-cluster"), "id"),
        size.filter(~single & (F.col("n") < min_size)).select(F.lit("undersized-cluster"), "cluster"),
        size.filter(single & (F.col("n") > 1)).select(F.lit("fat-singleton"), "cluster"),
        ends.filter(~known).select(F.lit("dangling-pair"), name),
        pairs.filter("a = b").select(F.lit("self-pair"), name),
        ends.filter(known & ((F.col("ca") == F.col("cb")) != F.col("same"))).select(F.lit("pair-contradicts-labels"), name),
    ]
    return reduce(DataFrame.unionAll, found).distinct()


def score_subset(items: DataFrame, predicate, clusterer: Callable[[DataFrame], DataFrame], truth: str = "cluster") -> DataFrame:
    """All metrics of clustering only the records that fulfil the predicate. clusterer: records -> (id, label)."""
    part = items.filter(predicate)
    t = metrics.contingency(part.join(clusterer(part), "id"), truth, "label")
    return metrics.adjusted_rand(t).crossJoin(metrics.pairwise(t)).crossJoin(metrics.v_measure(t))  # one row each


def sweep(items: DataFrame, cells: list[dict], clusterer: Callable[..., DataFrame], truth: str = "cluster", tolerance: float = 0.1, baseline_precision: float = 0.0) -> DataFrame:
    """One row per cell of a parameter grid, best first: cells below the precision floor (degenerate ones) come last.

    The grid is the caller's list; every cell is one distributed clustering.
    """
    rows = []
    for k, cell in enumerate(cells):
        t = metrics.contingency(items.join(clusterer(items, **cell), "id"), truth, "label")
        said = [F.lit(v).alias(n) for n, v in cell.items()]
        rows.append(metrics.adjusted_rand(t).crossJoin(metrics.pairwise(t)).select(F.lit(k).alias("cell"), *said, "ari", "precision", "recall", "f1"))
    out = reduce(DataFrame.unionByName, rows).withColumn("degenerate", F.col("precision") < baseline_precision * (1 - tolerance))
    return out.orderBy("degenerate", F.desc("f1"), "cell")


def evaluate(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row over all metrics: counts, adjusted Rand, pairwise and entropy measures."""
    t = metrics.contingency(pairs, truth, predicted)
    size = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count_distinct("truth").alias("true_clusters"), F.count_distinct("predicted").alias("predicted_clusters"))
    return size.crossJoin(metrics.adjusted_rand(t)).crossJoin(metrics.pairwise(t)).crossJoin(metrics.v_measure(t))  # one row each


def sweep_winner(cells: DataFrame) -> DataFrame:
    """The best cell of (cell, hits, semantic_weight, threshold, degenerate): degenerate ones win only among themselves."""
    return cells.orderBy(F.coalesce("degenerate", F.lit(False)), F.desc("hits"), "semantic_weight", "threshold", "cell").limit(1)


def load(spark, path: str) -> dict[str, DataFrame]:
    """items, clusters and pairs of a labelled corpus: three JSON documents in a folder, each an array of objects."""
    return {name: spark.read.option("multiLine", True).json(f"{path.rstrip('/')}/{name}.json") for name in ("items", "clusters", "pairs")}
