"""Ranking of clusters by weighted unique users, recency and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions.scalars import age_days

EXCLUDED_KINDS = ("praise",)
HALF_LIFE, GROWTH_DAYS, GROWTH_FLOOR, MAX_GROWTH, MRR_BASELINE = 60.0, 7.0, 3, 3.0, 100.0


def account_weight(mrr: Column, baseline: float = MRR_BASELINE) -> Column:
    return F.when(mrr.isNull() | (mrr <= 0), 1.0).otherwise(1 + F.log10(1 + mrr / baseline))


def recency_decay(age: Column, half_life: float = HALF_LIFE) -> Column:
    return F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def growth_multiplier(recent: Column, prior: Column, floor: int = GROWTH_FLOOR, most: float = MAX_GROWTH) -> Column:
    return F.when(prior < floor, 1.0).otherwise(F.least(recent / prior, F.lit(float(most))))


def latest_per_user(members: DataFrame) -> DataFrame:
    """One row per cluster and user: the latest by client_ts, the first inserted of equals. A hash aggregate: no window sort."""
    order = F.struct(F.unix_micros("client_ts").alias("t"), (-F.col("seq")).alias("s"))
    return members.groupBy("cluster_id", "user_id").agg(F.max_by(F.struct("client_ts", "mrr"), order).alias("l"), F.count("*").alias("n")).select(
        "cluster_id", "user_id", "l.client_ts", "l.mrr", "n")


def rank(members: DataFrame, now: str, *, half_life: float = HALF_LIFE, growth_days: float = GROWTH_DAYS, floor: int = GROWTH_FLOOR,
         most: float = MAX_GROWTH, baseline: float = MRR_BASELINE, excluded: tuple[str, ...] = EXCLUDED_KINDS) -> DataFrame:
    """(cluster_id, score, components…) of members (cluster_id, user_id, kind, client_ts, mrr, seq), best first.

    Two aggregations, by (cluster, user) and by cluster: a hot cluster is spread over its users. Clusters left without a
    member of an admitted kind are absent. Equal scores are in order of id.
    """
    at = F.lit(now).cast("timestamp")
    kept = members.filter(F.col("kind").isNull() | ~F.col("kind").isin(*excluded))
    l = latest_per_user(kept).withColumn("age", age_days(at, F.col("client_ts"))).withColumn("w", account_weight(F.col("mrr"), baseline))
    agg = l.groupBy("cluster_id").agg(
        F.count("*").alias("unique_users"), F.sum("n").alias("submissions"),
        F.sum(F.col("w") * recency_decay(F.col("age"), half_life)).alias("weighted_demand"), F.avg("w").alias("mean_weight"),
        F.count_if((F.col("age") >= 0) & (F.col("age") < growth_days)).alias("recent_users"),
        F.count_if((F.col("age") >= growth_days) & (F.col("age") < 2 * growth_days)).alias("prior_users"),
        F.max("client_ts").alias("newest"), F.min("client_ts").alias("oldest"),
    )
    g = growth_multiplier(F.col("recent_users"), F.col("prior_users"), floor, most)
    return agg.withColumn("growth", g).withColumn("score", F.col("weighted_demand") * F.col("growth")).orderBy(F.desc("score"), F.asc("cluster_id"))


def explain(floor: int = GROWTH_FLOOR) -> Column:
    """One line of text with the inputs of a ranked cluster's score."""
    one = lambda c, word: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {word}").otherwise(f" {word}s"))
    two = lambda c: F.format_string("%.2f", F.col(c))
    return F.concat_ws(
        ", ", one("unique_users", "user"), one("submissions", "submission"), F.concat(F.lit("demand "), two("weighted_demand")),
        F.when(F.col("mean_weight") > 1.001, F.concat(F.lit("avg weight "), two("mean_weight"))),
        F.when(F.col("prior_users") < floor, F.format_string("growth n/a (only %d prior)", "prior_users"))
        .otherwise(F.concat(F.lit("growth ×"), two("growth"), F.format_string(" (%d→ from %d)", "recent_users", "prior_users"))),
    )


def positions(ranked: DataFrame) -> DataFrame:
    """1-based positions in the ranked list. There is a row per cluster, not per record: the list is what the reader pages through."""
    return ranked.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), F.asc("cluster_id"))))
