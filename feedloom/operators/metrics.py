"""Agreement of two labellings, from one contingency table; each metric is a one-row DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def contingency(pairs: DataFrame, t: str = "truth", p: str = "predicted") -> DataFrame:
    return pairs.groupBy(F.col(t).alias("truth"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def expand_noise(pairs: DataFrame, noise: str, label: str = "predicted", key: str = "id") -> DataFrame:
    """Every noise item becomes a label of its own."""
    return pairs.withColumn(label, F.when(F.col(label) == noise, F.concat(F.lit("__noise_"), F.col(key).cast("string"), F.lit("__"))).otherwise(F.col(label)))


def _sums(table: DataFrame) -> DataFrame:
    """One row with the pair counts and entropies that all metrics are made of, from grouping sets over one table."""
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2
    g = table.groupingSets([["truth", "predicted"], ["truth"], ["predicted"], []], "truth", "predicted").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    total = F.max(F.when(F.col("g") == 3, F.col("n")))
    per = lambda g_: F.sum(F.when(F.col("g") == g_, c2("n")))
    nlogn = lambda g_: F.sum(F.when(F.col("g") == g_, F.col("n") * F.ln("n")))
    return g.agg(
        total.alias("n"), per(0).alias("both"), per(1).alias("t_pairs"), per(2).alias("p_pairs"),
        nlogn(0).alias("l_tp"), nlogn(1).alias("l_t"), nlogn(2).alias("l_p"),
        F.count_if(F.col("g") == 1).alias("n_truth"), F.count_if(F.col("g") == 2).alias("n_predicted"),
    )


def adjusted_rand(table: DataFrame) -> DataFrame:
    """1 for degenerate labellings."""
    s = _sums(table)
    expected = F.col("t_pairs") * F.col("p_pairs") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0))
    most = (F.col("t_pairs") + F.col("p_pairs")) / 2
    return s.select(F.when(F.coalesce(most - expected, F.lit(0.0)) == 0, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def pairwise(table: DataFrame) -> DataFrame:
    """Precision, recall and F1 over pairs; 1 where there is nothing to judge."""
    s = _sums(table)
    p = F.when(F.coalesce("p_pairs", F.lit(0)) == 0, 1.0).otherwise(F.col("both") / F.col("p_pairs"))
    r = F.when(F.coalesce("t_pairs", F.lit(0)) == 0, 1.0).otherwise(F.col("both") / F.col("t_pairs"))
    return s.select(p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def v_measure(table: DataFrame) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean, in natural logarithms; 1 where an entropy is 0."""
    s = _sums(table)
    n = F.col("n")
    ht, hp = F.ln(n) - F.col("l_t") / n, F.ln(n) - F.col("l_p") / n
    ht_p, hp_t = (F.col("l_p") - F.col("l_tp")) / n, (F.col("l_t") - F.col("l_tp")) / n
    e = s.select(F.when(F.abs(ht) < 1e-12, 1.0).otherwise(1 - ht_p / ht).alias("homogeneity"), F.when(F.abs(hp) < 1e-12, 1.0).otherwise(1 - hp_t / hp).alias("completeness"))
    return e.withColumn("v", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))))


def diagnose(table: DataFrame, side: str = "truth") -> DataFrame:
    """Labels of one side that spread over two or more of the other, worst first: splits of truth, or merges of predictions."""
    return table.groupBy(F.col(side).alias("label")).agg(F.count("*").alias("parts"), F.sum("n").alias("size")).filter("parts > 1").orderBy(F.desc("parts"), F.desc("size"), "label")


def plurality(table: DataFrame, of: str = "truth", by: str = "predicted") -> DataFrame:
    """(of, by, share): the other side's label that holds most of a label; the smaller label among equals."""
    w = W.partitionBy(of).orderBy(F.desc("n"), by)
    whole = F.sum("n").over(W.partitionBy(of))
    return table.withColumn("share", F.col("n") / whole).withColumn("k", F.row_number().over(w)).filter("k = 1").select(of, by, "share")


def top_k_agreement(table: DataFrame, truth_rank: DataFrame, predicted_rank: DataFrame, k: int) -> DataFrame:
    """Hits, recall and mean capture of the true top k within the predicted top k. Ranks: (label, position)."""
    true_top = truth_rank.filter(F.col("position") <= k).select(F.col("label").alias("truth"))
    seen = predicted_rank.filter(F.col("position") <= k).select(F.col("label").alias("predicted"))
    named = plurality(table, "predicted", "truth").join(seen, "predicted", "left_semi").select("truth").distinct().withColumn("hit", F.lit(1))
    whole = table.groupBy("truth").agg(F.sum("n").alias("size"))
    best = table.join(seen, "predicted", "left_semi").groupBy("truth").agg(F.max("n").alias("best"))
    j = true_top.join(named, "truth", "left").join(whole, "truth", "left").join(best, "truth", "left")
    return j.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"), F.avg(F.coalesce(F.col("best") / F.col("size"), F.lit(0.0))).alias("capture"))


def hard_pairs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per trap: pairs, right ones, false merges and false splits, worst first. labels: (id, label); pairs: (a, b, same, trap)."""
    j = pairs.join(labels.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "lb"}), "b")
    says = F.col("la") == F.col("lb")
    return j.groupBy("trap").agg(F.count("*").alias("pairs"), F.count_if(says == F.col("same")).alias("correct"), F.count_if(says & ~F.col("same")).alias("false_merges"), F.count_if(~says & F.col("same")).alias("false_splits")).orderBy(F.asc(F.col("correct") / F.col("pairs")), "trap")
