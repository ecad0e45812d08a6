"""Mixing sources to target shares of the total size in tokens, by hash-threshold histograms.

Every text has a fixed 60-bit hash. Tokens are summed by source and leading hash digits, which gives a histogram of a
bounded size; the part of a source that fills a budget is then "all hashes below a threshold", found by nested
histograms that open only the boundary bucket. Rows are filtered by their hash: nothing is sorted, and a source that
holds a third of all rows is spread over its buckets.

A source's texts are its distinct texts. A budget of k whole passes and a rest takes every text k times and those below
the threshold once more, never more than max_repeats times. A source that cannot fill its share gives all it may, and
is reported as short.

Defined results: null texts have no tokens and are left out; a null source belongs to no target but counts in the total;
null shares count as 0 and null repeats as 1; a target without documents is short if its share is above 0; empty tables
give empty plans. Of repeated texts the smallest id is kept.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from feedloom.runtime import maybe_broadcast, written

#: Folder of the public tokenizer files and the vocabulary used by default.
TOKENIZERS = os.environ.get("FEEDLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The word splitting rule of that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEVELS, DIGITS = 4, 12


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; null for a null text. Vectorised; the vocabulary is loaded once per worker."""
    where = path or os.path.join(TOKENIZERS, VOCABULARY)

    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(where)
        return pd.Series([len(enc.encode_ordinary(t)) if t is not None else None for t in texts], dtype="Int64")

    return F.pandas_udf(count, T.LongType())(text)


def sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, text_key, hash, tokens), written once: the texts are tokenised a single time. hash and text_key identify a text."""
    digest = F.substring(F.md5("text"), 1, 15)
    s = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"), F.conv(digest, 16, 10).cast("bigint").alias("hash"), token_count(F.col("text"), path).alias("tokens"))
    return written(s, "mix-sizes")


def distinct_texts(sized: DataFrame) -> DataFrame:
    """(source, text_key, hash, tokens) of each source's distinct texts, written once."""
    t = sized.filter(F.col("source").isNotNull()).groupBy("source", "text_key", "hash").agg(F.max("tokens").alias("tokens"))
    return written(t, "mix-texts")


def _digit(level: int) -> Column:
    return F.shiftright("hash", 60 - DIGITS * (level + 1)).bitwiseAND(F.lit((1 << DIGITS) - 1))


def _histogram(texts: DataFrame, level: int) -> DataFrame:
    return texts.groupBy("source", _digit(level).alias("bucket")).agg(F.sum("tokens").alias("tokens"))


def goals(sized: DataFrame, targets: DataFrame, hist: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: supply (the sum of its histogram), goal, whole passes, rest of the budget, and whether it is short."""
    goal_total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")) if total is None else sized.sparkSession.range(1).select(F.lit(total).cast("bigint").alias("all_tokens"))
    supply = hist.groupBy("source").agg(F.sum("tokens").alias("supply"))
    return (
        targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
        .join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
        .crossJoin(F.broadcast(goal_total))  # one row
        .withColumn("goal", F.col("target_share") * F.col("all_tokens"))
        .withColumn("short", F.col("goal") > F.col("supply") * F.col("max_repeats"))
        .withColumn("passes", F.when(F.col("supply") > 0, F.least(F.floor(F.col("goal") / F.col("supply")), F.col("max_repeats"))).otherwise(0))
        .withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("goal") - F.col("passes") * F.col("supply")).otherwise(0.0))
    )


def supplies(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """goals() from the first histogram alone: enough to tell which sources are short."""
    return goals(sized, targets, _histogram(distinct_texts(sized), 0), total)


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: supply, goal, whole passes, rest, hash threshold of the extra pass, whether it is short, and the share reached.

    total is the size of the mixture; by default that of all documents together, null sources included.
    """
    texts = distinct_texts(sized)
    hist = written(_histogram(texts, 0), "mix-histogram")
    aim = written(goals(sized, targets, hist, total), "mix-goals")
    # nested budgets: find the bucket in which the rest is used up, then open only that bucket
    state = aim.select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("taken"))
    for level in range(LEVELS):
        small = maybe_broadcast(state)
        if level:
            prefix = F.shiftright("hash", 60 - DIGITS * level).alias("prefix")
            hist = _histogram(texts.select("source", "hash", "tokens", prefix).join(small.select("source", "prefix"), ["source", "prefix"], "left_semi"), level)
        w = W.partitionBy("source").orderBy("bucket")  # at most 2**DIGITS rows a source
        upto = hist.withColumn("upto", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))).join(small.select("source", "left"), "source")
        inside = F.col("upto") <= F.col("left")
        cut = upto.groupBy("source").agg(
            F.max(F.when(inside, F.col("upto"))).alias("got"), (F.max(F.when(inside, F.col("bucket"))) + 1).alias("next"), F.min(F.when(~inside, F.col("bucket"))).alias("boundary"))
        state = written(state.join(cut, "source", "left").select(
            "source", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"),
            (F.col("prefix") * (1 << DIGITS) + F.coalesce("boundary", "next", F.lit(0))).alias("prefix"),
            (F.col("taken") + F.coalesce("got", F.lit(0))).alias("taken")), f"mix-level{level}")
    threshold = F.col("prefix") * (1 << (60 - DIGITS * LEVELS))
    return aim.join(state.select("source", "taken", threshold.alias("threshold")), "source", "left").withColumn("reached", F.col("passes") * F.col("supply") + F.coalesce("taken", F.lit(0)))


def mixture(sized: DataFrame, plan_df: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): the texts used and how often. A filter on hashes; the plan has a row per target."""
    once = sized.filter(F.col("source").isNotNull()).groupBy("source", "text_key", "hash").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    p = plan_df.select("source", "passes", "threshold")
    copies = (F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return once.join(maybe_broadcast(p), "source").withColumn("copies", copies).filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")


def shares(plan_df: DataFrame) -> DataFrame:
    """Per source: target and actual share of the mixture's tokens."""
    whole = F.sum("reached").over(W.partitionBy(F.lit(0)))  # a row per target
    return plan_df.select("source", "target_share", "short", "reached", F.when(whole > 0, F.col("reached") / whole).otherwise(0.0).alias("actual_share"))
