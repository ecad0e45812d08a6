"""Blocking by bands of SimHash fingerprints, and groups of near-duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import hashing
from feedloom.operators.components import components
from feedloom.runtime import maybe_broadcast, written

#: Buckets of more fingerprints than this are split into blocks that run on different tasks.
BLOCK = 2000


def bands(fingerprints: DataFrame, n: int = 8, doc: str = "doc_id") -> DataFrame:
    """(doc, fp, band, chunk)."""
    rows = fingerprints.select(doc, "fp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    return rows.withColumn("chunk", hashing.band_chunk(F.col("fp"), F.col("band"), n))


def _keys(fps: DataFrame, n: int, depth: int) -> DataFrame:
    """(rep, fp, combo, last, key): a row per combination of depth bands; last is the combination's highest band."""
    width = hashing.BITS // n

    def key(combo: tuple[int, ...]) -> Column:
        chunks = [hashing.band_chunk(F.col("fp"), F.lit(k), n) for k in combo]
        return chunks[0] if depth == 1 else F.shiftleft(chunks[0], width).bitwiseOR(chunks[1])

    combos = [F.struct(F.lit(c).alias("combo"), F.lit(bands_of[-1]).alias("last"), key(bands_of).alias("key")) for c, bands_of in enumerate(combinations(range(n), depth))]
    return fps.select("rep", "fp", F.explode(F.array(*combos)).alias("k")).select("rep", "fp", "k.combo", "k.last", "k.key")


def candidates(fingerprints: DataFrame, n: int = 8, max_bucket: int | None = None, doc: str = "doc_id", max_distance: int | None = None) -> DataFrame:
    """Distinct candidate pairs (a, b, fa, fb), a < b, of documents that share a band, of those at most max_distance apart if it is given.

    Documents with the same fingerprint are one entry, their smallest id. No pair is left out: buckets of more than BLOCK
    fingerprints are split into blocks that meet all of the bucket. If max_distance leaves two bands or more untouched, the
    buckets are those of two bands at once, which no pair can escape. Only where max_bucket is given (the reference's
    option) are larger buckets of one band skipped.
    """
    depth = 2 if max_bucket is None and max_distance is not None and n - max_distance >= 2 else 1
    keys = _keys(fingerprints.groupBy("fp").agg(F.min(doc).alias("rep")), n, depth)
    sizes = keys.groupBy("combo", "key").agg(F.count("*").alias("size"))
    if max_bucket is not None:
        keys = keys.join(sizes.filter(F.col("size").between(2, max_bucket)).select("combo", "key"), ["combo", "key"])
    large = written(sizes.filter(F.col("size") > BLOCK).select("combo", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "lsh-large")
    keys = keys.join(maybe_broadcast(large), ["combo", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = keys.select("combo", "key", "last", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("a"), F.col("fp").alias("fa"))
    y = keys.select("combo", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("b"), F.col("fp").alias("fb"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    shared = [((F.col("last") >= k) & (hashing.band_chunk(differ, F.lit(k), n) == 0)).cast("int") for k in range(n)]
    once = sum(shared[1:], shared[0]) == depth  # a pair counts in the first buckets it shares only
    met = x.join(y, ["combo", "key", "block"]).filter("a < b")
    if max_distance is not None:
        met = met.filter(hashing.hamming(F.col("fa"), F.col("fb")) <= max_distance)
    return met.filter(once).select("a", "b", "fa", "fb")


def near_duplicate_groups(fingerprints: DataFrame, max_distance: int = 6, n: int = 8, max_bucket: int | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, group_id): groups of two or more documents linked by fingerprints at most max_distance apart; copies included."""
    pairs = candidates(fingerprints, n, max_bucket, doc, max_distance).select("a", "b")
    rep = fingerprints.groupBy("fp").agg(F.min(doc).alias("rep"), F.count("*").alias("copies"))
    comp = components(pairs)
    label = rep.join(comp, rep["rep"] == comp["id"], "left").filter("component IS NOT NULL OR copies > 1").select("fp", F.coalesce("component", "rep").alias("group_id"))
    return fingerprints.join(label, "fp").select(doc, "group_id")
