"""Hashing embeddings, and a cache of vectors by model and text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.hashing import LOW_BASE, LOW_PRIME


def _fnv(text: str) -> int:
    h = LOW_BASE
    for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
        h = ((h ^ unit) * LOW_PRIME) & 0xFFFFFFFF
    return h


def hashing_embedding(tokens: Column, dimensions: int = 256) -> Column:
    """Unit vector of signed hashed tokens and token pairs; all zeros for no tokens."""
    def run(lists: pd.Series) -> pd.Series:
        memo: dict[str, tuple[int, int]] = {}
        out = []
        for ts in lists:
            v = np.zeros(dimensions)
            ts = [] if ts is None else list(ts)
            for term in [*ts, *(f"{a}_{b}" for a, b in zip(ts, ts[1:]))]:
                if term not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[term] = (_fnv(term) % dimensions, 1 if _fnv(term + "#") & 1 else -1)
                slot, sign = memo[term]
                v[slot] += sign
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(tokens)


def parse_response(response: Column, expected: Column) -> Column:
    """Vectors of an embeddings answer (JSON text) in order of index, scaled to unit length; null if their number, an index or a length does not fit."""
    r = F.from_json(response, "data array<struct<index: int, embedding: array<double>>>")
    rows = F.array_sort(F.coalesce(r["data"], F.array().cast("array<struct<index: int, embedding: array<double>>>")))
    width = F.size(F.element_at(rows, 1)["embedding"])
    right = (F.size(rows) == expected) & F.forall(F.arrays_zip(rows.alias("r"), F.sequence(F.lit(0), F.size(rows) - 1).alias("k")), lambda x: (x["r"]["index"] == x["k"]) & (F.size(x["r"]["embedding"]) == width) & (width > 0))

    def unit(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))

    return F.when(F.size(rows) == 0, F.when(expected == 0, F.array().cast("array<array<double>>"))).when(right, F.transform(rows, lambda x: unit(x["embedding"])))


def oracle_embedding(label: Column, text: Column, noise: float = 0.0, dimensions: int = 64, seed: int = 1) -> Column:
    """A unit vector drawn for the label, mixed with noise drawn for the text: what an embedder of that quality would give."""
    def draw(what: str) -> np.ndarray:
        v = np.random.default_rng([seed, _fnv(what), len(what)]).standard_normal(dimensions)
        return v / np.linalg.norm(v)

    def run(labels: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for l, t in zip(labels, texts):
            if l is None or t is None:
                out.append(None)
                continue
            v = (1 - noise) * draw(f"label {l}") + noise * draw(f"text {t}")
            out.append(v / max(np.linalg.norm(v), 1e-12))
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(label, text)


def resolve(settings: dict[str, str]) -> str:
    """The embedder a configuration names: hashing, endpoint (needs its address and model), or none for anything unusable."""
    kind = (settings.get("embedder") or "none").strip().lower()
    if kind == "endpoint" and settings.get("url") and settings.get("model"):
        return "endpoint"
    return kind if kind == "hashing" else "none"


def cache_statistics(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(hits, misses, deduped) of with_cache(): texts found in the cache, distinct ones embedded, and repeats of those."""
    known = cache.filter(F.col("model") == model).select("text").distinct().withColumn("known", F.lit(True))
    per = texts.filter("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n")).join(known, "text", "left")
    hit = F.coalesce("known", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return per.agg(zero(F.sum(F.when(hit, F.col("n")))).alias("hits"), F.count_if(~hit).alias("misses"), zero(F.sum(F.when(~hit, F.col("n") - 1))).alias("deduped"))


def with_cache(texts: DataFrame, cache: DataFrame, model: str, embed) -> tuple[DataFrame, DataFrame]:
    """(texts with vector, new cache rows): every distinct text is embedded once, those in the cache not at all.

    texts: (id, text); cache: (model, text, vector); embed: a function from a text column to a vector column.
    """
    known = cache.filter(F.col("model") == model).select("text", "vector")
    fresh = texts.select("text").filter("text IS NOT NULL").distinct().join(known.select("text"), "text", "left_anti")
    made = fresh.select(F.lit(model).alias("model"), "text", F.transform(embed(F.col("text")), lambda x: F.round(x, 6)).alias("vector"))
    return texts.join(known.unionByName(made.select("text", "vector")), "text", "left").select("id", "text", "vector"), made
