"""Connected components of an undirected graph of string ids, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id of the component, for every id in an edge.

    Alternates hanging neighbours under the smallest neighbour and pointing them there (large-star and small-star), which
    needs a logarithmic number of rounds on chains and two on stars. Every round is a written table, so a lost executor
    costs one round at most. A hub's neighbours are grouped by a map-side minimum, never gathered into one row.
    The rounds go on until nothing changes, whatever their number. Null ids and self-links are ignored; repeated links count once; an empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    k = 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: larger neighbours of u point to the smallest id around u
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        small = star.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (
            star.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        nxt = written(nxt, f"cc{k + 1}")
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            break
        e, k = nxt, k + 1
    out = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return out.unionByName(out.select(F.col("component").alias("id"), "component")).distinct()
