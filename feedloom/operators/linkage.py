"""Agglomerative linkage on a sparse similarity graph by reciprocal nearest neighbours, all mutual best pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import maybe_broadcast, written

_BESIDE = {"average": [], "single": ["hi"], "complete": ["lo", "pairs"]}


def group_key(ids: Column) -> Column:
    """A key of a set of ids that does not depend on their order: keys of disjoint sets combine by exclusive or."""
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(F.xxhash64(x)))


def agglomerate(edges: DataFrame, threshold: float, sizes: DataFrame | None = None, *, linkage: str = "average", max_size_ratio: float = 0.0, rejected: DataFrame | None = None, one_at_a_time: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters (id, cluster), and per round the merges (old, new, similarity, n_old, n_new) that made them.

    edges: (a BIGINT, b BIGINT, sim DOUBLE), for linkage single also hi, for complete lo and pairs: sum, highest and lowest
    similarity and number of the member pairs with one; pairs without an edge are 0. sizes: (id, n) gives nodes that stand
    for n members each, whose sim is then the sum over their member pairs.

    Each round every cluster names its most similar neighbour (equal similarities: by a hash of the pair of ids), and every
    pair that names each other merges if its similarity reaches the threshold. These linkages never make a merged cluster
    more similar to a third than its parts were, so reciprocal pairs stay reciprocal whatever else merges, and the result
    is that of merging one best pair at a time. Every round merges one pair at least, so the rounds end; each is a written
    table of the edges, which carry the sizes of their ends.

    max_size_ratio and rejected (key BIGINT, a group_key over node ids) rule pairs out as they are in each round. A pair
    ruled out may still be the best in sight, so only pairs that are mutual best among all merge at once; where there is
    none, the best admitted pair alone does. one_at_a_time: only the best admitted pair merges in a round, this many times.
    """
    kept = _BESIDE[linkage]
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("s"), *[F.max(c).alias(c) for c in kept])
    one = F.lit(1).cast("bigint")
    e = e.withColumns({"na": one, "nb": one})
    if sizes is not None:
        for end in ("a", "b"):
            e = e.join(sizes.select(F.col("id").alias(end), F.col("n").cast("bigint").alias("n_")), end, "left").withColumn(f"n{end}", F.coalesce("n_", one)).drop("n_")
    if rejected is not None:
        e = e.withColumns({"ka": F.xxhash64("a"), "kb": F.xxhash64("b")})
        refused = written(rejected.select("key").distinct(), "rnn-rejected")
    ends = ["n", "k"] if rejected is not None else ["n"]
    e = written(e, "rnn-edges")
    label = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if sizes is not None:
        label = label.join(sizes.select("id"), "id", "full_outer")
    label = label.select("id", F.col("id").alias("cluster"))
    similarity = F.col("s") / (F.col("na") * F.col("nb"))
    if linkage == "single":
        similarity = F.col("hi")
    elif linkage == "complete":
        similarity = F.when(F.col("pairs") == F.col("na") * F.col("nb"), F.col("lo")).otherwise(0.0)
    ruled = max_size_ratio > 0 or rejected is not None
    merges: list[DataFrame] = []
    while True:
        sized = e.withColumn("sim", F.round(similarity, 12)).filter(F.col("sim") >= threshold)
        admitted = sized
        if max_size_ratio > 0:
            admitted = admitted.filter(F.greatest("na", "nb") <= F.least("na", "nb") * max_size_ratio)
        if rejected is not None:
            admitted = admitted.withColumn("key", F.col("ka").bitwiseXOR(F.col("kb"))).join(maybe_broadcast(refused), "key", "left_anti")
        # equal similarities are common; ordered by a hash of the pair they fall into many mutual pairs at once
        order = F.struct(F.col("sim").alias("sim"), F.xxhash64("a", "b").alias("h"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "na", "nb", *(["ka", "kb"] if rejected is not None else []))
        carried = [F.col(f"o.{c}{end}").alias(f"{c}_{side}") for c in ends for end, side in (("b", "old"), ("a", "new"))]
        said = [(-F.col("o.y")).alias("old"), (-F.col("o.x")).alias("new"), F.col("o.sim").alias("similarity"), *carried]
        pair = None
        if not one_at_a_time:
            best = sized.select(F.explode(F.array("a", "b")).alias("c"), order.alias("o")).groupBy("c").agg(F.max("o").alias("o"))
            pair = best.groupBy("o").agg(F.count("*").alias("named")).filter("named = 2").select(*said)
            if ruled:
                pair = pair.join(admitted.select(F.col("b").alias("old"), F.col("a").alias("new")), ["old", "new"], "left_semi")
            pair = written(pair, f"rnn-merge{len(merges)}")
        merged = pair.count() if pair is not None else 0
        if not merged and (ruled or one_at_a_time):
            pair = written(admitted.agg(F.max(order).alias("o")).filter("o IS NOT NULL").select(*said), f"rnn-merge{len(merges)}")
            merged = pair.count()
        if not merged:
            break
        merges.append(pair)
        # the first of a pair keeps its id and grows, the second takes over id, size and key of the first
        whole = {"n": F.col("n_old") + F.col("n_new"), "k": F.col("k_old").bitwiseXOR(F.col("k_new"))} if rejected is not None else {"n": F.col("n_old") + F.col("n_new")}
        grown = [whole[c].alias(f"{c}_") for c in ends]
        to = maybe_broadcast(pair.select("old", F.col("new").alias("new_"), *grown).unionByName(pair.select(F.col("new").alias("old"), F.col("new").alias("new_"), *grown)), 2 * merged)
        for end in ("a", "b"):
            e = e.join(to.withColumnRenamed("old", end), end, "left").withColumns({f"{c}{end}": F.coalesce(f"{c}_", f"{c}{end}") for c in ends} | {end: F.coalesce("new_", end)}).drop("new_", *[f"{c}_" for c in ends])
        swap = F.col("a") > F.col("b")
        e = e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", *kept, *[F.when(swap, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")).alias(f"{c}{x}") for c in ends for x, y in (("a", "b"), ("b", "a"))])
        beside = {"hi": F.max("hi").alias("hi"), "lo": F.min("lo").alias("lo"), "pairs": F.sum("pairs").alias("pairs")} if kept else {}
        e = written(e.groupBy("a", "b").agg(F.sum("s").alias("s"), *[beside[c] for c in kept], *[F.max(f"{c}{end}").alias(f"{c}{end}") for c in ends for end in "ab"]), f"rnn-edges{len(merges)}")
        label = label.join(maybe_broadcast(pair.select(F.col("old").alias("cluster"), F.col("new").alias("new_")), merged), "cluster", "left").select("id", F.coalesce("new_", "cluster").alias("cluster"))
        if len(merges) % 8 == 0:  # a bounded plan
            label = written(label, f"rnn-labels{len(merges)}")
        if one_at_a_time and len(merges) >= one_at_a_time:
            break
    return label, merges


def average_linkage(edges: DataFrame, threshold: float, sizes: DataFrame | None = None) -> DataFrame:
    """(id, cluster) for every node of (a BIGINT, b BIGINT, sim DOUBLE); cluster is the smallest node id in it.

    The similarity of two clusters is the mean over all pairs of their nodes, pairs without an edge counting 0.
    Self-links and null ids are ignored; of repeated links the largest similarity counts; nodes without an edge are kept if
    sizes names them; an empty table gives no rows.
    """
    return agglomerate(edges, threshold, sizes)[0]
