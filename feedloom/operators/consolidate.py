"""Merging, splitting and thinning out clusters of unit vectors, by the algebra of their sums.

With S the sum of a cluster's n vectors: the average linkage of two clusters is S_A·S_B / (n_A n_B), a member's mean
similarity to the rest (v·S − v·v) / (n − 1), the mean similarity within (S·S − Σ v·v) / (n (n − 1)). So no pairs of
members are formed; only clusters that share a term meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.operators.components import components
from feedloom.operators.linkage import agglomerate, group_key
from feedloom.runtime import maybe_broadcast, written


def _sums(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.join(labels.select("id", "cluster_id"), "id").groupBy("cluster_id", "term").agg(F.sum("w").alias("s"))


def linkage_table(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, dot, na, nb, similarity), a < b: average linkage of clusters that share a term. vectors: (id, term, w)."""
    s = _sums(vectors, labels)
    n = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    x, y = s.select(F.col("cluster_id").alias("a"), "term", F.col("s").alias("sa")), s.select(F.col("cluster_id").alias("b"), "term", F.col("s").alias("sb"))
    dots = x.join(y, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    sized = dots.join(n.withColumnsRenamed({"cluster_id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"cluster_id": "b", "n": "nb"}), "b")
    return sized.withColumn("similarity", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 12))


def _graph(vectors: DataFrame, labels: DataFrame, linkage: str) -> DataFrame:
    """Edges between clusters (hashed ids): sums over member pairs, for linkages other than average also their extremes."""
    h = F.xxhash64
    if linkage == "average":
        return linkage_table(vectors, labels).select(h("a").alias("a"), h("b").alias("b"), F.col("dot").alias("sim"))
    v = vectors.join(labels.select("id", "cluster_id"), "id")
    x, y = v.select(F.col("cluster_id").alias("ca"), F.col("id").alias("i"), "term", F.col("w").alias("wa")), v.select(F.col("cluster_id").alias("cb"), F.col("id").alias("j"), "term", F.col("w").alias("wb"))
    pairs = x.join(y, "term").filter("ca < cb").groupBy("ca", "cb", "i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return pairs.groupBy(h("ca").alias("a"), h("cb").alias("b")).agg(F.sum("sim").alias("sim"), F.max("sim").alias("hi"), F.min("sim").alias("lo"), F.count("*").alias("pairs"))


def _rejected_groups(rejected: DataFrame) -> DataFrame:
    """(key BIGINT) of rejected proposal keys (key STRING): the ids of a group joined by +."""
    ids = F.transform(F.split("key", r"\+"), lambda c: F.xxhash64(c))
    return rejected.select(group_key(ids).alias("key"))


def consolidate(vectors: DataFrame, labels: DataFrame, threshold: float = 0.1, max_size_ratio: float = 0.0, rejected: DataFrame | None = None) -> DataFrame:
    """(cluster_id, merged_id): every cluster and the smallest id of the clusters it merges with, by average linkage.

    Pairs of groups beyond max_size_ratio (0: no limit) or whose joint key is in rejected (key) do not merge. A threshold
    of 0 or less merges all: disjoint clusters score 0.
    """
    ids = labels.select("cluster_id").distinct()
    if threshold <= 0:
        return ids.crossJoin(F.broadcast(ids.agg(F.min("cluster_id").alias("merged_id"))))  # one row
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n")).select(F.xxhash64("cluster_id").alias("id"), "n")
    merged, _ = agglomerate(_graph(vectors, labels, "average"), threshold, sizes, max_size_ratio=max_size_ratio, rejected=None if rejected is None else _rejected_groups(rejected))
    named = ids.select("cluster_id", F.xxhash64("cluster_id").alias("id")).join(merged, "id")
    least = named.groupBy("cluster").agg(F.min("cluster_id").alias("merged_id"))
    return named.join(least, "cluster").select("cluster_id", "merged_id")


def merge_proposals(vectors: DataFrame, labels: DataFrame, threshold: float, *, linkage: str = "average", max_size_ratio: float = 0.0,
                    rejected: DataFrame | None = None, locked: DataFrame | None = None, max_proposals: int = 0) -> DataFrame:
    """(key, cluster_ids, similarity, size_a, size_b): one row per merge, surest first, equal ones by key.

    The merges are those of joining the most similar pair of groups again and again until none reaches the threshold
    (above 0), the similarity of grown groups measured anew. A later row's group holds earlier ones. locked (cluster_id) and clusters
    without vectors take no part; max_proposals (0: no limit) stops after as many merges; size_a is the first group's.
    """
    if locked is not None:
        labels = labels.join(locked.select("cluster_id"), "cluster_id", "left_anti")
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    ruled = max_size_ratio > 0 or rejected is not None
    _, merges = agglomerate(
        _graph(vectors, labels, linkage), threshold, sizes.select(F.xxhash64("cluster_id").alias("id"), "n"), linkage=linkage, max_size_ratio=max_size_ratio,
        rejected=None if rejected is None else _rejected_groups(rejected), one_at_a_time=max_proposals if ruled else 0)
    now = sizes.select("cluster_id", F.xxhash64("cluster_id").alias("g"))
    rows = None
    for k, pair in enumerate(merges):
        m = maybe_broadcast(pair)
        now = now.join(m.select(F.col("old").alias("g"), F.col("new").alias("to")), "g", "left").select("cluster_id", F.coalesce("to", "g").alias("g"))
        if k % 8 == 7:
            now = written(now, f"cons-groups{k}")
        made = now.join(m.withColumnRenamed("new", "g"), "g").groupBy("g", "similarity", "n_new", "n_old").agg(F.array_sort(F.collect_list("cluster_id")).alias("cluster_ids"))
        rows = made if rows is None else rows.unionByName(made)
    if rows is None:
        rows = sizes.limit(0).select(F.lit(0.0).alias("similarity"), F.col("n").alias("n_new"), F.col("n").alias("n_old"), F.array("cluster_id").alias("cluster_ids"))
    out = rows.select(F.array_join("cluster_ids", "+").alias("key"), "cluster_ids", "similarity", F.col("n_new").alias("size_a"), F.col("n_old").alias("size_b")).orderBy(F.desc("similarity"), "key")
    return out.limit(max_proposals) if max_proposals else out


def apply_merges(labels: DataFrame, accepted: DataFrame) -> DataFrame:
    """Labels with the accepted proposals (cluster_ids) merged: overlapping ones compose, the smallest id names the group."""
    links = accepted.select(F.element_at("cluster_ids", 1).alias("a"), F.explode("cluster_ids").alias("b"))
    to = components(links).select(F.col("id").alias("cluster_id"), F.col("component").alias("merged_id"))
    return relabel(labels, to)


def relabel(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels with cluster_id replaced by merged_id where merges (cluster_id, merged_id) names it."""
    return labels.join(merges, "cluster_id", "left").withColumn("cluster_id", F.coalesce("merged_id", "cluster_id")).drop("merged_id")


def mean_to_rest(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, id, n, mean_similarity) of every member to the others of its cluster; 1 for a single one."""
    s = _sums(vectors, labels)
    n = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    v = vectors.join(labels.select("id", "cluster_id"), "id")
    own = v.join(s, ["cluster_id", "term"]).groupBy("cluster_id", "id").agg(F.sum(F.col("w") * F.col("s")).alias("vs"), F.sum(F.col("w") * F.col("w")).alias("vv"))
    j = labels.select("id", "cluster_id").join(own, ["cluster_id", "id"], "left").join(n, "cluster_id")
    mean = (F.coalesce("vs", F.lit(0.0)) - F.coalesce("vv", F.lit(0.0))) / (F.col("n") - 1)
    return j.select("cluster_id", "id", "n", F.when(F.col("n") < 2, 1.0).otherwise(F.round(mean, 12)).alias("mean_similarity"))


def self_linkage(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, n, cohesion): mean similarity within; 1 for a single member."""
    m = mean_to_rest(vectors, labels)
    return m.groupBy("cluster_id").agg(F.first("n").alias("n"), F.avg("mean_similarity").alias("cohesion"))


def outlier_proposals(vectors: DataFrame, labels: DataFrame, max_mean: float, min_size: int = 2, rejected: DataFrame | None = None, locked: DataFrame | None = None, max_proposals: int = 0) -> DataFrame:
    """(cluster_id, id, n, mean_similarity, key): members whose mean similarity to the rest is below max_mean, weakest first, never leaving fewer than min_size."""
    if locked is not None:
        labels = labels.join(locked.select("cluster_id"), "cluster_id", "left_anti")
    m = mean_to_rest(vectors, labels).filter((F.col("n") > min_size) & (F.col("mean_similarity") < max_mean))
    m = m.withColumn("key", F.concat(F.lit("outlier:"), "cluster_id", F.lit(":"), F.col("id").cast("string")))
    if rejected is not None:
        m = m.join(rejected.select("key"), "key", "left_anti")
    w = W.partitionBy("cluster_id").orderBy("mean_similarity", "id")
    out = m.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.col("n") - min_size).select("cluster_id", "id", "n", "mean_similarity", "key").orderBy("mean_similarity", "key")
    return out.limit(max_proposals) if max_proposals else out


def apply_outliers(labels: DataFrame, accepted: DataFrame) -> DataFrame:
    hit = accepted.select("cluster_id", "id", F.concat("cluster_id", F.lit("~"), F.col("id").cast("string")).alias("new_id"))
    return labels.join(hit, ["cluster_id", "id"], "left").withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id")


def diameter_pairs(vectors: DataFrame, labels: DataFrame, salts: int = 32) -> DataFrame:
    """(cluster_id, pole_a, pole_b, similarity): the least similar pair of each cluster's members, the first in order of ids among equals.

    Exact, for weights of 0 and more: members are taken as queries in order of id, in blocks, against all later members of
    their cluster. Where a pair without a common term turns up, no later one can be less similar, which in a large cluster
    is so in the first block; only clusters without such a pair go on.
    """
    members = labels.select("cluster_id", "id")
    v = vectors.join(members, "id")
    todo = members.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id", F.lit(None).cast(labels.schema["id"].dataType).alias("last"), F.lit(0).cast("bigint").alias("seen"), "n")
    best, block, k = None, 1, 0
    while True:
        ahead = members.join(todo.select("cluster_id", "last"), "cluster_id").filter("last IS NULL OR id > last").select("cluster_id", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        some = ahead.withColumn("r", F.row_number().over(W.partitionBy("cluster_id", "salt").orderBy("id"))).filter(F.col("r") <= block)
        some = written(some.withColumn("r", F.row_number().over(W.partitionBy("cluster_id").orderBy("id"))).filter(F.col("r") <= block).select("cluster_id", F.col("id").alias("i")), f"diam-queries{k}")
        q = v.join(some.withColumnRenamed("i", "id"), ["cluster_id", "id"], "left_semi").select("cluster_id", "term", F.col("id").alias("i"), F.col("w").alias("qw"))
        dots = q.join(v.select("cluster_id", "term", F.col("id").alias("j"), "w"), ["cluster_id", "term"]).filter("j > i").groupBy("cluster_id", "i", "j").agg(F.sum(F.col("w") * F.col("qw")).alias("sim"))
        met = some.join(members.withColumnRenamed("id", "j"), "cluster_id").filter("j > i").join(dots, ["cluster_id", "i", "j"], "left")
        low = met.groupBy("cluster_id").agg(F.min(F.struct(F.round(F.coalesce("sim", F.lit(0.0)), 12).alias("similarity"), "i", "j")).alias("p"))
        best = low if best is None else best.unionByName(low).groupBy("cluster_id").agg(F.min("p").alias("p"))
        best = written(best, f"diam-best{k}")
        taken = some.groupBy("cluster_id").agg(F.max("i").alias("upto"), F.count("*").alias("got"))
        state = todo.join(taken, "cluster_id").join(best, "cluster_id").filter((F.col("p.similarity") > 0) & (F.col("seen") + F.col("got") < F.col("n") - 1))
        todo = written(state.select("cluster_id", F.col("upto").alias("last"), (F.col("seen") + F.col("got")).alias("seen"), "n"), f"diam-todo{k}")
        if todo.isEmpty():
            return best.select("cluster_id", F.col("p.i").alias("pole_a"), F.col("p.j").alias("pole_b"), F.col("p.similarity").alias("similarity"))
        block, k = block * 8, k + 1


def split_proposals(vectors: DataFrame, labels: DataFrame, threshold: float, min_group: int = 2, min_gain: float = 0.05, rejected: DataFrame | None = None, locked: DataFrame | None = None, max_proposals: int = 0) -> DataFrame:
    """(cluster_id, id, side, cross, within_a, within_b, key): clusters that fall into two parts, with their members' sides.

    The parts grow around the least similar pair of members; ties go to the first. A split is proposed if the linkage
    between the parts is below threshold and both are more cohesive than it by min_gain. Side a holds the smallest id. The
    key names the cluster and digests of both sides, so it stays short whatever their size. max_proposals keeps the splits
    with the lowest linkage, equal ones by key.
    """
    if locked is not None:
        labels = labels.join(locked.select("cluster_id"), "cluster_id", "left_anti")
    large = labels.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * min_group).select("cluster_id")
    labels = labels.join(large, "cluster_id", "left_semi")
    poles = diameter_pairs(vectors, labels)
    v = vectors.join(labels.select("id", "cluster_id"), "id")

    def to_pole(pole: str, name: str) -> DataFrame:
        p = v.join(poles.select("cluster_id", F.col(pole).alias("id")), ["cluster_id", "id"], "left_semi").select("cluster_id", "term", F.col("w").alias("pw"))
        dots = v.join(p, ["cluster_id", "term"]).groupBy("cluster_id", "id").agg(F.sum(F.col("w") * F.col("pw")).alias(name))
        return labels.select("cluster_id", "id").join(dots, ["cluster_id", "id"], "left").withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 12))

    sides = to_pole("pole_a", "to_a").join(to_pole("pole_b", "to_b"), ["cluster_id", "id"]).withColumn("side", F.when(F.col("to_a") >= F.col("to_b"), "a").otherwise("b"))
    flip = sides.groupBy("cluster_id").agg(F.min_by("side", "id").alias("first"))
    sides = written(sides.join(flip, "cluster_id").select("cluster_id", "id", F.when(F.col("side") == F.col("first"), "a").otherwise("b").alias("side")), "split-sides")
    part = sides.select("id", "cluster_id", "side", F.concat("cluster_id", F.lit("\u0000"), "side").alias("part"))
    inner = self_linkage(vectors, part.select("id", F.col("part").alias("cluster_id")))
    inner = inner.select(F.split("cluster_id", "\u0000").alias("p"), "n", "cohesion").select(F.col("p")[0].alias("cluster_id"), F.col("p")[1].alias("side"), "n", "cohesion")
    two = inner.groupBy("cluster_id").agg(*[F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{c}_{x}") for x in "ab" for c in ("n", "cohesion")])
    s = vectors.join(part, "id").groupBy("cluster_id", "side", "term").agg(F.sum("w").alias("s"))
    cross = s.groupBy("cluster_id", "term").agg(F.max(F.when(F.col("side") == "a", F.col("s"))).alias("x"), F.max(F.when(F.col("side") == "b", F.col("s"))).alias("y")).groupBy("cluster_id").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("dot"))
    digest = sides.groupBy("cluster_id").agg(*[F.hex(F.coalesce(F.bit_xor(F.when(F.col("side") == x, F.xxhash64("id"))), F.lit(0))).alias(f"d{x}") for x in "ab"])
    ok = two.join(cross, "cluster_id").join(digest, "cluster_id").withColumn("cross", F.round(F.col("dot") / (F.col("n_a") * F.col("n_b")), 12)).filter(
        (F.col("n_a") >= min_group) & (F.col("n_b") >= min_group) & (F.col("cross") < threshold) & (F.least("cohesion_a", "cohesion_b") >= F.col("cross") + min_gain))
    ok = ok.select("cluster_id", "cross", F.col("cohesion_a").alias("within_a"), F.col("cohesion_b").alias("within_b"), F.concat(F.lit("split:"), "cluster_id", F.lit(":"), "da", F.lit("|"), "db").alias("key"))
    if rejected is not None:
        ok = ok.join(rejected.select("key"), "key", "left_anti")
    if max_proposals:
        ok = ok.orderBy("cross", "key").limit(max_proposals)
    return sides.join(ok, "cluster_id").select("cluster_id", "id", "side", "cross", "within_a", "within_b", "key")


def apply_splits(labels: DataFrame, accepted: DataFrame) -> DataFrame:
    """Side b of each accepted split gets a suffix; several splits of one cluster get b, c, … in order of their keys. Records not named keep their label."""
    turn = accepted.select("cluster_id", "key").distinct().withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("key")))
    suffix = F.concat("cluster_id", F.char(F.lit(ord("a")) + F.col("k")))
    hit = accepted.filter("side = 'b'").join(turn, ["cluster_id", "key"]).groupBy("cluster_id", "id").agg(F.max_by(suffix, "k").alias("new_id"))
    return labels.join(hit, ["cluster_id", "id"], "left").withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id")
