"""The ranked, explained list of issues: cluster, consolidate, rank, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions import bags
from feedloom.operators import clustering, consolidate, mean_linkage, rank, vectors
from feedloom.runtime import maybe_broadcast, written


def kind_histogram(members: DataFrame) -> DataFrame:
    n = members.groupBy("cluster_id", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("kind", F.lit("")).alias("k"), "n")))).alias("kinds"))


def top_route(members: DataFrame) -> DataFrame:
    """(cluster_id, route, share) among members with a route; the smaller name among equals."""
    n = members.filter("route IS NOT NULL").groupBy("cluster_id", "route").agg(F.count("*").alias("n"))
    best = n.groupBy("cluster_id").agg(F.min_by("route", F.struct(-F.col("n"), F.col("route"))).alias("route"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.select("cluster_id", "route", (F.col("most") / F.col("all")).alias("share"))


def quotes(members: DataFrame, medoids: DataFrame | None = None, limit: int = 3, salts: int = 32) -> DataFrame:
    """(cluster_id, k, id): the medoid, then the latest, then by id. Salted first, so a hot cluster is never one task's sort."""
    m = members.withColumn("label", F.lit(0)) if medoids is None else members.join(medoids.select("id", F.lit(1).alias("label")), "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    order = [F.desc("label"), F.desc("client_ts"), F.asc("id")]
    part = m.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    part = part.withColumn("k", F.row_number().over(W.partitionBy("cluster_id", "salt").orderBy(*order))).filter(F.col("k") <= limit)
    return part.withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order))).filter(F.col("k") <= limit).select("cluster_id", "k", "id")


def unassigned(submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    return submissions.join(assignments.select("project_id", "id"), ["project_id", "id"], "left_anti")


def evidence(submissions: DataFrame, members: DataFrame) -> DataFrame:
    return submissions.join(members.select("id"), "id", "left_semi")


def build_issues(submissions: DataFrame, now: str, *, threshold: float = 0.25, merge: float = 0.1, limit: int | None = None, n_quotes: int = 3, assignments: DataFrame | None = None) -> DataFrame:
    """(issue_id, title, score, components, explanation, kinds, top_route, quotes) of submissions of any projects, best first.

    assignments (project_id, id, cluster_id) are kept where given; the rest is clustered. Excluded kinds shape the
    clusters but neither rank nor title them. limit is the length of the list.
    """
    beside = ("user_id", "kind", "client_ts", "mrr", "route", "terms", "tf")
    docs = bags.token_bags(submissions.withColumn("seq", F.col("ingest_seq")), "id", "cluster_text", "project_id", "seq", *beside[:-2])
    if assignments is None:
        labelled = clustering.leader_follower(docs, threshold=threshold, beside=beside).drop("similarity")
    else:
        docs = written(docs, "iss-docs")
        fresh = clustering.leader_follower(unassigned(docs, assignments), threshold=threshold, beside=beside).drop("similarity").withColumn("cluster_id", F.concat(F.lit("u:"), "cluster_id"))
        labelled = fresh.unionByName(docs.join(assignments.select("project_id", "id", "cluster_id"), ["project_id", "id"]))
    labelled = written(labelled.withColumn("cluster_id", F.concat_ws("/", "project_id", "cluster_id")), "iss-labels")

    own = ["id", "cluster_id", "seq", *beside[:-2]]
    n_docs = labelled.count() if assignments is None else docs.count()
    vecs = written(vectors.bag_vectors(labelled, n_docs, *own, empty=True), "iss-vectors")
    merges = mean_linkage.consolidate_means(vecs.filter("size(tids) > 0"), merge) if merge > 0 else consolidate.consolidate(vecs, vecs, merge)
    vecs = consolidate.relabel(vecs, maybe_broadcast(written(merges, "iss-merges")))
    members = vecs.drop("tids", "ws")

    ranked = rank.rank(members.select("cluster_id", "user_id", "kind", "client_ts", "mrr", "seq"), now)
    ranked = written(ranked.limit(limit) if limit else ranked, "iss-ranked")
    kept = maybe_broadcast(ranked.select("cluster_id"))
    shown, seen = (x.filter(F.col("kind").isNull() | ~F.col("kind").isin(*rank.EXCLUDED_KINDS)).join(kept, "cluster_id", "left_semi") for x in (members, vecs))
    med = written(vectors.bag_medoids(seen, "id"), "iss-medoids")
    texts = submissions.select("id", "body")
    q = maybe_broadcast(written(quotes(shown, maybe_broadcast(med), n_quotes), "iss-quotes")).join(texts, "id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "body"))).alias("quotes"))
    title = maybe_broadcast(med).join(texts, "id").select("cluster_id", F.col("id").alias("medoid_id"), F.col("body").alias("title"))
    return (
        ranked.withColumn("explanation", rank.explain()).join(title, "cluster_id", "left").join(kind_histogram(shown), "cluster_id", "left")
        .join(top_route(shown).select("cluster_id", F.col("route").alias("top_route"), F.col("share").alias("route_share")), "cluster_id", "left").join(q, "cluster_id", "left")
        .withColumnRenamed("cluster_id", "issue_id").orderBy(F.desc("score"), "issue_id")
    )
