"""Queries of the text problems and their SQL, where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import issues_by_text, leaks, mixing, neardup, pii, spam
from feedloom.runtime import maybe_broadcast, table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(src, rec_id, text) of submissions and inbox, one row per record: repeated deliveries carry the same facts."""
    s = table(spark, sf, "submissions").select(F.lit("submissions").alias("src"), F.col("id").alias("rec_id"), F.col("body").alias("text"))
    i = table(spark, sf, "inbox").select(F.lit("inbox").alias("src"), F.col("ticket_id").alias("rec_id"), F.col("description").alias("text"))
    return s.unionByName(i)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """(src, rec_id, text), one row per record: the first delivery of a submission, any of a ticket's exports.

    Only ids and sequence numbers are grouped; the texts of the submissions are not shuffled.
    """
    s = table(spark, sf, "submissions").filter("id IS NOT NULL")
    keys = s.select("id", "ingest_seq")
    again = keys.groupBy("id").agg(F.min("ingest_seq").alias("first"), F.count("*").alias("n")).filter("n > 1").select("id", "first")
    extra = keys.join(maybe_broadcast(again), "id").filter("ingest_seq <> first").select("ingest_seq")
    once = s.join(maybe_broadcast(extra), "ingest_seq", "left_anti").select(F.lit("submissions").alias("src"), F.col("id").alias("rec_id"), F.col("body").alias("text"))
    i = table(spark, sf, "inbox").filter("ticket_id IS NOT NULL").groupBy(F.col("ticket_id").alias("rec_id")).agg(F.min("description").alias("text"))
    return once.unionByName(i.select(F.lit("inbox").alias("src"), "rec_id", "text"))


#: Key of the pseudonyms in this demonstration; a deployment passes its own.
DEMO_KEY = b"feedloom demonstration key"


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item that p2_redacted replaces."""
    texts = _texts(spark, sf)
    return pii.items(texts, ["src", "rec_id"], "text", DEMO_KEY, pii.learn_given(texts, "text")).select("src", "rec_id", "pii_kind", "nth").distinct()


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """How often each pseudonym stands for a value, over all texts: equal values are linked across documents."""
    texts = _records(spark, sf)
    found = pii.items(texts, ["src", "rec_id"], "text", DEMO_KEY, pii.learn_given(texts, "text"))
    return found.groupBy("pii_kind", "pseudonym").agg(F.count("*").alias("n"), F.count_distinct("src", "rec_id").alias("records"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders and format-preserving pseudonyms."""
    texts = _records(spark, sf)
    return pii.with_redacted(texts, "text", DEMO_KEY, pii.learn_given(texts, "text")).select("src", "rec_id", "redacted")


def _one_text(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select(F.col("rec_id").alias("rec"), "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.similar_pairs(_one_text(spark, sf))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its near-duplicate group and number of links."""
    return neardup.groups(_one_text(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    label = issues_by_text.clusters(_one_text(spark, sf)).filter("cluster IS NOT NULL").select("rec", "cluster")
    probe = table(spark, sf, "cluster_probe").select("rec_a", "rec_b")
    a = label.withColumnsRenamed({"rec": "rec_a", "cluster": "ca"})
    b = label.withColumnsRenamed({"rec": "rec_b", "cluster": "cb"})
    return probe.join(a, "rec_a").join(b, "rec_b").filter("ca = cb").select("rec_a", "rec_b").distinct()


def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its size and most typical members."""
    records = _one_text(spark, sf)
    return issues_by_text.summary(issues_by_text.clusters(records), records)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf, "documents"))
    return mixing.supplies(sized, table(spark, sf, "mix_targets")).filter("short").select("source")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    sized = mixing.sizes(table(spark, sf, "documents"))
    return mixing.mixture(sized, mixing.plan(sized, table(spark, sf, "mix_targets")))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    sized = mixing.sizes(table(spark, sf, "documents"))
    return mixing.shares(mixing.plan(sized, table(spark, sf, "mix_targets")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf, "documents"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each page's words that stand in keyword, link and tag passages."""
    return spam.page_scores(table(spark, sf, "documents")).select("doc_id", "n_words", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_items, p2_redacted, p3_found, p3_groups, p6_found, p6_clusters, p7_found, p8_found, p8_mixture, p8_shares, p9_found, p9_scores)}

_RECORDS = """r AS (SELECT id AS rec, body AS text FROM submissions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1 UNION ALL SELECT ticket_id, min(description) FROM inbox WHERE ticket_id IS NOT NULL GROUP BY 1)"""

SQL = {
    # words ordered by rarity; two sets that share four fifths of their union share a word of their first n - ceil(0.8 n) + 1
    "p3_found": f"""WITH {_RECORDS}, s AS (SELECT rec, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM r), k AS (SELECT rec, ws, len(ws) AS n FROM s WHERE len(ws) >= 20),
        w AS (SELECT rec, n, unnest(ws) AS w FROM k), df AS (SELECT w, count(*) AS df FROM w GROUP BY 1), p AS (SELECT rec, n, w FROM (SELECT rec, n, w, row_number() OVER (PARTITION BY rec ORDER BY df, w) AS pos FROM w JOIN df USING (w)) WHERE pos <= n - (4 * n + 4) // 5 + 1),
        c AS (SELECT DISTINCT x.rec AS a, y.rec AS b FROM p x JOIN p y ON x.w = y.w AND x.rec < y.rec AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n)
        SELECT a AS rec_a, b AS rec_b FROM c JOIN k x ON x.rec = a JOIN k y ON y.rec = b WHERE 5 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))""",
    # the margins are wide: characters stand for tokens
    "p8_found": """WITH u AS (SELECT source, sum(n) AS supply FROM (SELECT DISTINCT source, text, len(text) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) GROUP BY 1)
        SELECT source FROM mix_targets LEFT JOIN u USING (source) WHERE coalesce(target_share, 0) * (SELECT sum(len(text)) FROM documents) > coalesce(supply, 0) * greatest(coalesce(max_repeats, 1), 0)""",
    "p7_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#x?[0-9A-Fa-f]{1,6});', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
        ds AS (SELECT doc_id, array_to_string(w[k:k+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
        s AS (SELECT item_id, array_to_string(w[k:k+12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM ds JOIN s USING (s)""",
}
