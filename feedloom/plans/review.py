"""Queries of ingest, evaluation, review and client operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import scalars, text
from feedloom.operators import bursts, clustering, corpus, embed, exceptions, issues, logs, metrics, queues, rank, reports
from feedloom.plans import feedback as fb
from feedloom.plans.feedback import _FACTS, _MEMBERS, NOW, r6
from feedloom.runtime import table, written
from feedloom.sources import envelopes, inbound, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- ingest ---


@query("SELECT count(*) AS total, count(DISTINCT project_id || '|' || id) AS inserted, count(*) - count(DISTINCT project_id || '|' || id) AS duplicate FROM submissions")
def import_result(spark, sf):
    """What an import of all deliveries into an empty store reports."""
    s = table(spark, sf, "submissions").drop("ingest_seq")
    return inbound.imported(s, s.limit(0))[1]


@query("SELECT DISTINCT s.project_id, s.id FROM submissions s WHERE NOT EXISTS (SELECT 1 FROM cluster_probe p WHERE p.rec_a = s.id)")
def import_accepted(spark, sf):
    """The keys an import adds to a store that holds some of them."""
    s = table(spark, sf, "submissions").drop("ingest_seq")
    stored = s.join(table(spark, sf, "cluster_probe").select(F.col("rec_a").alias("id")), "id", "left_semi")
    return inbound.imported(s, stored)[0].select("project_id", "id")


@query(f"WITH {_FACTS} SELECT project_id, id, ingest_seq FROM facts WHERE body IS NOT NULL AND kind IS NOT NULL AND source IS NOT NULL AND cluster_text IS NOT NULL AND user_id IS NOT NULL AND client_ts IS NOT NULL")
def log_replay(spark, sf):
    return inbound.replay(table(spark, sf, "submissions")).select("project_id", "id", "ingest_seq")


def _lines(spark, sf) -> DataFrame:
    """Facts as envelopes of one event; some of another version, some cut off."""
    f = fb.facts(spark, sf)
    event = F.struct(
        "id", "kind", "source", F.date_format("client_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("clientTs"), "body", F.struct(F.when(F.col("attributed"), F.substring_index("user_id", ":", -1)).alias("externalId")).alias("user"),
        F.struct("route", F.col("app_version").alias("appVersion"), "platform").alias("context"))
    line = F.to_json(F.struct(F.when(F.col("ingest_seq") % 7 == 0, 9).otherwise(0).alias("v"), F.col("project_id").alias("project"), F.array(event).alias("events")))
    return f.select(F.when(F.col("ingest_seq") % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query(f"WITH {_FACTS} SELECT id, project_id, kind, source, coalesce(body, '') AS body, route, app_version, platform, epoch_ms(client_ts) AS client_ms FROM facts WHERE ingest_seq % 7 <> 0 AND ingest_seq % 11 <> 0")
def envelope_events(spark, sf):
    e = envelopes.to_submissions(envelopes.parse(_lines(spark, sf)))
    return e.select("id", "project_id", "kind", "source", "body", "route", "app_version", "platform", F.unix_millis("client_ts").alias("client_ms"))


@query(f"WITH {_FACTS}, r AS (SELECT CASE WHEN ingest_seq % 11 = 0 THEN 'malformed' WHEN ingest_seq % 7 = 0 THEN 'version' ELSE 'good' END AS reason FROM facts) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def envelope_reasons(spark, sf):
    return envelopes.parse(_lines(spark, sf)).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_FACTS} SELECT id, project_id, CASE WHEN attributed THEN 'u:' || string_split(user_id, ':')[-1] ELSE 'r:' || id END AS user_id, attributed FROM facts")
def identity_guard(spark, sf):
    """External id, else the fallback of the policy, unattributed."""
    f = fb.facts(spark, sf)
    who = scalars.resolve_user(F.when(F.col("attributed"), F.substring_index("user_id", ":", -1)), F.lit(None).cast("string"), scalars.fallback_key("per-record", F.col("id"), F.col("client_ts")))
    return f.select("id", "project_id", who.alias("u")).select("id", "project_id", "u.user_id", "u.attributed")


@query("SELECT DISTINCT ticket_id, nullif(trim(page), '') AS page, nullif(trim(type), '') AS type, lower(trim(type)) IN ('feature_request', 'bug', 'praise', 'question', 'rage') AS known FROM inbox")
def empty_to_absent(spark, sf):
    from feedloom.schema import KINDS

    i = table(spark, sf, "inbox")
    return i.select("ticket_id", scalars.empty_to_null(F.col("page")).alias("page"), scalars.empty_to_null(F.col("type")).alias("type"), F.lower(F.trim("type")).isin(*KINDS).alias("known")).distinct()


_STACKED = "(SELECT id, project_id, client_ts, coalesce(kind, 'none') AS kind, coalesce(platform, 'web') AS platform, coalesce(route, '/') AS route FROM facts)"


def _stacked(spark, sf) -> DataFrame:
    """Every fact as an exception thrown in a function of its kind, in a file of its platform; the second frame has no name, the third is the runtime's."""
    f = fb.facts(spark, sf).select("id", "project_id", "client_ts", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("platform", F.lit("web")).alias("platform"))
    stack = F.format_string("TypeError: x\n    at %s (/srv/app/%s.js?v=3:10:5)\n    at C:\\app\\main.js:7:1\n    at node:internal/timers:2:3\n    at native", "kind", "platform")
    return f.withColumn("name", F.lit("TypeError")).withColumn("message", F.lit("x")).withColumn("stack", stack)


@query(f"WITH {_FACTS} SELECT id, project_id, kind || '@' || platform || '.js,<anonymous>@main.js' AS frames FROM {_STACKED}")
def stack_frames(spark, sf):
    shown = F.array_join(F.transform(exceptions.frames(F.col("stack")), lambda f: F.concat(f["fn"], F.lit("@"), f["file"])), ",")
    return _stacked(spark, sf).select("id", "project_id", shown.alias("frames"))


@query(f"""WITH {_FACTS}, e AS (SELECT *, 'ex_' || substr(sha256('TypeError' || chr(0) || kind || '@' || platform || '.js' || chr(0) || '<anonymous>@main.js'), 1, 16) AS fp FROM {_STACKED})
  SELECT id, project_id, fp AS fingerprint, 'TypeError: x ' || kind || ' ' || platform || '.js <anonymous> main.js' AS cluster_text, 'x:' || fp || ':' || strftime(client_ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS fallback FROM e""")
def stack_fingerprints(spark, sf):
    e = _stacked(spark, sf)
    fp = exceptions.fingerprint(F.col("name"), F.col("message"), F.col("stack"))
    return e.select("id", "project_id", fp.alias("fingerprint"), exceptions.cluster_text(F.col("name"), F.col("message"), F.col("stack")).alias("cluster_text"), exceptions.fallback_user(fp, F.col("client_ts")).alias("fallback"))


@query(f"WITH {_FACTS} SELECT 'bug' AS kind, 'api' AS source, true AS thrown, count(*) AS n FROM facts UNION ALL SELECT kind, source, false, count(*) FROM facts WHERE ingest_seq % 7 <> 0 AND ingest_seq % 11 <> 0 GROUP BY 1, 2")
def inbound_union(spark, sf):
    """Exceptions and envelopes as one type of record, counted."""
    thrown = _stacked(spark, sf).withColumn("user_id", F.lit(None).cast("string")).drop("id")
    bugs = inbound.exceptions_as_submissions(thrown, "").withColumn("project_id", F.lit(None).cast("string"))
    sent = envelopes.to_submissions(envelopes.parse(_lines(spark, sf)))
    both = inbound.union(bugs, sent)
    return both.groupBy("kind", "source", F.col("fingerprint").isNotNull().alias("thrown")).agg(F.count("*").alias("n"))


@query(f"WITH {_FACTS} SELECT id, project_id, CASE WHEN regexp_matches(coalesce(body, ''), '[\",\\n]') THEN '\"' || replace(body, '\"', '\"\"') || '\"' ELSE coalesce(body, '') END AS field FROM facts")
def csv_fields(spark, sf):
    return fb.facts(spark, sf).select("id", "project_id", scalars.csv_field(F.col("body")).alias("field"))


@query(f"""WITH {_FACTS}, l AS (SELECT id, project_id, CASE kind WHEN 'bug' THEN 'error' WHEN 'rage' THEN 'warn' WHEN 'praise' THEN 'debug' ELSE 'info' END AS level, CASE WHEN len(body) <= 512 THEN body ELSE substr(body, 1, 512) || '…[+' || (len(body) - 512) || ']' END AS message FROM facts)
  SELECT id, project_id, level, {fb._redacted_sql('coalesce(message, \'\')')} AS message FROM l WHERE level IN ('warn', 'error')""")
def log_lines(spark, sf):
    level = F.when(F.col("kind") == "bug", "error").when(F.col("kind") == "rage", "warn").when(F.col("kind") == "praise", "debug").otherwise("info")
    return logs.emitted(fb.facts(spark, sf).select("id", "project_id", level.alias("level"), F.col("body").alias("message")), "warn")


# --- client queues ---


def _outbox(spark, sf) -> DataFrame:
    return table(spark, sf, "submissions").select(F.col("user_id").alias("client"), F.col("ingest_seq").alias("seq"), F.coalesce("body", F.lit("")).alias("payload"), F.when(F.col("ingest_seq") % 3 == 0, F.col("id")).alias("capture_ref"))


_BOX = "box AS (SELECT user_id AS client, ingest_seq AS seq, coalesce(body, '') AS payload, CASE WHEN ingest_seq % 3 = 0 THEN id END AS capture_ref FROM submissions)"


@query(f"""WITH {_BOX}, w AS (SELECT *, count(*) OVER (PARTITION BY client) AS all_n, sum(len(payload) + len(coalesce(capture_ref, ''))) OVER (PARTITION BY client) AS all_b FROM box),
  l AS (SELECT client, seq, payload, CASE WHEN all_n <= 20 AND all_b <= 8000 THEN capture_ref END AS capture_ref FROM w),
  k AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY seq DESC) AS k, sum(len(payload) + len(coalesce(capture_ref, ''))) OVER (PARTITION BY client ORDER BY seq DESC) AS upto FROM l) SELECT client, seq, payload, capture_ref FROM k WHERE k <= 20 AND upto <= 8000""")
def offline_queue(spark, sf):
    return queues.bounded(_outbox(spark, sf), 20, 8000)


@query(f"WITH {_BOX} SELECT client, seq FROM box QUALIFY row_number() OVER (PARTITION BY client ORDER BY seq) <= 3")
def queue_peek(spark, sf):
    return queues.peek(_outbox(spark, sf), 3).select("client", "seq")


@query(f"""WITH {_BOX}, b AS (SELECT client, seq, ((row_number() OVER (PARTITION BY client ORDER BY seq) - 1) // 20)::INT AS batch FROM box), g AS (SELECT client, batch, count(*) AS size, min(seq) AS first FROM b GROUP BY 1, 2),
  a AS (SELECT *, CASE first % 9 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 413 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN NULL WHEN 7 THEN 204 ELSE 413 END AS status, (first % 5)::INT AS attempt, first % 9 = 8 AS stripped FROM g)
  SELECT client, batch, size, CASE WHEN status BETWEEN 200 AND 299 THEN 'acknowledge' WHEN status = 401 THEN 'disable' WHEN status = 413 AND NOT stripped THEN 'strip' WHEN status = 413 AND size > 1 THEN 'halve' WHEN status = 413 THEN 'drop' WHEN status = 400 THEN 'drop'
    WHEN attempt >= 4 THEN 'keep' WHEN status = 429 THEN 'wait' ELSE 'retry' END AS action FROM a""")
def transport_flush(spark, sf):
    """Batches of every client and what it does after an answer."""
    g = queues.batches(_outbox(spark, sf)).groupBy("client", "batch").agg(F.count("*").alias("size"), F.min("seq").alias("first"))
    codes = F.array(*[F.lit(c).cast("int") for c in (200, 400, 401, 413, 429, 503, None, 204, 413)])
    status = F.element_at(codes, (F.col("first") % 9 + 1).cast("int"))
    return g.select("client", "batch", "size", queues.flush_action(status, (F.col("first") % 5).cast("int"), F.col("first") % 9 == 8, F.col("size")).alias("action"))


@query("""WITH s AS (SELECT user_id::VARCHAR AS session, epoch_us(ts) // 1000 AS at_ms, event_id, sign(value - 50) AS d FROM events WHERE value <> 50), l AS (SELECT *, lag(d) OVER (PARTITION BY session ORDER BY at_ms, event_id) AS p FROM s) SELECT session, at_ms FROM l WHERE p <> d""")
def scroll_reversals(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.lit("scroll").alias("kind"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), (F.col("value") - 50).alias("delta"), F.col("event_id").alias("seq"))
    return bursts.reversals(e)


@query("""SELECT user_id::VARCHAR AS session, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) <= 20""")
def tracker_ring(spark, sf):
    """The last twenty events of each session, which is what a tracker of that size holds."""
    return bursts.latest(fb._ui_events(spark, sf), 20).select("session", "seq")


@query("""WITH t AS (SELECT DISTINCT id, body AS text FROM submissions WHERE body IS NOT NULL), c AS (SELECT DISTINCT description AS text FROM inbox UNION SELECT DISTINCT body FROM submissions WHERE ingest_seq % 3 = 0),
  p AS (SELECT text, count(*) AS n, text IN (SELECT text FROM c WHERE text IS NOT NULL) AS known FROM t GROUP BY 1) SELECT coalesce(sum(n) FILTER (known), 0)::BIGINT AS hits, count(*) FILTER (NOT known) AS misses, coalesce(sum(n - 1) FILTER (NOT known), 0)::BIGINT AS deduped FROM p""")
def embedding_cache_statistics(spark, sf):
    s = table(spark, sf, "submissions")
    known = table(spark, sf, "inbox").select(F.col("description").alias("text")).unionByName(s.filter(F.col("ingest_seq") % 3 == 0).select(F.col("body").alias("text"))).filter("text IS NOT NULL").distinct()
    return embed.cache_statistics(s.select("id", F.col("body").alias("text")).distinct(), known.select(F.lit("m").alias("model"), "text", F.array(F.lit(1.0)).alias("vector")), "m")


@query("SELECT DISTINCT ticket_id, 2 AS vectors, 0.6::DOUBLE AS first FROM inbox")
def embedding_answers(spark, sf):
    """Answers of an embeddings endpoint out of order: reordered, checked and scaled."""
    answer = F.lit('{"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}')
    t = table(spark, sf, "inbox").select("ticket_id").distinct().withColumn("v", embed.parse_response(F.concat(answer, F.lit("")), F.lit(2)))
    return t.select("ticket_id", F.size("v").alias("vectors"), r6(F.element_at(F.element_at("v", 1), 1)).alias("first"))


# --- evaluation ---


@query(f"WITH {_FACTS} SELECT 'one' AS baseline, count(*) AS items, 1 AS labels FROM facts UNION ALL SELECT 'singletons', count(*), count(DISTINCT project_id || '|' || id) FROM facts")
def trivial_baselines(spark, sf):
    ids = fb.facts(spark, sf).select(F.concat_ws("|", "project_id", "id").alias("id"))
    said = clustering.all_one(ids).withColumn("baseline", F.lit("one")).unionByName(clustering.all_singletons(ids).withColumn("baseline", F.lit("singletons")))
    return said.groupBy("baseline").agg(F.count("*").alias("items"), F.count_distinct("label").cast("int").alias("labels"))


_WORDS = f"list_filter(string_split({fb._NORM.format('body')}, ' '), lambda x: len(x) >= 3 AND x NOT IN ({fb._STOPS}))"


@query(f"""WITH {_FACTS} SELECT id, project_id, 'st:' || coalesce(platform, '') || '|' || coalesce(route, '') || '|' || coalesce(app_version, '') || '|' || floor(epoch_us(client_ts) / (7 * 86400e6))::BIGINT || '|'
  || coalesce(list_reduce(list_prepend('', {_WORDS}), lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END), '') AS label FROM facts""")
def structural_token_baseline(spark, sf):
    c = F.col
    return fb.facts(spark, sf).select("id", "project_id", clustering.structural_token(c("platform"), c("route"), c("app_version"), c("client_ts"), c("body")).alias("label"))


def _evaluation_sql(where: str) -> str:
    return fb._AGG.replace("FROM facts)", f"FROM facts WHERE {where})", 1) + """, m AS (SELECT (tpp - tp * pp / (n * (n - 1) / 2)) / ((tp + pp) / 2 - tp * pp / (n * (n - 1) / 2)) AS ari, tpp / pp AS p, tpp / tp AS r FROM a),
  s AS (SELECT sum(n)::DOUBLE AS n FROM t), ht AS (SELECT -sum(x / s.n * ln(x / s.n)) AS h FROM (SELECT sum(n) AS x FROM t GROUP BY truth), s), hp AS (SELECT -sum(x / s.n * ln(x / s.n)) AS h FROM (SELECT sum(n) AS x FROM t GROUP BY predicted), s),
  j AS (SELECT -sum(t.n / s.n * ln(t.n / s.n)) AS h FROM t, s), v AS (SELECT 1 - (j.h - hp.h) / ht.h AS ho, 1 - (j.h - ht.h) / hp.h AS co FROM ht, hp, j)
  SELECT (SELECT sum(n) FROM t)::BIGINT AS items, (SELECT count(DISTINCT truth) FROM t) AS true_clusters, (SELECT count(DISTINCT predicted) FROM t) AS predicted_clusters, round(ari, 6) AS ari, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1,
    round(ho, 6) AS homogeneity, round(co, 6) AS completeness, round(2 * ho * co / (ho + co), 6) AS v FROM m, v"""


_METRICS = ("ari", "precision", "recall", "f1", "homogeneity", "completeness", "v")


@query(f"WITH {_evaluation_sql('true')}")
def evaluate_labels(spark, sf):
    return corpus.evaluate(fb._pairs(spark, sf)).select("items", "true_clusters", "predicted_clusters", *[r6(c).alias(c) for c in _METRICS])


@query(f"WITH {_evaluation_sql(chr(39).join(['source = ', 'support_inbox', '']))}")
def evaluate_slice(spark, sf):
    """All metrics on the records of one source only."""
    f = fb.facts(spark, sf).filter("source = 'support_inbox'")
    return corpus.evaluate(f.select(F.coalesce("route", F.lit("")).alias("truth"), F.col("kind").alias("predicted"))).select("items", "true_clusters", "predicted_clusters", *[r6(c).alias(c) for c in _METRICS])


@query(f"""WITH {_FACTS}, l AS (SELECT id, min(kind) AS label FROM facts GROUP BY 1), p AS (SELECT rec_a AS a, rec_b AS b, probe_id % 3 = 0 AS same, 'trap' || probe_id % 4 AS trap FROM cluster_probe), j AS (SELECT trap, same, x.label = y.label AS says FROM p JOIN l x ON x.id = a JOIN l y ON y.id = b)
  SELECT trap, count(*) AS pairs, count(*) FILTER (says = same) AS correct, count(*) FILTER (says AND NOT same) AS false_merges, count(*) FILTER (NOT says AND same) AS false_splits FROM j GROUP BY 1""")
def hard_pairs(spark, sf):
    labels = fb.facts(spark, sf).groupBy("id").agg(F.min("kind").alias("label"))
    pairs = table(spark, sf, "cluster_probe").select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"), (F.col("probe_id") % 3 == 0).alias("same"), F.concat(F.lit("trap"), (F.col("probe_id") % 4).cast("string")).alias("trap"))
    return metrics.hard_pairs(labels, pairs)


@query("""WITH i AS (SELECT id, coalesce(route, 'none') AS cluster, body FROM submissions), l AS (SELECT id, min(cluster) AS cluster, count(*) AS n FROM i GROUP BY 1), p AS (SELECT rec_a AS a, rec_b AS b, true AS same FROM cluster_probe),
  e AS (SELECT a, b, x.cluster AS ca, y.cluster AS cb, same FROM p LEFT JOIN l x ON x.id = a LEFT JOIN l y ON y.id = b), z AS (SELECT cluster, count(*) AS n FROM i GROUP BY 1)
  SELECT 'duplicate-id' AS code, id AS subject FROM l WHERE n > 1 UNION SELECT 'undeclared-cluster', id FROM i WHERE cluster = 'none' UNION SELECT 'empty-body', id FROM i WHERE trim(coalesce(body, '')) = '' UNION SELECT 'undersized-cluster', cluster FROM z WHERE n < 50
  UNION SELECT 'dangling-pair', a || '+' || b FROM e WHERE ca IS NULL OR cb IS NULL UNION SELECT 'pair-contradicts-labels', a || '+' || b FROM e WHERE ca <> cb""")
def corpus_integrity(spark, sf):
    s = table(spark, sf, "submissions")
    items = s.select("id", F.coalesce("route", F.lit("none")).alias("cluster"), "body", F.date_format("client_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("client_ts"))
    pairs = table(spark, sf, "cluster_probe").select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"), F.lit(True).alias("same"))
    return corpus.validate(items, s.filter("route IS NOT NULL").select(F.col("route").alias("id")).distinct(), pairs, 50)


# --- reports ---


def _clusters_by(spark, sf, *columns: str) -> DataFrame:
    f = fb.facts(spark, sf)
    return f.withColumn("cluster_id", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns])).withColumn("seq", F.col("ingest_seq"))


def _ranked_by(expression: str, name: str, label: str) -> str:
    ranked = fb._ranked_sql("100").replace("concat_ws('|', project_id, coalesce(route, ''))", expression)
    return f"(WITH {ranked} SELECT cluster_id AS {label}, row_number() OVER (ORDER BY round(score, 9) DESC, cluster_id) AS {name} FROM ranked)"


_TRUTH, _SAID = "concat_ws('|', project_id, coalesce(route, ''))", "concat_ws('|', project_id, coalesce(platform, ''), coalesce(route, ''))"
_AGREE = f"""WITH {_FACTS}, t AS (SELECT {_TRUTH} AS truth, {_SAID} AS predicted, count(*) AS n FROM facts GROUP BY 1, 2), tr AS {_ranked_by(_TRUTH, 'k', 'truth')}, pr AS {_ranked_by(_SAID, 'k', 'predicted')},
  major AS (SELECT predicted, truth FROM t QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY n DESC, truth) = 1)"""


def _positions(spark, sf, *columns: str) -> DataFrame:
    ranked = rank.rank(_clusters_by(spark, sf, *columns), NOW).withColumn("score", F.round("score", 9))
    return rank.positions(ranked).select(F.col("cluster_id").alias("label"), "position")


def _table(spark, sf) -> DataFrame:
    said = lambda *cs: F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cs])
    return metrics.contingency(fb.facts(spark, sf).select(said("project_id", "route").alias("truth"), said("project_id", "platform", "route").alias("predicted")))


@query(f"""{_AGREE}, seen AS (SELECT predicted FROM pr WHERE k <= 10), top AS (SELECT truth FROM tr WHERE k <= 10), named AS (SELECT DISTINCT truth FROM major JOIN seen USING (predicted)),
  size AS (SELECT truth, sum(n) AS size FROM t GROUP BY 1), best AS (SELECT truth, max(n) AS best FROM t JOIN seen USING (predicted) GROUP BY 1)
  SELECT count(named.truth) AS hits, round(count(named.truth) / count(*), 6) AS recall, round(avg(coalesce(best / size, 0)), 6) AS capture FROM top LEFT JOIN named USING (truth) LEFT JOIN size USING (truth) LEFT JOIN best USING (truth)""")
def rank_agreement(spark, sf):
    """Agreement of the ranked top ten of true and predicted clusters."""
    a = metrics.top_k_agreement(_table(spark, sf), _positions(spark, sf, "project_id", "route"), _positions(spark, sf, "project_id", "platform", "route"), 10)
    return a.select("hits", r6("recall").alias("recall"), r6("capture").alias("capture"))


@query(f"{_AGREE} SELECT truth AS topic, count(*) AS rows FROM major JOIN pr USING (predicted) WHERE k <= 30 GROUP BY 1 HAVING count(*) > 1")
def fragmentation(spark, sf):
    """Topics that take more than one of the first thirty rows (a top-k report)."""
    return reports.fragmentation(_table(spark, sf), _positions(spark, sf, "project_id", "platform", "route"), 30)


@query(f"WITH {_MEMBERS} SELECT 'off' AS consolidation, count(*) AS issues, max(n) AS largest FROM (SELECT count(*) AS n FROM facts GROUP BY project_id, platform, route) UNION ALL SELECT 'on', count(*), max(n) FROM (SELECT count(*) AS n FROM members GROUP BY cluster_id)")
def consolidation_on_off(spark, sf):
    return reports.on_off(_clusters_by(spark, sf, "project_id", "platform", "route").select("id", "cluster_id"), _clusters_by(spark, sf, "project_id", "route").select("id", "cluster_id"))


@query(f"WITH {_MEMBERS}, i AS (SELECT DISTINCT cluster_id FROM members WHERE kind IS NULL OR kind <> 'praise') SELECT (SELECT count(*) FROM facts) AS submissions, (SELECT count(DISTINCT concat_ws('|', project_id, coalesce(platform, ''), coalesce(route, ''))) FROM facts) AS clusters, (SELECT count(*) FROM i) AS issues, least((SELECT count(*) FROM i), 10) AS top")
def issue_funnel(spark, sf):
    f = fb.facts(spark, sf).select("id")
    return reports.funnel(f, _clusters_by(spark, sf, "project_id", "platform", "route").select("cluster_id").distinct(), rank.rank(_clusters_by(spark, sf, "project_id", "route"), NOW).select("cluster_id"))


@query(f"SELECT w.cluster_id, w.weighted, f.flat, f.flat - w.weighted AS movement FROM {fb._list_sql('100', 'weighted')} w JOIN {fb._list_sql('1e12', 'flat')} f USING (cluster_id) WHERE weighted <= 10")
def top_movement(spark, sf):
    """Movement of the ten first rows (a top-k report) between weighted and unweighted ranks."""
    m = written(fb.members(spark, sf).select("cluster_id", "user_id", "kind", "client_ts", "mrr", "seq"), "mv")
    at = lambda b: rank.positions(rank.rank(m, NOW, baseline=b).withColumn("score", F.round("score", 9)))
    return reports.movement(at(100.0), at(1e12))


@query(f"SELECT k AS position, printf('%2d', k) || '. ' || cluster_id || ' (' || printf('%.2f', score) || '): ' || unique_users || ' users' AS line FROM (WITH {fb._ranked_sql('100')} SELECT cluster_id, score, unique_users, row_number() OVER (ORDER BY round(score, 9) DESC, cluster_id)::INT AS k FROM ranked) WHERE k <= 20")
def ranked_lines(spark, sf):
    """The first twenty rows of the list (a top-k report) as a reader sees them."""
    r = rank.positions(rank.rank(fb.members(spark, sf), NOW).withColumn("order", F.col("score")).withColumn("score", F.round("score", 9)))
    return reports.ranked_lines(r.withColumn("score", F.col("order")).withColumn("title", F.col("cluster_id")).withColumn("explanation", F.concat(F.col("unique_users").cast("string"), F.lit(" users"))), 20)


@query(f"WITH {_FACTS}, n AS (SELECT kind, source, count(*) AS n FROM facts GROUP BY 1, 2) SELECT rpad(coalesce(kind, '-'), 16, ' ') || '  ' || lpad(n::VARCHAR, 8, ' ') || '  ' || coalesce(source, '-') AS line FROM n")
def text_table(spark, sf):
    n = fb.facts(spark, sf).groupBy("kind", "source").agg(F.count("*").alias("n"))
    return reports.as_text(n, ["kind", "n", "source"], [16, 8, 0])


@query(f"WITH {_MEMBERS}, q AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY ingest_seq % 50 = 0 DESC, client_ts DESC, id) AS k FROM members) SELECT cluster_id, k::INT AS k, id FROM q WHERE k <= 3")
def medoid_first_quotes(spark, sf):
    """The three quotes of each cluster (a top-k report), labelled members first."""
    m = fb.members(spark, sf)
    return issues.quotes(m, m.filter(F.col("ingest_seq") % 50 == 0).select("id"))


@query("""WITH d AS (SELECT DISTINCT ticket_id, description AS t FROM inbox) SELECT ticket_id, CASE WHEN len(t) <= 3 THEN 0 ELSE len(t) - 2 END AS n FROM d WHERE t IS NOT NULL AND len(t) = len(trim(t)) AND len(t) > 3""")
def shingle_counts(spark, sf):
    d = table(spark, sf, "inbox").select("ticket_id", F.col("description").alias("t")).distinct().filter("t IS NOT NULL AND length(t) = length(trim(t)) AND length(t) > 3")
    return d.select("ticket_id", F.size(text.shingles(F.col("t"))).alias("n"))


@query(f"WITH {_FACTS} SELECT project_id, count(*) AS n FROM facts GROUP BY 1")
def store_summary(spark, sf):
    return store.summary(fb.facts(spark, sf))
