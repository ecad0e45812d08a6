"""Queries of the feedback operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import bags, hashing, scalars, text
from feedloom.operators import bursts, clustering, consolidate, embed, exceptions, issues, lsh, metrics, rank, redact, vectors
from feedloom.runtime import maybe_broadcast, table, written
from feedloom.sources import delimited, store

NOW = "2026-09-01T00:00:00Z"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return store.stored_facts(table(spark, sf, "submissions"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as members of structural clusters: project and route."""
    f = facts(spark, sf).withColumn("cluster_id", F.concat_ws("|", "project_id", F.coalesce("route", F.lit(""))))
    return f.withColumn("seq", F.col("ingest_seq"))


def r6(c):
    return F.round(c, 6)


_FACTS = "facts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY ingest_seq) AS k FROM submissions) WHERE k = 1)"
_MEMBERS = _FACTS + ", members AS (SELECT *, concat_ws('|', project_id, coalesce(route, '')) AS cluster_id FROM facts)"
_NOW = "TIMESTAMPTZ '2026-09-01 00:00:00+00'"
_LATEST = _MEMBERS + """, kept AS (SELECT *, count(*) OVER (PARTITION BY cluster_id, user_id) AS n,
    row_number() OVER (PARTITION BY cluster_id, user_id ORDER BY client_ts DESC, ingest_seq) AS k FROM members WHERE kind IS NULL OR kind <> 'praise'),
  latest AS (SELECT * FROM kept WHERE k = 1)"""


def _ranked_sql(baseline: str) -> str:
    return _LATEST + f""", aged AS (SELECT *, (epoch_us({_NOW}) - epoch_us(client_ts)) / 86400e6 AS age,
    CASE WHEN mrr IS NULL OR mrr <= 0 THEN 1 ELSE 1 + log10(1 + mrr / {baseline}) END AS w FROM latest),
  agg AS (SELECT cluster_id, count(*) AS unique_users, sum(n)::BIGINT AS submissions, sum(w * CASE WHEN age <= 0 THEN 1 ELSE pow(0.5, age / 60) END) AS demand,
    count(*) FILTER (age >= 0 AND age < 7) AS recent_users, count(*) FILTER (age >= 7 AND age < 14) AS prior_users FROM aged GROUP BY 1),
  ranked AS (SELECT *, demand * CASE WHEN prior_users < 3 THEN 1 ELSE least(recent_users / prior_users, 3) END AS score FROM agg)"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- ranking ---


def _rank_columns(df: DataFrame) -> DataFrame:
    return df.select("cluster_id", "unique_users", "submissions", "recent_users", "prior_users", r6("score").alias("score"))


@query(f"WITH {_ranked_sql('100')} SELECT cluster_id, unique_users, submissions, recent_users, prior_users, round(score, 6) AS score FROM ranked")
def rank_clusters(spark, sf):
    return _rank_columns(rank.rank(members(spark, sf), NOW))


@query(f"WITH {_ranked_sql('1e12')} SELECT cluster_id, unique_users, submissions, recent_users, prior_users, round(score, 6) AS score FROM ranked")
def rank_unweighted(spark, sf):
    return _rank_columns(rank.rank(members(spark, sf), NOW, baseline=1e12))


def _ranked_with_weight() -> str:
    return _ranked_sql("100").replace("count(*) AS unique_users,", "count(*) AS unique_users, avg(w) AS mean_weight, max(client_ts) AS newest, min(client_ts) AS oldest,", 1)


@query(f"""WITH {_ranked_with_weight()} SELECT cluster_id, unique_users || CASE WHEN unique_users = 1 THEN ' user, ' ELSE ' users, ' END || submissions || CASE WHEN submissions = 1 THEN ' submission, ' ELSE ' submissions, ' END
    || 'demand ' || printf('%.2f', demand) || CASE WHEN mean_weight > 1.001 THEN ', avg weight ' || printf('%.2f', mean_weight) ELSE '' END
    || CASE WHEN prior_users < 3 THEN ', growth n/a (only ' || prior_users || ' prior)' ELSE ', growth ×' || printf('%.2f', least(recent_users / prior_users, 3)) || ' (' || recent_users || '→ from ' || prior_users || ')' END AS explanation FROM ranked""")
def rank_explained(spark, sf):
    return rank.rank(members(spark, sf), NOW).select("cluster_id", rank.explain().alias("explanation"))


@query(f"WITH {_ranked_with_weight()} SELECT cluster_id, round(mean_weight, 6) AS mean_weight, epoch_us(newest) AS newest_us, epoch_us(oldest) AS oldest_us FROM ranked")
def rank_inputs(spark, sf):
    """Mean weight, newest and oldest latest submissions behind each score."""
    return rank.rank(members(spark, sf), NOW).select("cluster_id", r6("mean_weight").alias("mean_weight"), F.unix_micros("newest").alias("newest_us"), F.unix_micros("oldest").alias("oldest_us"))


def _list_sql(baseline: str, name: str) -> str:
    return f"(WITH {_ranked_sql(baseline)} SELECT cluster_id, row_number() OVER (ORDER BY round(score, 9) DESC, cluster_id) AS {name} FROM ranked)"


@query(f"SELECT cluster_id, weighted, flat, flat - weighted AS movement FROM {_list_sql('100', 'weighted')} JOIN {_list_sql('1e12', 'flat')} USING (cluster_id)")
def rank_movement(spark, sf):
    m = written(members(spark, sf).select("cluster_id", "user_id", "kind", "client_ts", "mrr", "seq"), "mv")
    rounded = lambda b: rank.positions(rank.rank(m, NOW, baseline=b).withColumn("score", F.round("score", 9)))
    w = rounded(100.0).select("cluster_id", F.col("position").alias("weighted"))
    f = rounded(1e12).select("cluster_id", F.col("position").alias("flat"))
    return w.join(f, "cluster_id").select("cluster_id", "weighted", "flat", (F.col("flat") - F.col("weighted")).alias("movement"))


@query(f"WITH {_LATEST} SELECT cluster_id, user_id, client_ts, mrr, n FROM latest")
def latest_per_user(spark, sf):
    m = members(spark, sf).filter("kind IS NULL OR kind <> 'praise'")
    return rank.latest_per_user(m)


@query(f"WITH {_MEMBERS} SELECT cluster_id, count(DISTINCT user_id) AS unique_users, count(*) AS submissions FROM members GROUP BY 1")
def unique_users_by_cluster(spark, sf):
    return members(spark, sf).groupBy("cluster_id", "user_id").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.count("user_id").alias("unique_users"), F.sum("n").alias("submissions"))


@query(f"WITH {_FACTS} SELECT id, project_id, round(CASE WHEN mrr IS NULL OR mrr <= 0 THEN 1 ELSE 1 + log10(1 + mrr / 100) END, 6) AS weight, round(CASE WHEN client_ts >= {_NOW} THEN 1 ELSE pow(0.5, (epoch_us({_NOW}) - epoch_us(client_ts)) / 86400e6 / 60) END, 6) AS decay FROM facts")
def weight_and_decay(spark, sf):
    age = scalars.age_days(F.lit(NOW).cast("timestamp"), F.col("client_ts"))
    return facts(spark, sf).select("id", "project_id", r6(rank.account_weight(F.col("mrr"))).alias("weight"), r6(rank.recency_decay(age)).alias("decay"))


# --- aggregates of clusters ---


@query(f"WITH {_MEMBERS} SELECT cluster_id, kind, count(*) AS n FROM members GROUP BY 1, 2")
def kind_histogram(spark, sf):
    h = issues.kind_histogram(members(spark, sf))
    return h.select("cluster_id", F.explode("kinds").alias("kind", "n"))


@query(f"""WITH {_FACTS}, n AS (SELECT project_id, user_id, route, count(*) AS n FROM facts WHERE route IS NOT NULL GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY project_id, user_id ORDER BY n DESC, route) AS k, n / sum(n) OVER (PARTITION BY project_id, user_id) AS share FROM n)
  SELECT concat_ws('|', project_id, user_id) AS cluster_id, route, round(share, 6) AS share FROM k WHERE k = 1""")
def top_route_mode(spark, sf):
    m = facts(spark, sf).withColumn("cluster_id", F.concat_ws("|", "project_id", "user_id"))
    return issues.top_route(m).select("cluster_id", "route", r6("share").alias("share"))


@query(f"WITH {_MEMBERS}, q AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY client_ts DESC, id) AS k FROM members) SELECT cluster_id, k::INT AS k, id FROM q WHERE k <= 3")
def topn_quotes(spark, sf):
    return issues.quotes(members(spark, sf))


@query(f"WITH {_FACTS} SELECT project_id, floor(epoch_us(client_ts) / (7 * 86400e6))::BIGINT AS week, count(*) AS n FROM facts GROUP BY 1, 2")
def weekly_buckets(spark, sf):
    week = F.floor(F.unix_micros("client_ts") / F.lit(7 * scalars.DAY_US))
    return facts(spark, sf).groupBy("project_id", week.alias("week")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FACTS}, n AS (SELECT route, floor((epoch_us({_NOW}) - epoch_us(client_ts)) / (7 * 86400e6))::BIGINT AS w, count(*) AS n FROM facts WHERE route IS NOT NULL GROUP BY 1, 2),
  grid AS (SELECT route, w FROM (SELECT DISTINCT route FROM facts WHERE route IS NOT NULL), (SELECT unnest(range(0, 17)) AS w))
  SELECT route, w AS weeks_ago, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (route, w)""")
def regression_series(spark, sf):
    """Seventeen weekly counts of every route, zero-filled."""
    f = facts(spark, sf).filter("route IS NOT NULL")
    w = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("client_ts")) / F.lit(7 * scalars.DAY_US))
    n = f.groupBy("route", w.alias("weeks_ago")).agg(F.count("*").alias("n"))
    grid = n.select("route").distinct().select("route", F.explode(F.sequence(F.lit(0), F.lit(16)).cast("array<bigint>")).alias("weeks_ago"))
    return grid.join(n, ["route", "weeks_ago"], "left").select("route", "weeks_ago", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_FACTS} SELECT source, count(*) AS n FROM facts GROUP BY 1")
def source_counts(spark, sf):
    return facts(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query(f"WITH {_MEMBERS} SELECT cluster_id FROM members GROUP BY 1 HAVING count(DISTINCT kind) > 1")
def impure_clusters(spark, sf):
    return issues.kind_histogram(members(spark, sf)).filter(F.size("kinds") > 1).select("cluster_id")


@query(f"WITH {_FACTS} SELECT count(*) AS submissions, count(DISTINCT concat_ws('|', project_id, coalesce(route, ''))) AS clusters, count(DISTINCT project_id) AS projects FROM facts")
def pipeline_funnel(spark, sf):
    m = members(spark, sf).groupBy("project_id", "cluster_id").agg(F.count("*").alias("n"))
    return m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("submissions"), F.count("*").alias("clusters"), F.count_distinct("project_id").alias("projects"))


# --- baselines ---


@query(f"WITH {_FACTS} SELECT id, project_id, 'st:' || coalesce(platform, '') || '|' || coalesce(route, '') || '|' || coalesce(app_version, '') || '|' || floor(epoch_us(client_ts) / (7 * 86400e6))::BIGINT AS label FROM facts")
def structural_baseline(spark, sf):
    return facts(spark, sf).select("id", "project_id", clustering.structural(F.col("platform"), F.col("route"), F.col("app_version"), F.col("client_ts")).alias("label"))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"WITH {_FACTS}, l AS (SELECT project_id, 'x:' || {_NORM.format('body')} AS label FROM facts) SELECT project_id, label, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) > 1")
def exact_match_groups(spark, sf):
    label = F.concat(F.lit("x:"), text.normalize(F.col("body")))
    return facts(spark, sf).groupBy("project_id", label.alias("label")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: len(x) >= 3 AND x NOT IN ({_STOPS})) AS w FROM documents)
  SELECT doc_id, coalesce(list_reduce(list_prepend('', w), lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END), '') AS word FROM w""")
def top_content_word(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.top_content_word(F.col("text")).alias("word"))


# --- text ---


def _undouble(b: str) -> str:
    return f"CASE WHEN len({b}) > 1 AND substr({b}, -1) = substr({b}, -2, 1) AND substr({b}, -1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substr({b}, 1, len({b}) - 1) ELSE {b} END"


def _stem_sql(w: str) -> str:
    c = lambda k: f"substr({w}, 1, len({w}) - {k})"
    return (
        f"CASE WHEN len({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND len({w}) > 4 THEN {c(3)} || 'y' WHEN {w} LIKE '%sses' THEN {c(2)} WHEN {w} LIKE '%ses' AND len({w}) > 4 THEN {c(2)} "
        f"WHEN len({w}) > 4 AND regexp_matches({w}, '(ch|sh|x|z|s)es$') THEN {c(2)} WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN {c(1)} "
        f"WHEN {w} LIKE '%ing' AND len({w}) > 5 THEN {_undouble(c(3))} WHEN {w} LIKE '%ed' AND len({w}) > 4 THEN {_undouble(c(2))} ELSE {w} END")


def _tokens_sql(source: str, key: str, column: str) -> str:
    return f"""tok AS (SELECT {key} AS doc_id, list_transform(list_filter(string_split({_NORM.format(column)}, ' '), lambda x: len(x) >= 3 AND x NOT IN ({_STOPS})), lambda w: {_stem_sql('w')}) AS ts FROM {source}),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY 1, 2)"""


_DOCS = _tokens_sql("documents", "doc_id", "text")
_IDF = _DOCS + ", idf AS (SELECT term, count(*) AS df, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM tf GROUP BY 1)"


def _counts(spark, sf, name="documents", key="doc_id", column="text"):
    docs = table(spark, sf, name).select(F.col(key).alias("doc_id"), text.tokenize(F.col(column)).alias("tokens"))
    return vectors.term_counts(docs, F.col("tokens"))


@query(f"WITH {_DOCS} SELECT doc_id, term, tf FROM tf")
def tokenize_terms(spark, sf):
    return _counts(spark, sf)


@query(f"""WITH {_tokens_sql('documents', 'doc_id', 'text')}, p AS (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM tok)
  SELECT doc_id, ts[i] || '_' || ts[i + 1] AS pair, count(*) AS n FROM p GROUP BY 1, 2""")
def bigram_terms(spark, sf):
    t = text.tokenize(F.col("text"), bigrams=True)
    return table(spark, sf, "documents").select("doc_id", F.explode(t).alias("pair")).filter(F.instr("pair", "_") > 0).groupBy("doc_id", "pair").agg(F.count("*").alias("n"))


@query(f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_frequency_idf(spark, sf):
    n = table(spark, sf, "documents").count()
    return vectors.document_frequency(_counts(spark, sf), n).select("term", "df", r6("idf").alias("idf"))


@query(f"""WITH {_DOCS}, s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seq FROM documents), x AS (SELECT seq, term, row_number() OVER (PARTITION BY term ORDER BY seq) AS df FROM tf JOIN s USING (doc_id))
  SELECT seq, term, df, round(ln(1 + seq / (1 + df)), 6) AS idf FROM x""")
def idf_as_of(spark, sf):
    """Document frequencies as of each document, in order of ids: positions from per-range counts, not from one window over all."""
    seq = vectors.positions(table(spark, sf, "documents").select("doc_id"), "doc_id")
    seen = _counts(spark, sf).join(seq, "doc_id").select("seq", "term")
    return vectors.idf_as_of(seen).select("seq", "term", "df", r6("idf").alias("idf"))


_TFIDF = _IDF + """, raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM tf JOIN idf USING (term)),
  vec AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def _vectors(spark, sf):
    counts = _counts(spark, sf)
    return vectors.tfidf(counts, vectors.document_frequency(counts, table(spark, sf, "documents").count()))


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM vec")
def tfidf_vectors(spark, sf):
    return _vectors(spark, sf).select("doc_id", "term", r6("w").alias("w"))


@query(f"""WITH {_TFIDF}, q AS (SELECT doc_id AS query_id, term, w AS qw FROM vec WHERE doc_id % 20 = 0), c AS (SELECT query_id, doc_id, sum(w * qw) AS cosine FROM vec JOIN q USING (term) GROUP BY 1, 2)
  SELECT query_id, doc_id, round(cosine, 5) AS cosine FROM c WHERE cosine >= 0.3 AND query_id <> doc_id""")
def sparse_cosine_search(spark, sf):
    """Every row whose id is divisible by 20 as a query against all rows: matches from a cosine of 0.3 on."""
    docs = table(spark, sf, "documents")
    counted = written(bags.token_bags(docs, "doc_id", "text"), "bags")
    v = written(vectors.bag_vectors(counted, docs.count(), "doc_id"), "tfidf")
    c = vectors.cosine_matches(v, v.filter(F.col("doc_id") % 20 == 0), 0.3).filter(F.col("query_id") != F.col("doc_id"))
    return c.select("query_id", "doc_id", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {_TFIDF} SELECT source AS cluster_id, term, round(sum(w), 5) AS total FROM vec JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2")
def sparse_centroids(spark, sf):
    labels = table(spark, sf, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("cluster_id"))
    return vectors.centroids(_vectors(spark, sf), labels).select("cluster_id", "term", F.round("total", 5).alias("total"))


@query(f"""WITH {_TFIDF}, s AS (SELECT source, term, sum(w) AS t FROM vec JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2),
  u AS (SELECT source, term, t / sqrt(sum(t * t) OVER (PARTITION BY source)) AS cw FROM s),
  d AS (SELECT d.source, d.doc_id, coalesce(sum(w * cw), 0) AS c FROM documents d LEFT JOIN vec USING (doc_id) LEFT JOIN u ON u.source = d.source AND u.term = vec.term WHERE d.source IS NOT NULL GROUP BY 1, 2)
  SELECT source AS cluster_id, doc_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(c, 12) DESC, doc_id) AS k FROM d) WHERE k = 1""")
def medoid(spark, sf):
    labels = table(spark, sf, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("cluster_id"), F.col("doc_id").alias("seq"))
    return vectors.medoids(_vectors(spark, sf), labels).select("cluster_id", "doc_id", r6("cosine").alias("cosine"))


@query("""WITH s AS (SELECT DISTINCT ticket_id, trim(description) AS t FROM inbox), g AS (SELECT ticket_id, CASE WHEN len(t) <= 3 THEN t ELSE substr(t, i, 3) END AS gram FROM (SELECT ticket_id, t, unnest(range(1, greatest(len(t) - 1, 2))) AS i FROM s WHERE len(t) > 0))
  SELECT ticket_id, gram, count(*) AS n FROM g GROUP BY 1, 2""")
def shingles(spark, sf):
    once = table(spark, sf, "inbox").select("ticket_id", "description").distinct()
    return once.select("ticket_id", F.explode(text.shingles(F.col("description"))).alias("gram")).groupBy("ticket_id", "gram").agg(F.count("*").alias("n"))


def _scrub_sql(x: str) -> str:
    for pattern, mark in (
        (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"), (r"(?i)\b[0-9a-f]{16,}\b", "<hash>"),
        (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"), (r"(?i)\b0x[0-9a-f]+\b", "<hex>"), (r"\b[A-Z]{1,5}-\d+\b", "<id>"),
        (r"\b\d+(?:\.\d+)?((?:ms|s|kb|mb|gb|px|%)?)(?:\b|$)", r"<num>\1"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


@query(f"WITH {_FACTS} SELECT {_scrub_sql('body')} AS scrubbed, count(*) AS n FROM facts WHERE fingerprint IS NOT NULL GROUP BY 1")
def scrubbed_messages(spark, sf):
    return facts(spark, sf).filter("fingerprint IS NOT NULL").select("id", text.scrub_variable_data(F.col("body")).alias("scrubbed")).groupBy("scrubbed").agg(F.count("*").alias("n"))


@query(f"WITH {_FACTS} SELECT id, CASE WHEN len(body) <= 80 THEN body ELSE substr(body, 1, 80) || '…[+' || (len(body) - 80) || ']' END AS capped FROM facts")
def capped_bodies(spark, sf):
    return facts(spark, sf).select("id", text.cap(F.col("body"), 80).alias("capped"))


# --- hashes and blocking ---

_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: ((xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT))::BIGINT"


@query(f"SELECT ticket_id, {_FNV.format(_NORM.format('description'))} AS h FROM (SELECT DISTINCT ticket_id, description FROM inbox WHERE len({_NORM.format('description')}) > 0)")
def fnv1a(spark, sf):
    i = table(spark, sf, "inbox").select("ticket_id", "description").distinct().withColumn("t", text.normalize(F.col("description"))).filter("length(t) > 0")
    return i.select("ticket_id", hashing.fnv1a(F.col("t")).alias("h"))


def _fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.simhash(text.normalize(F.col("text"))).alias("fp"))


def _fold_sql(x: str, base: int, prime: int) -> str:
    return _FNV.format(x).replace("2166136261", str(base)).replace("16777619", str(prime)).replace("::BIGINT", "::HUGEINT")


_FP = f"""t AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(t) <= 3 THEN t ELSE substr(t, i, 3) END AS gram FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 1, 2))) AS i FROM t WHERE len(t) > 0)),
  u AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), h AS (SELECT gram, {_fold_sql('reverse(gram)', hashing.HIGH_BASE, hashing.HIGH_PRIME)} * 4294967296 + {_fold_sql('gram', hashing.LOW_BASE, hashing.LOW_PRIME)} AS h FROM (SELECT DISTINCT gram FROM u)),
  b AS (SELECT doc_id, k, 2 * sum(CASE WHEN (h >> k) & 1 = 1 THEN n ELSE 0 END) > sum(n) AS one FROM u JOIN h USING (gram), (SELECT unnest(range(64))::HUGEINT AS k) GROUP BY 1, 2),
  fp AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(v, 0) END AS v FROM documents LEFT JOIN (SELECT doc_id, sum(CASE WHEN one THEN 1::HUGEINT << k ELSE 0 END) AS v FROM b GROUP BY 1) USING (doc_id))"""
_NEAR = _FP + ", rep AS (SELECT v, min(doc_id) AS rep, count(*) AS copies FROM fp GROUP BY 1), near AS (SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.v, y.v))::INT AS distance FROM rep x JOIN rep y ON x.rep < y.rep AND bit_count(xor(x.v, y.v)) <= 6)"


@query(f"WITH {_FP} SELECT doc_id, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS fp FROM fp")
def simhash(spark, sf):
    return _fingerprints(spark, sf)


@query(f"WITH {_FP} SELECT doc_id, band::INT AS band, ((v >> (8 * band)) & 255)::BIGINT AS chunk FROM fp, (SELECT unnest(range(8))::HUGEINT AS band)")
def lsh_bands(spark, sf):
    return lsh.bands(_fingerprints(spark, sf)).select("doc_id", "band", "chunk")


@query(f"WITH {_NEAR} SELECT a, b, distance FROM near")
def hamming_pairs(spark, sf):
    """All pairs of distinct fingerprints at most six bits apart, by the smallest document of each; fingerprint_members tells whom they stand for."""
    c = lsh.candidates(written(_fingerprints(spark, sf), "fp"), max_distance=6)
    return c.select("a", "b", hashing.hamming(F.col("fa"), F.col("fb")).alias("distance"))


@query(f"WITH {_FP} SELECT doc_id, min(doc_id) OVER (PARTITION BY v) AS representative, count(*) OVER (PARTITION BY v) AS copies FROM fp")
def fingerprint_members(spark, sf):
    """The document that stands for each document's fingerprint in hamming_pairs."""
    fp = written(_fingerprints(spark, sf), "fp")
    return fp.join(fp.groupBy("fp").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies")), "fp").select("doc_id", "representative", "copies")


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
  comp AS (SELECT x AS rep, min(y) AS group_id, count(*) AS n FROM reach GROUP BY 1) SELECT fp.doc_id, comp.group_id FROM fp JOIN rep USING (v) JOIN comp USING (rep) WHERE comp.n > 1 OR rep.copies > 1""")
def near_duplicate_groups(spark, sf):
    return lsh.near_duplicate_groups(written(_fingerprints(spark, sf), "fp"))


# --- dense vectors ---

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 5) AS cosine FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0")
def dense_cosine(spark, sf):
    """Every row whose id is divisible by 20 as a query against all rows."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.all_cosines(e, e.filter(F.col("vec_id") % 20 == 0)).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


@query(f"""SELECT query_id, vec_id, cosine FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 5) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 5) DESC, e.vec_id) AS k
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE k <= 5""")
def semantic_topk(spark, sf):
    """The five nearest rows of every query row (a top-k report)."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.filter(F.col("vec_id") % 20 == 0), 5)


@query("SELECT label, (i - 1)::INT AS dim, round(sum(embedding[i]::DOUBLE), 5) AS total, count(*) AS n FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2")
def dense_centroids(spark, sf):
    return vectors.dense_centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", "dim", F.round("total", 5).alias("total"), "n")


@query("""WITH c AS (SELECT label AS center, list(s ORDER BY i) AS v FROM (SELECT label, i, sum(embedding[i]::DOUBLE) AS s FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT vec_id, center, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, c)
  SELECT vec_id, center, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, center) AS k FROM d) WHERE k = 1""")
def nearest_centroid(spark, sf):
    e = table(spark, sf, "embeddings")
    c = vectors.dense_centroids(e, "label", "embedding").groupBy(F.col("label").alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda x: x["total"]).alias("cv"))
    d = e.join(maybe_broadcast(c), F.lit(True)).select("vec_id", "center", r6(vectors.dense_cosine(F.col("embedding"), F.col("cv"))).alias("cosine"))
    return d.groupBy("vec_id").agg(F.max_by(F.struct("center", "cosine"), F.struct("cosine", -F.col("center"))).alias("b")).select("vec_id", "b.center", "b.cosine")


@query(f"""WITH {_tokens_sql("(SELECT DISTINCT ticket_id, description FROM inbox)", "ticket_id", "description")}, x AS (SELECT doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))) AS term FROM tok),
  f AS (SELECT doc_id, ({_FNV.format('term')} % 256)::INT AS dim, CASE WHEN {_FNV.format("(term || '#')")} % 2 = 1 THEN 1 ELSE -1 END AS sign FROM x), v AS (SELECT doc_id, dim, sum(sign) AS s FROM f GROUP BY 1, 2)
  SELECT doc_id AS ticket_id, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS value FROM v QUALIFY s <> 0""")
def hashing_embeddings(spark, sf):
    """The coordinates other than 0 of each ticket's hashing embedding."""
    once = table(spark, sf, "inbox").select("ticket_id", "description").distinct()
    v = once.select("ticket_id", embed.hashing_embedding(text.tokenize(F.col("description"))).alias("v"))
    return v.select("ticket_id", F.posexplode("v").alias("dim", "value")).filter("value <> 0").select("ticket_id", "dim", r6("value").alias("value"))


# --- redaction, exceptions ---


def _redact_rule(kind: str, sql_pattern: str):
    rule = next(r for r in redact.RULES if r.kind == kind)

    def run(spark, sf):
        t = table(spark, sf, "submissions").select("id", "body").distinct()
        return t.select("id", redact.scan(F.col("body"), (rule,)).alias("text"))

    run.__name__ = f"redact_{kind}"
    query(f"SELECT id, regexp_replace(body, '{sql_pattern}', '[redacted:{kind}]', 'g') AS text FROM (SELECT DISTINCT id, body FROM submissions)" if sql_pattern else None)(run)


for _kind in ("apikey", "token", "email", "iban"):
    _redact_rule(_kind, next(r for r in redact.RULES if r.kind == _kind).pattern)
#: The same rules without look-around, for SQL: numbers with their excluded ranges spelled out, neighbours kept.
_SSN_SQL = r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d\d|6[0-57-9]\d|66[0-57-9])-(?:0[1-9]|[1-9]\d)-(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b"
_PHONE_SQL = r"(^|[^\d-])(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\)|\d{3})[ -]\d{3}[ -]\d{4}($|[^\d-])"
_redact_rule("ssn", _SSN_SQL)
_redact_rule("card", "")  # check digits: tested against brute force
_redact_rule("phone", "")


def _phone_sql(x: str) -> str:
    for _ in range(2):  # two numbers may share a neighbour
        x = f"regexp_replace({x}, '{_PHONE_SQL}', '\\1[redacted:phone]\\2', 'g')"
    return x


SQL["redact_phone"] = f"SELECT id, {_phone_sql('body')} AS text FROM (SELECT DISTINCT id, body FROM submissions)"


def _card_sql(x: str) -> str:
    """Numbers of 13 to 19 digits whose Luhn sum is a multiple of ten."""
    digit = "substr(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1)::INT"
    luhn = f"list_sum(list_transform(range(1, len(regexp_replace(m, '[ -]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    found = f"list_filter(regexp_extract_all({x}, '(?:^|[^\\d-])((?:\\d[ -]?){{12,18}}\\d)(?:$|[^\\d-])', 1), lambda m: {luhn})"
    return f"list_reduce(list_prepend({x}, {found}), lambda a, m: replace(a, m, '[redacted:card]'))"


SQL["redact_card"] = f"SELECT id, {_card_sql('body')} AS text FROM (SELECT DISTINCT id, body FROM submissions)"


def _redacted_sql(x: str) -> str:
    for kind, pattern in [(r.kind, r.pattern) for r in redact.RULES if r.kind not in ("ssn", "card", "phone")] + [("ssn", _SSN_SQL)]:
        x = f"regexp_replace({x}, '{pattern}', '[redacted:{kind}]', 'g')"
    return _phone_sql(_card_sql(x))


@query(f"SELECT ticket_id, {_redacted_sql('description')} AS text FROM (SELECT DISTINCT ticket_id, description FROM inbox)")
def redact_all(spark, sf):
    return table(spark, sf, "inbox").select("ticket_id", "description").distinct().select("ticket_id", redact.scan(F.col("description")).alias("text"))


_COUNTED = ", ".join(f"sum((len(t) - len(replace(t, '[redacted:{r.kind}]', ''))) // len('[redacted:{r.kind}]') - (len(d) - len(replace(d, '[redacted:{r.kind}]', ''))) // len('[redacted:{r.kind}]'))::BIGINT AS n_{r.kind}" for r in redact.RULES)


@query(f"SELECT {_COUNTED} FROM (SELECT description AS d, {_redacted_sql('description')} AS t FROM (SELECT DISTINCT ticket_id, description FROM inbox))")
def redaction_counts(spark, sf):
    """How many markers of each kind the scan adds."""
    t = table(spark, sf, "inbox").select("ticket_id", "description").distinct()
    c = t.select(redact.counts(redact.scan(F.col("description")), F.col("description")).alias("c"))
    return c.agg(*[F.sum(f"c.{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in redact.RULES])


@query(f"""WITH {_FACTS}, e AS (SELECT CASE WHEN instr(body, ':') > 0 THEN substr(body, 1, instr(body, ':') - 1) ELSE body END AS name, {_scrub_sql("ltrim(substr(body, instr(body, ':') + 1))")} AS scrubbed FROM facts WHERE fingerprint IS NOT NULL)
  SELECT 'ex_' || substr(sha256(name || chr(0) || scrubbed), 1, 16) AS fp, name || ': ' || scrubbed AS text, count(*) AS n FROM e GROUP BY 1, 2""")
def exception_groups(spark, sf):
    """Machine messages by fingerprint; their stacks are not stored, so the messages stand for them."""
    e = facts(spark, sf).filter("fingerprint IS NOT NULL").withColumn("name", F.substring_index("body", ":", 1)).withColumn("message", F.ltrim(F.expr("substring(body, instr(body, ':') + 1)")))
    fp = exceptions.fingerprint(F.col("name"), F.col("message"), F.lit(None).cast("string"))
    return e.groupBy(fp.alias("fp"), exceptions.cluster_text(F.col("name"), F.col("message"), F.lit(None).cast("string")).alias("text")).agg(F.count("*").alias("n"))


# --- ingest and joins ---


@query(f"WITH {_FACTS} SELECT project_id, id, ingest_seq, user_id, kind FROM facts")
def ingest_dedupe(spark, sf):
    return facts(spark, sf).select("project_id", "id", "ingest_seq", "user_id", "kind")


@query("SELECT DISTINCT project_id FROM submissions")
def list_projects(spark, sf):
    return store.projects(table(spark, sf, "submissions"))


@query("SELECT project_id, id FROM submissions GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_deliveries(spark, sf):
    s = table(spark, sf, "submissions")
    return store.split_new(s, s.limit(0))[1]


@query("SELECT id, project_id FROM submissions s WHERE NOT EXISTS (SELECT 1 FROM cluster_probe p WHERE p.rec_a = s.id OR p.rec_b = s.id) GROUP BY 1, 2")
def anti_join_unassigned(spark, sf):
    p = table(spark, sf, "cluster_probe")
    assigned = p.select(F.explode(F.array("rec_a", "rec_b")).alias("id")).distinct()
    s = table(spark, sf, "submissions").select("id", "project_id").distinct()
    return issues.unassigned(s, s.join(assigned, "id", "left_semi"))


@query("SELECT DISTINCT id, project_id, kind FROM submissions WHERE id IN (SELECT rec_a FROM cluster_probe)")
def evidence_semi_join(spark, sf):
    return issues.evidence(table(spark, sf, "submissions").select("id", "project_id", "kind").distinct(), table(spark, sf, "cluster_probe").select(F.col("rec_a").alias("id")))


@query(f"WITH {_FACTS} SELECT id, CASE WHEN attributed THEN user_id ELSE 'd:' || strftime(client_ts AT TIME ZONE 'UTC', '%Y-%m-%d') END AS user_key FROM facts")
def per_day_fallback(spark, sf):
    f = facts(spark, sf)
    return f.select("id", F.when(F.col("attributed"), F.col("user_id")).otherwise(scalars.fallback_key("per-day", F.col("id"), F.col("client_ts"))).alias("user_key"))


@query(f"WITH {_FACTS} SELECT id, (SELECT arg_max(app_version, released_at) FROM releases r WHERE r.released_at <= f.client_ts) AS release FROM facts f")
def asof_release(spark, sf):
    """The last release at or before each submission: releases as one sorted array, searched per row."""
    rel = table(spark, sf, "releases").agg(F.array_sort(F.collect_list(F.struct("released_at", "app_version"))).alias("rs"))  # a fixed table
    f = facts(spark, sf).select("id", "client_ts").crossJoin(F.broadcast(rel))
    return f.select("id", F.try_element_at(F.filter("rs", lambda r: r["released_at"] <= F.col("client_ts")), F.lit(-1))["app_version"].alias("release"))


@query(f"WITH {_FACTS}, p AS (SELECT rec_a AS id, min(probe_id) AS probe_id FROM cluster_probe GROUP BY 1) SELECT f.id, coalesce('p' || probe_id, 'u:' || f.id) AS label FROM facts f LEFT JOIN p USING (id)")
def left_outer_assignments(spark, sf):
    p = table(spark, sf, "cluster_probe").groupBy(F.col("rec_a").alias("id")).agg(F.min("probe_id").alias("probe_id"))
    return facts(spark, sf).select("id").join(p, "id", "left").select("id", F.coalesce(F.concat(F.lit("p"), F.col("probe_id").cast("string")), F.concat(F.lit("u:"), "id")).alias("label"))


@query("SELECT ticket_id, CASE WHEN v > 0 THEN v END AS mrr FROM (SELECT ticket_id, try_cast(regexp_replace(trim(mrr), '[$€£,\\s]', '', 'g') AS DOUBLE) AS v FROM (SELECT DISTINCT ticket_id, mrr FROM inbox))")
def parse_mrr(spark, sf):
    return table(spark, sf, "inbox").select("ticket_id", "mrr").distinct().select("ticket_id", scalars.parse_mrr(F.col("mrr")).alias("mrr"))


@query()
def import_inbox(spark, sf):
    """Tickets bound by alias and typed."""
    i = table(spark, sf, "inbox")
    return delimited.to_submissions(delimited.bind(i), "inbox").distinct()


# --- agreement of labels: truth = route, prediction = kind ---

_PAIRS = _FACTS + ", pairs AS (SELECT coalesce(route, '') AS truth, kind AS predicted FROM facts), t AS (SELECT truth, predicted, count(*) AS n FROM pairs GROUP BY 1, 2)"
_AGG = _PAIRS + """, a AS (SELECT (SELECT sum(n) FROM t)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2) FROM t) AS tpp, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY truth)) AS tp,
  (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY predicted)) AS pp)"""


def _pairs(spark, sf):
    return facts(spark, sf).select(F.coalesce("route", F.lit("")).alias("truth"), F.col("kind").alias("predicted"))


@query(f"WITH {_PAIRS} SELECT truth, predicted, n FROM t")
def contingency(spark, sf):
    return metrics.contingency(_pairs(spark, sf))


@query(f"WITH {_AGG} SELECT round((tpp - tp * pp / (n * (n - 1) / 2)) / ((tp + pp) / 2 - tp * pp / (n * (n - 1) / 2)), 6) AS ari FROM a")
def adjusted_rand(spark, sf):
    return metrics.adjusted_rand(metrics.contingency(_pairs(spark, sf))).select(r6("ari").alias("ari"))


@query(f"WITH {_AGG} SELECT round(tpp / pp, 6) AS precision, round(tpp / tp, 6) AS recall, round(2 * (tpp / pp) * (tpp / tp) / (tpp / pp + tpp / tp), 6) AS f1 FROM a")
def pairwise_prf(spark, sf):
    return metrics.pairwise(metrics.contingency(_pairs(spark, sf))).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PAIRS}, s AS (SELECT sum(n)::DOUBLE AS n FROM t), ht AS (SELECT -sum(x / s.n * ln(x / s.n)) AS h FROM (SELECT sum(n) AS x FROM t GROUP BY truth), s), hp AS (SELECT -sum(x / s.n * ln(x / s.n)) AS h FROM (SELECT sum(n) AS x FROM t GROUP BY predicted), s),
  j AS (SELECT -sum(t.n / s.n * ln(t.n / s.n)) AS h FROM t, s), v AS (SELECT 1 - (j.h - hp.h) / ht.h AS homogeneity, 1 - (j.h - ht.h) / hp.h AS completeness FROM ht, hp, j)
  SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v FROM v""")
def v_measure(spark, sf):
    return metrics.v_measure(metrics.contingency(_pairs(spark, sf))).select(*[r6(c).alias(c) for c in ("homogeneity", "completeness", "v")])


@query(f"WITH {_PAIRS} SELECT truth AS label, count(*) AS parts, sum(n)::BIGINT AS size FROM t GROUP BY 1 HAVING count(*) > 1")
def diagnose_splits(spark, sf):
    return metrics.diagnose(metrics.contingency(_pairs(spark, sf)))


@query(f"WITH {_PAIRS} SELECT predicted AS label, count(*) AS parts, sum(n)::BIGINT AS size FROM t GROUP BY 1 HAVING count(*) > 1")
def diagnose_merges(spark, sf):
    return metrics.diagnose(metrics.contingency(_pairs(spark, sf)), "predicted")


@query(f"WITH {_FACTS} SELECT id, CASE WHEN kind = 'rage' THEN '__noise_' || id || '__' ELSE kind END AS predicted FROM facts")
def noise_expansion(spark, sf):
    return metrics.expand_noise(facts(spark, sf).select("id", F.col("kind").alias("predicted")), "rage")


def _by_size(t: DataFrame, c: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = t.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias("n"))
    return n.select("label", F.row_number().over(W.orderBy(F.desc("n"), "label")).alias("position"))  # a row per label


@query(f"""WITH {_PAIRS}, tr AS (SELECT truth, row_number() OVER (ORDER BY sum(n) DESC, truth) AS k FROM t GROUP BY 1), pr AS (SELECT predicted, row_number() OVER (ORDER BY sum(n) DESC, predicted) AS k FROM t GROUP BY 1),
  pl2 AS (SELECT predicted, truth FROM (SELECT *, row_number() OVER (PARTITION BY predicted ORDER BY n DESC, truth) AS k FROM t) WHERE k = 1),
  seen AS (SELECT predicted FROM pr WHERE k <= 10), top AS (SELECT truth FROM tr WHERE k <= 10), named AS (SELECT DISTINCT truth FROM pl2 JOIN seen USING (predicted)),
  size AS (SELECT truth, sum(n) AS size FROM t GROUP BY 1), best AS (SELECT truth, max(n) AS best FROM t JOIN seen USING (predicted) GROUP BY 1)
  SELECT count(named.truth) AS hits, round(count(named.truth) / count(*), 6) AS recall, round(avg(coalesce(best / size, 0)), 6) AS capture FROM top LEFT JOIN named USING (truth) LEFT JOIN size USING (truth) LEFT JOIN best USING (truth)""")
def topk_agreement(spark, sf):
    t = metrics.contingency(_pairs(spark, sf))
    return metrics.top_k_agreement(t, _by_size(t, "truth"), _by_size(t, "predicted"), 10).select("hits", r6("recall").alias("recall"), r6("capture").alias("capture"))


# --- event streams ---


def _ui_events(spark, sf):
    """The event table as interface events: sessions are users, kinds are mapped by name."""
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"click": "click", "error": "console_error", "view": "nav", "signup": "reload", "purchase": "escape"}.items() for x in kv])
    return e.select(
        F.col("user_id").cast("string").alias("session"), kind[F.col("event_type")].alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("at_ms"),
        F.lit(None).cast("string").alias("target"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("dead"), F.lit(0.0).alias("delta"), F.col("event_id").alias("seq"),
    )


def _bursts_sql(events: str, need: str, ms: str) -> str:
    """Greedy bursts per key of events (key, at_ms): from event i, all less than ms later; enough of them count once and are jumped over."""
    return f"""ev AS ({events}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms) AS i FROM ev),
  nx AS (SELECT key, i, {need} AS need, (SELECT max(p.i) FROM o p WHERE p.key = o.key AND p.at_ms < o.at_ms + {ms}) AS j FROM o),
  walk AS (SELECT key, 1::BIGINT AS i, 0 AS c FROM o WHERE i = 1 UNION ALL SELECT w.key, CASE WHEN nx.j - nx.i + 1 >= nx.need THEN nx.j + 1 ELSE nx.i + 1 END, w.c + CASE WHEN nx.j - nx.i + 1 >= nx.need THEN 1 ELSE 0 END FROM walk w JOIN nx ON nx.key = w.key AND nx.i = w.i),
  counted AS (SELECT key, max(c)::INT AS bursts FROM walk GROUP BY 1)"""


_AT = "epoch_us(ts) // 1000"
_SIGNALS = f"""WITH RECURSIVE {_bursts_sql(f"SELECT user_id || '|' || event_type AS key, {_AT} AS at_ms, CASE WHEN event_type = 'view' THEN 4 ELSE 3 END AS n, CASE event_type WHEN 'view' THEN 10000 WHEN 'purchase' THEN 2000 ELSE 5000 END AS w FROM events WHERE event_type IN ('view', 'purchase', 'error')", "n", "o.w")},
  clicks AS (SELECT user_id, {_AT} AS at_ms, value FROM events WHERE event_type = 'click'),
  rage AS (SELECT DISTINCT c.user_id FROM clicks c WHERE (SELECT count(*) FROM clicks d WHERE d.user_id = c.user_id AND d.at_ms BETWEEN c.at_ms AND c.at_ms + 1000 AND abs(d.value - c.value) <= 30) >= 3),
  s AS (SELECT user_id::VARCHAR AS session, coalesce(max(bursts) FILTER (event_type = 'view'), 0) AS nav_thrash, coalesce(max(bursts) FILTER (event_type = 'purchase'), 0) AS escape_mash, coalesce(max(bursts) FILTER (event_type = 'error'), 0) AS console_error_spike,
    count(*) FILTER (event_type = 'signup')::INT AS reload, CASE WHEN bool_or(user_id IN (SELECT user_id FROM rage)) THEN NULL ELSE 0 END AS rage_click FROM events LEFT JOIN counted ON key = user_id || '|' || event_type GROUP BY 1)"""


@query(_SIGNALS + " SELECT session, 0 AS dead_click, rage_click, 0 AS form_error_repeat, reload, console_error_spike, nav_thrash, escape_mash, 0 AS scroll_thrash FROM s")
def frustration_signals(spark, sf):
    return bursts.frustration_signals(_ui_events(spark, sf))


@query(_SIGNALS + ", z AS (SELECT session, round(1 - exp(-(0.3 * rage_click + 0.2 * reload + 0.2 * console_error_spike + 0.15 * nav_thrash + 0.15 * escape_mash)), 4) AS score FROM s) SELECT session, score, score >= 0.5 AS prompt FROM z")
def frustration_scores(spark, sf):
    s = bursts.frustration_signals(_ui_events(spark, sf)).withColumn("score", bursts.frustration_score())
    return s.select("session", "score", (F.col("score") >= bursts.PROMPT_AT).alias("prompt"))


@query(f"WITH RECURSIVE {_bursts_sql(f'SELECT user_id::VARCHAR AS key, {_AT} AS at_ms FROM events', '4', '3600000')} SELECT key, bursts FROM counted")
def greedy_bursts(spark, sf):
    return bursts.greedy_bursts(_ui_events(spark, sf).select(F.col("session").alias("key"), "at_ms"), 4, 3_600_000)


@query(f"""WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS key, {_AT} AS at_ms, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS i FROM events),
  walk AS (SELECT key, at_ms, seq, i, [at_ms] AS hits, true AS allowed, 4 AS remaining, 0::BIGINT AS retry_after_ms FROM o WHERE i = 1
    UNION ALL SELECT key, at_ms, seq, i, CASE WHEN full_ THEN kept ELSE list_append(kept, at_ms) END, NOT full_, CASE WHEN full_ THEN 0 ELSE 4 - len(kept) END, CASE WHEN full_ THEN greatest(1, kept[1] + 86400000 - at_ms) ELSE 0 END
      FROM (SELECT o.*, list_filter(w.hits, lambda h: h > o.at_ms - 86400000) AS kept, len(list_filter(w.hits, lambda h: h > o.at_ms - 86400000)) >= 5 AS full_ FROM walk w JOIN o ON o.key = w.key AND o.i = w.i + 1))
  SELECT key, at_ms, seq, allowed, remaining::INT AS remaining, retry_after_ms FROM walk""")
def rate_limit_fold(spark, sf):
    return bursts.rate_limit(_ui_events(spark, sf).select(F.col("session").alias("key"), "at_ms", "seq"), 5, 86_400_000)


# --- clustering ---


def _documents(spark, sf):
    f = facts(spark, sf)
    return f.select("project_id", "id", F.col("ingest_seq").alias("seq"), text.tokenize(F.col("cluster_text")).alias("tokens"), clustering.structural_key(F.col("platform"), F.col("route"), F.col("app_version")).alias("key"))


@query()
def leader_follower(spark, sf):
    return clustering.leader_follower(_documents(spark, sf)).select("project_id", "id", "cluster_id", r6("similarity").alias("similarity"))


def _clustered(spark, sf):
    """Documents with their sites as clusters, and their vectors."""
    v = written(_vectors(spark, sf).withColumnRenamed("doc_id", "id"), "cv")
    return v, table(spark, sf, "documents").filter("site IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("site").alias("cluster_id"))


_SITES = _TFIDF.replace("vec AS (SELECT doc_id,", "vec AS (SELECT doc_id AS id,", 1) + """, lab AS (SELECT doc_id AS id, site AS cluster_id FROM documents WHERE site IS NOT NULL), n AS (SELECT cluster_id, count(*) AS n FROM lab GROUP BY 1),
  sums AS (SELECT cluster_id, term, sum(w) AS s FROM vec JOIN lab USING (id) GROUP BY 1, 2)"""
_MEANS = _SITES + """, own AS (SELECT cluster_id, id, sum(w * s) AS vs, sum(w * w) AS vv FROM vec JOIN lab USING (id) JOIN sums USING (cluster_id, term) GROUP BY 1, 2),
  means AS (SELECT cluster_id, id, n, CASE WHEN n < 2 THEN 1 ELSE round((coalesce(vs, 0) - coalesce(vv, 0)) / (n - 1), 12) END AS m FROM lab JOIN n USING (cluster_id) LEFT JOIN own USING (cluster_id, id))"""


@query(f"""WITH {_SITES}, m AS (SELECT x.cluster_id AS a, y.cluster_id AS b, sum(x.s * y.s) AS d FROM sums x JOIN sums y ON x.term = y.term AND x.cluster_id < y.cluster_id GROUP BY 1, 2)
  SELECT a, b, round(d / (p.n * q.n), 6) AS similarity FROM m JOIN n p ON p.cluster_id = a JOIN n q ON q.cluster_id = b""")
def linkage_average(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.linkage_table(v, labels).select("a", "b", r6("similarity").alias("similarity"))


@query(f"WITH {_MEANS} SELECT cluster_id, id, n, round(m, 6) AS mean_similarity FROM means")
def mean_similarity_to_rest(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.mean_to_rest(v, labels).select("cluster_id", "id", "n", r6("mean_similarity").alias("mean_similarity"))


@query(f"WITH {_MEANS} SELECT cluster_id, any_value(n) AS n, round(avg(m), 6) AS cohesion FROM means GROUP BY 1")
def cohesion(spark, sf):
    """Mean similarity within each cluster."""
    v, labels = _clustered(spark, sf)
    return consolidate.self_linkage(v, labels).select("cluster_id", "n", r6("cohesion").alias("cohesion"))


@query(f"""WITH {_MEANS} SELECT cluster_id, id, round(m, 6) AS mean_similarity, 'outlier:' || cluster_id || ':' || id AS key FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY m, id) AS k FROM means WHERE n > 2 AND m < 0.02) WHERE k <= n - 2""")
def outlier_proposals(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.outlier_proposals(v, labels, 0.02).select("cluster_id", "id", r6("mean_similarity").alias("mean_similarity"), "key")


_POLES = _SITES + """, pr AS (SELECT x.cluster_id, x.id AS i, y.id AS j FROM lab x JOIN lab y ON x.cluster_id = y.cluster_id AND x.id < y.id), dots AS (SELECT l.cluster_id, v.id AS i, u.id AS j, sum(v.w * u.w) AS d FROM vec v JOIN lab l USING (id) JOIN vec u ON u.term = v.term JOIN lab k ON k.id = u.id AND k.cluster_id = l.cluster_id GROUP BY 1, 2, 3),
  poles AS (SELECT cluster_id, i AS pole_a, j AS pole_b, round(coalesce(d, 0), 12) AS sim FROM pr LEFT JOIN dots USING (cluster_id, i, j) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(coalesce(d, 0), 12), i, j) = 1)"""


@query(f"WITH {_POLES} SELECT cluster_id, pole_a, pole_b, round(sim, 6) AS similarity FROM poles")
def diameter_pairs(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.diameter_pairs(v, labels).select("cluster_id", "pole_a", "pole_b", r6("similarity").alias("similarity"))


@query(f"""WITH {_POLES}, side AS (SELECT l.cluster_id, l.id, CASE WHEN CASE WHEN l.id = pole_a THEN 1 ELSE round(coalesce(a.d, 0), 12) END >= CASE WHEN l.id = pole_b THEN 1 ELSE round(coalesce(b.d, 0), 12) END THEN 0 ELSE 1 END AS side FROM lab l JOIN poles USING (cluster_id) JOIN n USING (cluster_id)
    LEFT JOIN dots a ON a.cluster_id = l.cluster_id AND a.i = l.id AND a.j = pole_a LEFT JOIN dots b ON b.cluster_id = l.cluster_id AND b.i = l.id AND b.j = pole_b WHERE n.n >= 4),
  flip AS (SELECT cluster_id, arg_min(side, id) AS first FROM side GROUP BY 1), s2 AS (SELECT cluster_id, id, CASE WHEN side = first THEN 'a' ELSE 'b' END AS side FROM side JOIN flip USING (cluster_id)),
  pp AS (SELECT x.cluster_id, x.side AS sx, y.side AS sy, coalesce(d, 0) AS d FROM s2 x JOIN s2 y ON x.cluster_id = y.cluster_id AND x.id < y.id LEFT JOIN dots ON dots.cluster_id = x.cluster_id AND dots.i = x.id AND dots.j = y.id),
  q AS (SELECT cluster_id, avg(d) FILTER (sx <> sy) AS x, coalesce(avg(d) FILTER (sx = 'a' AND sy = 'a'), 1) AS wa, coalesce(avg(d) FILTER (sx = 'b' AND sy = 'b'), 1) AS wb FROM pp GROUP BY 1),
  z AS (SELECT cluster_id, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM s2 GROUP BY 1)
  SELECT cluster_id, id, side, round(x, 6) AS "cross", round(wa, 6) AS within_a, round(wb, 6) AS within_b FROM s2 JOIN q USING (cluster_id) JOIN z USING (cluster_id) WHERE na >= 2 AND nb >= 2 AND round(x, 12) < 0.1 AND least(wa, wb) >= x + 0.005""")
def split_proposals(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.split_proposals(v, labels, 0.1, min_gain=0.005).select("cluster_id", "id", "side", *[r6(c).alias(c) for c in ("cross", "within_a", "within_b")])


@query()
def merge_proposals(spark, sf):
    v, labels = _clustered(spark, sf)
    return consolidate.merge_proposals(v, labels, 0.1).select("key", r6("similarity").alias("similarity"), "size_a", "size_b")


@query()
def build_issues(spark, sf):
    """The list of issues: assignment, consolidation, ranking, description."""
    return issues.build_issues(facts(spark, sf), NOW).select("issue_id", "title", r6("score").alias("score"), "unique_users", "submissions", "explanation", "top_route", "kinds")
