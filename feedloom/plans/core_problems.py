"""Queries of the general data problems: late events, rejected rows, mixed timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import late_events as le
from feedloom.operators import rejects, timestamps
from feedloom.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Late submissions, read off the state whose values are the ids; it is partitioned like the ledger, so it costs no shuffle."""
    state = le.multiset(le.ledger(table(spark, sf, "submissions")), "id", dropped=True).filter("corrections > 0 OR dropped > 0")
    return state.select("project_id", F.col("value").alias("id"), "day", F.when(F.col("corrections") > 0, "correction").otherwise("dropped").alias("fate"))


def p1_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions and unique users per project and day, as first closed and as corrected."""
    log = le.ledger(table(spark, sf, "submissions"), values=("user_id",))
    return le.totals(le.multiset(log, "user_id")).select(
        "project_id", "day", F.col("n_on_time").alias("submissions_on_time"), F.col("n_corrected").alias("submissions_corrected"),
        F.col("distinct_on_time").alias("users_on_time"), F.col("distinct_corrected").alias("users_corrected"),
    )


def p1_delay_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Exact extremes and median of the delivery delay in seconds, per project and day, corrections included."""
    s = table(spark, sf, "submissions").withColumn("delay_s", F.unix_seconds("received_at") - F.unix_seconds("client_ts"))
    state = le.multiset(le.ledger(s, values=("delay_s",)), "delay_s").withColumn("n_all", F.col("on_time") + F.col("corrections"))
    return le.order_statistics(state, "n_all")


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.load_exports(table(spark, sf, "inbox_raw"), table(spark, sf, "inbox_exports"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(_loaded(spark, sf))


def p4_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """The valid tickets, typed."""
    return rejects.valid(_loaded(spark, sf))


def _written_times(spark: SparkSession, sf: str) -> DataFrame:
    projects = table(spark, sf, "projects").select("project_id", "time_zone", "locale")
    inbox = table(spark, sf, "inbox").select(F.lit("inbox").alias("src"), F.col("ticket_id").alias("rec_id"), "project_id", F.col("created_at").alias("value"))
    log = table(spark, sf, "submission_log").select(F.lit("submission_log").alias("src"), F.col("line_no").cast("string").alias("rec_id"), "project_id", F.col("client_ts").alias("value"))
    both = inbox.unionByName(log).join(projects, "project_id", "left")
    t = timestamps.to_utc(F.col("value"), F.col("time_zone"), F.col("locale"))
    return both.select("src", "rec_id", t.alias("t"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _written_times(spark, sf).filter("t.utc_ms IS NOT NULL AND NOT t.canonical").select("src", "rec_id", F.col("t.utc_ms").alias("utc_ms")).distinct()


def p5_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its instant, null where the value names none."""
    return _written_times(spark, sf).select("src", "rec_id", F.col("t.utc_ms").alias("utc_ms")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_daily, p1_delay_statistics, p4_found, p4_tickets, p5_found, p5_instants)}

_FIRST = """first AS (
  SELECT project_id, id, client_ts, received_at, user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY ingest_seq) AS k FROM submissions) WHERE k = 1),
ledger AS (
  SELECT *, CASE WHEN received_at < date_trunc('day', client_ts AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' + INTERVAL 1 DAY THEN 'on_time'
    WHEN received_at < date_trunc('day', client_ts AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' + INTERVAL 8 DAY THEN 'correction' ELSE 'dropped' END AS fate,
    strftime(client_ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day
  FROM first)"""

def _alias_sql(field: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(list_position(names, '{a}'), 0)" for a in rejects.ALIASES[field]) + ")"


#: The grammar of a record under the export's delimiter d; every field is matched with the delimiter before it, so none is empty.
_P4 = f"""WITH const AS (SELECT '{rejects.BLANKS}' AS blanks), x AS (SELECT export_id, rec_no, regexp_replace(raw, '\\r$', '') AS raw, delim, regexp_escape(delim) AS d FROM inbox_raw JOIN inbox_exports USING (export_id)),
  f AS (SELECT *, regexp_full_match(delim || raw, '(?s)(?:' || d || '(?:"(?:[^"]|"")*"|[^"' || d || '\\r\\n]*))+') AS valid,
    list_transform(regexp_extract_all(delim || raw, '(?s)' || d || '("(?:[^"]|"")*"|[^"' || d || '\\r\\n]*)', 1), lambda c: CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, len(c) - 2), '""', '"') ELSE c END) AS cells FROM x),
  h AS (SELECT export_id, list_transform(cells, lambda c: lower(trim(replace(c, chr(65279), ''), blanks))) AS names FROM f, const WHERE rec_no = 0),
  g AS (SELECT export_id, len(names) AS width, {", ".join(f"{_alias_sql(k)} AS p_{k}" for k in ("id", "body", "client_ts", "external_id", "mrr", "kind", "route"))} FROM h),
  r AS (SELECT f.*, g.width, coalesce(cells[p_id], '') AS id, coalesce(cells[p_body], '') AS body, coalesce(cells[p_client_ts], '') AS ts, coalesce(cells[p_external_id], '') AS who, coalesce(cells[p_mrr], '') AS mrr, coalesce(cells[p_kind], '') AS kind, coalesce(cells[p_route], '') AS route
    FROM f JOIN g USING (export_id), const WHERE rec_no <> 0 AND trim(raw, blanks) <> ''),
  judged AS (SELECT r.*, CASE WHEN NOT valid THEN 'broken_quoting' WHEN len(cells) <> width THEN 'wrong_column_count'
    WHEN regexp_full_match(trim(id, blanks), 'T-[0-9]+') AND trim(body, blanks) <> '' AND NOT contains(body, chr(65533)) AND regexp_full_match(trim(ts, blanks), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z')
      AND try_cast(left(trim(ts, blanks), 10) AS DATE) IS NOT NULL AND left(trim(ts, blanks), 4) <> '0000' THEN NULL ELSE 'invalid_value' END AS reason FROM r, const)"""

SQL = {
    "p1_found": f"WITH {_FIRST} SELECT project_id, id, day, fate FROM ledger WHERE fate <> 'on_time'",
    "p1_daily": f"""WITH {_FIRST} SELECT project_id, day, count(*) FILTER (fate = 'on_time') AS submissions_on_time, count(*) AS submissions_corrected,
        count(DISTINCT user_id) FILTER (fate = 'on_time') AS users_on_time, count(DISTINCT user_id) AS users_corrected
        FROM ledger WHERE fate <> 'dropped' GROUP BY 1, 2""",
    "p1_delay_statistics": f"""WITH {_FIRST}, d AS (SELECT project_id, day, (floor(epoch(received_at)) - floor(epoch(client_ts)))::BIGINT AS v FROM ledger WHERE fate <> 'dropped')
        SELECT project_id, day, count(*) AS n, min(v) AS lo, median(v)::DOUBLE AS median, max(v) AS hi FROM d GROUP BY 1, 2""",
    "p4_found": _P4 + """ SELECT export_id, rec_no, reason FROM judged WHERE reason IS NOT NULL""",
    "p4_tickets": _P4 + """, v AS (SELECT export_id, rec_no, trim(id) AS ticket_id, body AS description, nullif(trim(who), '') AS requester_id, strptime(trim(ts, blanks), '%Y-%m-%dT%H:%M:%SZ') AS created, mrr, nullif(trim(kind), '') AS kind, nullif(trim(route), '') AS route FROM judged, const WHERE reason IS NULL)
        SELECT export_id, rec_no, ticket_id, description, requester_id, timezone('UTC', created) AS created_at, try_cast(regexp_replace(trim(mrr), '[$€£,\\s]', '', 'g') AS DOUBLE) AS mrr, kind, route FROM v""",
}
