"""The read and write API as functions of a store: the shapes of the HTTP routes without a server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import issues
from feedloom.sources import envelopes, store

MAX_LIMIT = 200


def parse_limit(raw: str | None) -> int | None:
    """A positive whole number, at most MAX_LIMIT; None for none; anything else is an error."""
    if raw is None:
        return None
    if not raw.strip().isdecimal() or int(raw) < 1:
        raise ValueError("limit must be a positive integer")
    return min(int(raw), MAX_LIMIT)


def health(submissions: DataFrame) -> DataFrame:
    return store.summary(submissions)


def list_issues(submissions: DataFrame, project: str, now: str, limit: str | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """The ranked list of a project, without members and medoid ids. limit is the page length."""
    mine = submissions.filter(F.col("project_id") == project)
    return issues.build_issues(mine, now, limit=parse_limit(limit), assignments=assignments).drop("medoid_id")


def issue(submissions: DataFrame, project: str, now: str, issue_id: str, assignments: DataFrame | None = None) -> DataFrame:
    mine = submissions.filter(F.col("project_id") == project)
    return issues.build_issues(mine, now, assignments=assignments).filter(F.col("issue_id") == issue_id)


def evidence(submissions: DataFrame, labels: DataFrame, issue_id: str) -> DataFrame:
    """The submissions of an issue. labels: (id, cluster_id)."""
    return issues.evidence(submissions, labels.filter(F.col("cluster_id") == issue_id))


def ingest(spark: SparkSession, lines: DataFrame, stored: DataFrame, project_key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, duplicate ids, rejected envelopes) of envelope lines; a foreign project key is a rejection."""
    parsed = envelopes.parse(lines)
    if project_key is not None:
        parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(F.col("e.project") != project_key, "project key")))
    rows = envelopes.to_submissions(parsed).withColumn("ingest_seq", F.monotonically_increasing_id())
    accepted, duplicate = store.split_new(rows, stored)
    return accepted, duplicate, parsed.filter("reason IS NOT NULL")


# Routes below the version, and their method. A star stands for one id.
ROUTES = {"health": "GET", "ingest": "POST", "issues": "GET", "issues/*": "GET", "issues/*/submissions": "GET"}


def dispatch(requests: DataFrame) -> DataFrame:
    """Requests (method, path, …) with their route and status: 200, 404 where there is none, 405 for another method."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce("path", F.lit("")), r"[?#].*$", ""), "/"), lambda s: s != "")
    rest = F.slice(parts, 2, 1000)
    shape = F.array_join(F.transform(rest, lambda s, i: F.when(i == 1, "*").otherwise(s)), "/")
    known = F.create_map(*[x for p, m in ROUTES.items() for x in (F.lit(p), F.lit(m))])
    route = F.when((F.element_at(parts, 1) == "v0") & F.map_contains_key(known, shape), shape)
    out = requests.withColumn("parts_", parts).withColumn("route", F.when(F.size("parts_") > 0, route)).drop("parts_")
    return out.withColumn("status", F.when(F.col("route").isNull(), 404).when(F.upper(F.coalesce("method", F.lit(""))) != F.element_at(known, F.col("route")), 405).otherwise(200))
