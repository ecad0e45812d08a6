"""Capture envelopes (JSON) as submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import schema
from feedloom.functions import scalars


#: Columns of an event that hold structures.
NESTED = ("element", "frustration", "custom")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(envelope, reason): parsed envelopes; reason is set for malformed ones and those of another version."""
    e = lines.select(F.from_json(F.col(column), schema.ENVELOPE).alias("e"))
    reason = F.when(F.col("e").isNull() | F.col("e.v").isNull() | F.col("e.project").isNull() | F.col("e.events").isNull(), "malformed").when(F.col("e.v") != schema.PROTOCOL_VERSION, "version")
    return e.select("e", reason.alias("reason"))


def to_submissions(parsed: DataFrame, policy: str = "per-day") -> DataFrame:
    """One row per event of the good envelopes; a missing body is empty; events without usable time or identity are in rejected_events()."""
    return _events(parsed, policy).filter("client_ts IS NOT NULL AND user_id IS NOT NULL AND id IS NOT NULL")


def rejected_events(parsed: DataFrame, policy: str = "per-day") -> DataFrame:
    """(project_id, id, reason) of the events that make no submission."""
    reason = F.when(F.col("id").isNull(), "id").when(F.col("client_ts").isNull(), "time").when(F.col("user_id").isNull(), "identity")
    return _events(parsed, policy).select("project_id", "id", reason.alias("reason")).filter("reason IS NOT NULL")


def _events(parsed: DataFrame, policy: str) -> DataFrame:
    ev = parsed.filter("reason IS NULL").select(F.col("e.project").alias("project_id"), F.explode("e.events").alias("x"))
    ts = scalars.instant(F.col("x.clientTs"))
    user = scalars.resolve_user(F.col("x.user.externalId"), F.col("x.user.anonId"), scalars.fallback_key(policy, F.col("x.id"), ts))
    body = F.coalesce("x.body", F.lit(""))
    rows = ev.withColumn("ts", ts).withColumn("u", user)
    return rows.select(
        F.col("x.id").alias("id"), "project_id", F.col("x.kind").alias("kind"), F.col("x.source").alias("source"), body.alias("body"), body.alias("cluster_text"),
        F.col("u.user_id").alias("user_id"), F.col("u.attributed").alias("attributed"), scalars.parse_mrr(F.col("x.user.traits")["mrr"]).alias("mrr"), F.col("ts").alias("client_ts"),
        F.col("x.context.route").alias("route"), F.col("x.context.appVersion").alias("app_version"), F.col("x.context.platform").alias("platform"),
        F.col("x.element").alias("element"), F.col("x.frustration").alias("frustration"), F.col("x.context.custom").alias("custom"),
    )
