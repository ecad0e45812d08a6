"""The four ways in (single captures, imports, exceptions, envelopes) as one type of record, and the import with its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schema
from feedloom.functions import scalars
from feedloom.operators import exceptions
from feedloom.sources import store


def captured(spark: SparkSession, record: dict, project: str, now: str) -> DataFrame:
    """One record as a table of one row. An empty body is refused; kind and source default to a feature request from the api."""
    body = record.get("body")
    if not isinstance(body, str) or not body.strip():
        raise ValueError("body must not be empty")
    fields = ("id", "kind", "source", "body", "external_id", "anon_id", "mrr", "client_ts", "route", "app_version", "platform")
    given = spark.createDataFrame([tuple(None if record.get(f) is None else str(record[f]) for f in fields)], ", ".join(f"{f} string" for f in fields))
    ts = F.coalesce(scalars.instant(F.col("client_ts")), F.lit(now).cast("timestamp"))
    user = scalars.resolve_user(F.col("external_id"), F.col("anon_id"), scalars.fallback_key("per-day", F.lit(""), ts))
    return given.withColumn("u", user).select(
        F.coalesce("id", scalars.derived_id(F.col("u.user_id"), ts.cast("string"), F.col("body"))).alias("id"), F.lit(project).alias("project_id"),
        F.coalesce("kind", F.lit("feature_request")).alias("kind"), F.coalesce("source", F.lit("api")).alias("source"), "body", F.col("body").alias("cluster_text"),
        F.col("u.user_id").alias("user_id"), F.col("u.attributed").alias("attributed"), scalars.parse_mrr(F.col("mrr")).alias("mrr"), ts.alias("client_ts"), "route", "app_version", "platform")


def described(thrown: Column) -> Column:
    """struct(name, message, stack) of anything thrown, given as JSON text: an object with a message, other objects, or bare text."""
    o = F.from_json(thrown, "name string, message string, stack string")
    known = o["message"].isNotNull() | o["name"].isNotNull()
    plain = F.coalesce(F.regexp_extract(thrown, r'^\s*"(.*)"\s*$', 1), F.lit(""))
    return F.struct(
        F.when(known, F.coalesce(F.nullif(o["name"], F.lit("")), F.lit("Error"))).otherwise("Error").alias("name"),
        F.when(known, F.coalesce(o["message"], F.lit(""))).when(plain != "", plain).otherwise(F.coalesce(thrown, F.lit("unknown"))).alias("message"),
        F.when(known, o["stack"]).alias("stack"))


def exceptions_as_submissions(thrown: DataFrame, project: str) -> DataFrame:
    """Bugs of (name, message, stack, user_id, client_ts): verbatim body, scrubbed cluster text, fingerprint; unattributed ones count once per defect and day."""
    name, message, stack = F.coalesce("name", F.lit("Error")), F.coalesce("message", F.lit("")), F.col("stack")
    t = thrown.withColumn("fp", exceptions.fingerprint(name, message, stack))
    return t.select(
        scalars.derived_id(F.col("fp"), F.col("user_id"), F.col("client_ts").cast("string"), message).alias("id"), F.lit(project).alias("project_id"), F.lit("bug").alias("kind"), F.lit("api").alias("source"),
        F.concat(name, F.lit(": "), message).alias("body"), exceptions.cluster_text(name, message, stack).alias("cluster_text"),
        F.coalesce(scalars.empty_to_null(F.col("user_id")), exceptions.fallback_user(F.col("fp"), F.col("client_ts"))).alias("user_id"), scalars.empty_to_null(F.col("user_id")).isNotNull().alias("attributed"),
        "client_ts", F.col("fp").alias("fingerprint"))


def union(*inbound: DataFrame) -> DataFrame:
    """Records of all ways in as one type; fields a way does not know are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inbound)


def imported(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows in order of client_ts with their ingest_seq, one row of total, inserted, duplicate).

    The order is a sort over ranges of time, not a window: ingest_seq grows with it, but leaves gaps. Equal times stay in
    order of id. Of rows with one id the first in time is inserted.
    """
    order = rows.orderBy("client_ts", "id").withColumn("ingest_seq", F.monotonically_increasing_id())
    accepted, _ = store.split_new(order, stored)
    counts = rows.agg(F.count("*").alias("total")).crossJoin(accepted.agg(F.count("*").alias("inserted")))  # one row each
    return accepted.orderBy("ingest_seq"), counts.select("total", "inserted", (F.col("total") - F.col("inserted")).alias("duplicate"))


def replay(log: DataFrame) -> DataFrame:
    """The facts of a stored log in order of insertion, as the clusterer takes them: ids count once, unusable rows are left out."""
    return store.first_writes(store.required(log)).select(*[c for c in log.columns if c in schema.SUBMISSION])
