"""The append-only store of submissions: JSON lines or Parquet, one row per (project, id) for ever, the first write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schema
from feedloom.runtime import maybe_broadcast


def first_writes(df: DataFrame) -> DataFrame:
    """The first row of each (project_id, id) by ingest_seq; a hash aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in ("project_id", "id")]
    return df.groupBy("project_id", "id").agg(F.min_by(F.struct(*rest), "ingest_seq").alias("r")).select("id", "project_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def stored_facts(stored: DataFrame) -> DataFrame:
    """first_writes() of a stored table, whose ingest_seq is unique: only keys and numbers are grouped, and the few repeats are filtered out.

    The texts of the records are not shuffled while the repeated keys are few enough to send (maybe_broadcast); beyond that they are joined.
    """
    keys = stored.select("project_id", "id", "ingest_seq")
    again = keys.groupBy("project_id", "id").agg(F.min("ingest_seq").alias("first_"), F.count("*").alias("n")).filter("n > 1").select(F.col("project_id").alias("p_"), F.col("id").alias("i_"), "first_")
    same = stored["project_id"].eqNullSafe(F.col("p_")) & stored["id"].eqNullSafe(F.col("i_"))
    first = stored.join(maybe_broadcast(again), same, "left").filter(F.col("first_").isNull() | (F.col("ingest_seq") == F.col("first_")))
    return first.select(*stored.columns)


def required(df: DataFrame) -> DataFrame:
    """Rows with all required fields; a null body is unusable, an empty one is not."""
    keep = F.lit(True)
    for c in schema.REQUIRED:
        keep = keep & F.col(c).isNotNull()
    return df.filter(keep)


def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", schema.SUBMISSION + ", _corrupt string", how).alias("r"), "value").select("r.*", "value")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(submissions, corrupt lines): ids count once; lines that do not parse are set aside, those without a required field are in lacking_jsonl()."""
    raw = _jsonl(spark, path)
    good = first_writes(required(raw.filter("_corrupt IS NULL").drop("_corrupt", "value")))
    return good, raw.filter("_corrupt IS NOT NULL").select("_corrupt")


def lacking_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value, fields): lines that parse but lack required fields, with their names."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in schema.REQUIRED]), lambda c: c.isNotNull())
    return _jsonl(spark, path).filter("_corrupt IS NULL").select("value", missing.alias("fields")).filter(F.size("fields") > 0)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_new(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, duplicate ids) of a batch against the store. Repeats inside the batch are duplicates of its first row."""
    once = first_writes(incoming)
    keys = stored.select("project_id", "id").distinct()
    accepted = once.join(keys, ["project_id", "id"], "left_anti")
    counted = incoming.groupBy("project_id", "id").agg(F.count("*").alias("n"))
    dup = counted.join(keys.withColumn("known", F.lit(True)), ["project_id", "id"], "left").filter("known OR n > 1").select("project_id", "id")
    return accepted, dup


def projects(df: DataFrame) -> DataFrame:
    return df.select("project_id").distinct()


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias("n"))
