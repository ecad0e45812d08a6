"""CSV and TSV files as records by header name, bound to fields by alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import scalars
from feedloom.operators.rejects import ALIASES, split_record
from feedloom.schema import KINDS


def read_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text, names trimmed and lower-cased. Duplicate names, ragged rows and open quotes are errors."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    df = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", delimiter)
        .option("mode", "FAILFAST").option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    )
    first = spark.read.text(path).head(1)  # Spark renames repeated columns, so the header is read as it is written
    header = (split_record(first[0].value.lstrip("﻿"), delimiter) if first else None) or df.columns
    names = [c.lstrip("﻿").strip().lower() for c in header]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column in header: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def bind(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One column per known field: the override, else the first alias present, else null."""
    chosen = {f: (overrides or {}).get(f) or next((a for a in aliases if a in df.columns), None) for f, aliases in ALIASES.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(f) for f, c in chosen.items()])


def to_submissions(bound: DataFrame, project: str, *, policy: str = "per-record", source: str = "import") -> DataFrame:
    """Typed submissions. Unusable times and empty bodies are left out; unknown kinds become feature requests.

    The fallback key of an unattributed row is made of its content, so importing a longer file again changes no id.
    """
    ts = scalars.instant(F.col("client_ts"))
    content = scalars.derived_id(F.col("client_ts"), F.col("body"), prefix="")
    user = scalars.resolve_user(F.col("external_id"), F.lit(None).cast("string"), scalars.fallback_key(policy, content, ts))
    kind = F.lower(F.trim("kind"))
    rows = bound.withColumn("ts", ts).withColumn("user", user).filter(F.col("ts").isNotNull() & scalars.empty_to_null(F.col("body")).isNotNull() & F.col("user.user_id").isNotNull())
    return rows.select(
        F.coalesce(scalars.empty_to_null(F.col("id")), scalars.derived_id(F.col("user.user_id"), F.col("client_ts"), F.col("body"))).alias("id"),
        F.lit(project).alias("project_id"), F.when(kind.isin(*KINDS), kind).otherwise("feature_request").alias("kind"), F.lit(source).alias("source"),
        "body", F.col("body").alias("cluster_text"), F.col("user.user_id").alias("user_id"), F.col("user.attributed").alias("attributed"),
        scalars.parse_mrr(F.col("mrr")).alias("mrr"), F.col("ts").alias("client_ts"), scalars.empty_to_null(F.col("route")).alias("route"), scalars.empty_to_null(F.col("app_version")).alias("app_version"),
    )
