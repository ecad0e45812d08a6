"""A log pipeline: level gate, length cap, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import cap
from feedloom.operators.redact import scan

LEVELS = ("debug", "info", "warn", "error")
MOST = 512


def emitted(lines: DataFrame, level: str = "info", most: int = MOST) -> DataFrame:
    """Lines (level, message, …) of the level and above; messages are cut before they are redacted, so a cut secret is still covered as far as it shows. Unknown levels are left out."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(F.trim("level")))
    return lines.filter(rank > LEVELS.index(level)).withColumn("message", scan(cap(F.coalesce("message", F.lit("")), most)))
