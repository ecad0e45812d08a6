"""Session defaults for local work; on a cluster the given session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "feedloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
