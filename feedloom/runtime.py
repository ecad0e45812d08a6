"""Lineage cuts and size-checked joins shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if a count proves it has at most this many rows …
BROADCAST_ROWS = 200_000
#: … and, where its rows have no fixed width, a sum over them proves it holds at most this many bytes.
BROADCAST_BYTES = 64_000_000

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary one serves a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and lost executors cost no recomputation.

    Results read these tables when they are run, so they live as long as the session or until clear() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/feedloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clear() -> None:
    """Delete all tables of written(); for long sessions, between queries whose results are done with."""
    while _tables:
        spark, path = _tables.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone; the shared folder is the cluster's to clear
            return


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _bytes(field: T.StructField) -> Column | None:
    """Size of a column's values, or None where it is fixed and small."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _FIXED):
        return None
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.octet_length(c)
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, _FIXED):
        return F.size(c) * 8
    return F.octet_length(F.to_json(F.struct(c)))


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most limit rows and BROADCAST_BYTES, else unchanged: the join then shuffles.

    The count stops at limit + 1 rows, so the proof costs no full scan of a large side. rows, where the caller knows them,
    are proof enough for rows of fixed width.
    """
    sizes = [b for f in df.schema.fields if (b := _bytes(f)) is not None]
    if rows is not None and (rows > limit or not sizes):
        return df if rows > limit else F.broadcast(df)
    if not sizes:
        return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    total = sum((F.coalesce(b, F.lit(0)).cast("bigint") for b in sizes), F.lit(0).cast("bigint"))
    n, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).head()
    return F.broadcast(df) if n <= limit and size <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
