"""Per-period aggregates by event time, corrected as late records arrive, up to a cut-off.

The state of a period is a multiset: value -> count. An arriving record adds one to its value's count, so a late record
is an adjustment of counts and nothing else; the exact median, distinct count and extremes are read off the cumulative
counts whenever they are asked for. Counts merge by addition: they are combined on the map side before any shuffle, a
period that holds a third of all rows is spread over its values, and batches of a stream are folded by the same sum.

Defined results for odd input: a record without an id, event time or arrival time belongs to no period and has the fate
``undated``; it is in the ledger and in no aggregate. A null value counts as a record of its period but is no member of
the multiset. Repeated deliveries of one key count once, the one with the smallest sequence number; equal sequence
numbers fall back to the earliest arrival. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions.scalars import DAY_US, day_key, utc_day

#: Buckets of the first level of the rank search keep this many leading binary digits of a value.
BUCKET_BITS = 6


def first_deliveries(df: DataFrame, keys: list[str], seq: str, arrival: str, carry: list[str]) -> DataFrame:
    """One row per key: the delivery with the smallest seq, combined on the map side first. Spark sorts for this aggregate, as it keeps structs; no window is needed."""
    carried = list(dict.fromkeys(c for c in [arrival, *carry] if c not in keys))
    order = F.struct(F.col(seq).alias("_s"), F.col(arrival).alias("_a"))
    packed = F.struct(*[F.col(c) for c in carried])
    return df.groupBy(*keys).agg(F.min_by(packed, order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in carried])


def fate(event: Column, arrival: Column, cutoff_days: int) -> Column:
    """on_time before the end of the UTC day of the event, correction up to the cut-off after it, dropped from then on."""
    end = (utc_day(event) + 1) * DAY_US
    at = F.unix_micros(arrival)
    return (
        F.when(event.isNull() | arrival.isNull(), "undated")
        .when(at < end, "on_time")
        .when(at < end + int(cutoff_days) * DAY_US, "correction")
        .otherwise("dropped")
    )


def ledger(df: DataFrame, *, group: str = "project_id", record: str = "id", event: str = "client_ts", arrival: str = "received_at",
           seq: str = "ingest_seq", values: tuple[str, ...] = (), cutoff_days: int = 7) -> DataFrame:
    """Every record's effect on its period: (group, record, period, fate, values)."""
    once = first_deliveries(df, [group, record], seq, arrival, [event, *values])
    return once.select(
        group, record, day_key(F.col(event)).alias("day"),
        F.when(F.col(record).isNull(), "undated").otherwise(fate(F.col(event), F.col(arrival), cutoff_days)).alias("fate"),
        *[c for c in values if c not in (group, record)],
    )


def multiset(ledger_df: DataFrame, value: str, group: str = "project_id", dropped: bool = False) -> DataFrame:
    """The state: (group, day, value, on_time, corrections), counts by value. Undated records change nothing, dropped ones only their own count, which is kept if dropped is set."""
    known = ["on_time", "correction", *(["dropped"] if dropped else [])]
    counts = [F.count_if(F.col("fate") == "on_time").alias("on_time"), F.count_if(F.col("fate") == "correction").alias("corrections")]
    if dropped:
        counts.append(F.count_if(F.col("fate") == "dropped").alias("dropped"))
    return ledger_df.filter(F.col("fate").isin(*known)).groupBy(group, "day", F.col(value).alias("value")).agg(*counts)


def fold(state: DataFrame, delta: DataFrame, group: str = "project_id") -> DataFrame:
    """State after a batch: counts add up. Associative and commutative, so batches may arrive in any order."""
    return state.unionByName(delta).groupBy(group, "day", "value").agg(F.sum("on_time").alias("on_time"), F.sum("corrections").alias("corrections"))


def totals(state: DataFrame, group: str = "project_id") -> DataFrame:
    """Per period, before and after corrections: records and distinct values."""
    both = F.col("on_time") + F.col("corrections")
    return state.groupBy(group, "day").agg(
        F.sum("on_time").alias("n_on_time"), F.sum(both).alias("n_corrected"),
        F.count_if((F.col("on_time") > 0) & F.col("value").isNotNull()).alias("distinct_on_time"),
        F.count_if((both > 0) & F.col("value").isNotNull()).alias("distinct_corrected"),
    )


def _bucket(v: Column) -> Column:
    """Order-preserving bucket of a whole number: sign, bit length and BUCKET_BITS leading digits; at most a few thousand."""
    m = F.abs(v)
    bits = F.length(F.conv(m.cast("string"), 10, 2)).cast("int")
    shift = F.greatest(bits - BUCKET_BITS, F.lit(0))
    b = shift * (1 << BUCKET_BITS) + F.expr("CAST(0 AS BIGINT)") + F.floor(m / F.pow(F.lit(2.0), shift)).cast("bigint")
    return F.when(v < 0, -b).otherwise(b)


def order_statistics(state: DataFrame, count: str, group: str = "project_id") -> DataFrame:
    """Exact (group, day, n, lo, median, hi) of a multiset of whole numbers, read off cumulative counts.

    Two levels, so that no task sorts a hot period's values: the ranks are located among a few thousand buckets, and
    only the buckets holding the one or two middle ranks are opened. The median of an even count is the mean of the two.
    """
    s = state.filter(F.col("value").isNotNull() & (F.col(count) > 0)).select(group, "day", F.col("value").cast("bigint").alias("v"), F.col(count).alias("c"))
    s = s.withColumn("b", _bucket(F.col("v")))
    per = s.groupBy(group, "day", "b").agg(F.sum("c").alias("bc"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
    w = W.partitionBy(group, "day")
    per = (
        per.withColumn("before", F.sum("bc").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .withColumn("n", F.sum("bc").over(w)).withColumn("lo", F.min("bmin").over(w)).withColumn("hi", F.max("bmax").over(w))
        .withColumn("r1", F.expr("(n + 1) div 2")).withColumn("r2", F.expr("n div 2 + 1"))
    )
    hit = per.filter(((F.col("before") < F.col("r1")) & (F.col("r1") <= F.col("before") + F.col("bc"))) | ((F.col("before") < F.col("r2")) & (F.col("r2") <= F.col("before") + F.col("bc"))))
    inner = s.join(hit.select(group, "day", "b", "before", "n", "lo", "hi", "r1", "r2"), [group, "day", "b"])
    wb = W.partitionBy(group, "day", "b").orderBy("v")
    inner = inner.withColumn("upto", F.col("before") + F.sum("c").over(wb.rowsBetween(W.unboundedPreceding, 0)))
    holds = lambda r: (F.col("upto") - F.col("c") < F.col(r)) & (F.col(r) <= F.col("upto"))
    return inner.groupBy(group, "day").agg(
        F.first("n").alias("n"), F.first("lo").alias("lo"),
        ((F.max(F.when(holds("r1"), F.col("v"))) + F.max(F.when(holds("r2"), F.col("v")))) / 2.0).alias("median"),
        F.first("hi").alias("hi"),
    )
