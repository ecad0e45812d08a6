"""Identity, time and money scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def utc_day(ts: Column) -> Column:
    """Days since 1970 in UTC, whatever the session's time zone."""
    return F.floor(F.unix_micros(ts) / F.lit(DAY_US)).cast("bigint")


def day_key(ts: Column) -> Column:
    """The UTC day as yyyy-MM-dd, whatever the session's time zone."""
    return F.date_from_unix_date(utc_day(ts).cast("int")).cast("string")


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_mrr(c: Column) -> Column:
    """A positive amount of money from text; signs of currency and grouping are ignored; anything else is null, never 0."""
    number = F.regexp_replace(F.trim(c), r"[$€£,\s]", "").try_cast("double")
    return F.when(~F.isnan(number) & (number > 0), number)


def resolve_user(external: Column, anon: Column, fallback: Column) -> Column:
    """struct(user_id, attributed): external id, else anonymous id, else the fallback key, unattributed."""
    e, a = empty_to_null(external), empty_to_null(anon)
    return F.struct(F.coalesce(F.concat(F.lit("u:"), e), F.concat(F.lit("a:"), a), fallback).alias("user_id"), F.coalesce(e, a).isNotNull().alias("attributed"))


def fallback_key(policy: str, record: Column, client_ts: Column) -> Column:
    """Key of an unattributed record: per-record, per-day, none for error, or the policy itself as a fixed key."""
    if policy == "per-record":
        return F.concat(F.lit("r:"), record)
    if policy == "per-day":
        return F.concat(F.lit("d:"), day_key(client_ts))
    return F.lit(None).cast("string") if policy == "error" else F.lit(policy)


def derived_id(*parts: Column, prefix: str = "im_") -> Column:
    """A deterministic id of all parts; the separator keeps ('ab', 'c') and ('a', 'bc') apart."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("\u0001")) for p in parts]), 256), 1, 16))


def age_days(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(float(DAY_US))


def instant(c: Column) -> Column:
    """ISO text, ten digits as seconds, thirteen as milliseconds; other bare numbers and unusable text are null."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"^\d{10}$"), F.timestamp_seconds(t.try_cast("bigint")))
        .when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("bigint")))
        .when(t.rlike(r"^\d+$"), F.lit(None).cast("timestamp"))
        .otherwise(F.try_to_timestamp(t))
    )


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds of the time part of a ULID; null if it is none."""
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    digits = F.transform(F.split(F.substring(F.upper(ulid), 1, 10), ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: acc * 32 + d)
    return F.when(F.upper(ulid).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), value)


def backoff_ceiling(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt))


def backoff_delay(attempt: Column, base_ms: int, cap_ms: int, jitter: Column) -> Column:
    """Full jitter (0 … 1) of the ceiling, in whole milliseconds."""
    return F.floor(jitter * backoff_ceiling(attempt, base_ms, cap_ms)).cast("bigint")


def retry_after_ms(header: Column, now: Column) -> Column:
    """A Retry-After header as milliseconds from now: seconds, or an HTTP date; never below 0; null if it is neither."""
    t = F.trim(header)
    # the name of the day is redundant, and Spark does not parse it
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3}, ", ""), " GMT$", "Z"), F.lit("dd MMM yyyy HH:mm:ssX"))
    wall = F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_micros(at) - F.unix_micros(now)) / 1000)).cast("bigint"))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("bigint") * 1000).otherwise(wall)


def retry_after_seconds(ms: Column) -> Column:
    """Whole seconds for a header, at least one."""
    return F.greatest(F.lit(1), F.ceil(ms / 1000)).cast("bigint")


def csv_field(c: Column) -> Column:
    """A value as a field of a CSV file: quoted if it holds a comma, a quote or a line break; null is empty."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
