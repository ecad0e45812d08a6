import datetime as dt
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.operators import timestamps as ts


def one(value, zone="Europe/Paris", locale="fr-FR"):
    r = ts.normalise(pd.Series([value], dtype=object), pd.Series([zone], dtype=object), pd.Series([locale], dtype=object))
    return (None if pd.isna(r.utc_ms[0]) else int(r.utc_ms[0])), bool(r.canonical[0])


def ms(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1000)


@pytest.mark.parametrize("value,zone,locale,want", [
    ("2026-08-04 19:37:14+0530", "Europe/Paris", "fr-FR", "2026-08-04T14:07:14+00:00"),
    ("29 mars 2026 12:18", "Europe/Paris", "fr-FR", "2026-03-29T10:18:00+00:00"),
    ("29 Mar 2026 12:18", "Europe/Paris", "fr-FR", "2026-03-29T10:18:00+00:00"),
    ("2026-05-16 19:53 GMT+10", "Europe/Paris", "fr-FR", "2026-05-16T09:53:00+00:00"),
    ("20251223T162507Z", None, None, "2025-12-23T16:25:07+00:00"),
    ("1776139011373", None, None, "2026-04-14T03:56:51.373+00:00"),
    ("1776139011", None, None, "2026-04-14T03:56:51+00:00"),
    ("08/03/2026 12:42 AM", "America/New_York", "en-US", "2026-08-03T04:42:00+00:00"),
    ("08/03/2026 12:42 AM", "Europe/London", "en-GB", "2026-03-08T00:42:00+00:00"),
    ("27.08.2026 02:52:21", "Europe/Berlin", "de-DE", "2026-08-27T00:52:21+00:00"),
    ("Tue, 21 Jul 2026 01:39:13 -0700", None, None, "2026-07-21T08:39:13+00:00"),
    ("2026-07-18T23:27:21-05:00[America/Chicago]", None, None, "2026-07-19T04:27:21+00:00"),
    ("2026-08-03 02:27 CEST", None, None, "2026-08-03T00:27:00+00:00"),
    ("2026-07-01 15:38:02 UTC", "Asia/Tokyo", "en-GB", "2026-07-01T15:38:02+00:00"),
    (" 2026-01-27T06:53:33.108Z  ", None, None, "2026-01-27T06:53:33.108+00:00"),
    ("2026-05-13T16:17:54.123999Z", None, None, "2026-05-13T16:17:54.123+00:00"),
])
def test_notations(value, zone, locale, want):
    assert one(value, zone, locale) == (ms(want), False)


@pytest.mark.parametrize("value", [None, "", "n/a", "null", "0", "20260720", "2026-02-30T06:41:54Z", "2026-06-04T25:48:16Z", "2026-13-02 06:09", "0000-00-00 00:00:00", "last week", "x" * 100_000, "2026-03-29 02:30:00", "2025-10-26 02:30:00", "2026-08-03"])
def test_values_that_name_no_instant(value):
    assert one(value)[0] is None


def test_canonical_form_is_told_apart():
    assert one("2026-05-13T16:17:54Z")[1] and one("2026-05-13T16:17:54.000Z")[1]
    assert not one("2026-05-13t16:17:54Z")[1] and not one("2026-05-13T16:17:54.1Z")[1]


@settings(max_examples=150, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2036, 1, 1)), st.sampled_from(["Europe/Paris", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "America/Sao_Paulo", "Etc/UTC", "Europe/London"]))
def test_wall_clock_times_agree_with_the_zone_database(local, zone):
    local = local.replace(microsecond=0)
    got = one(local.strftime("%Y-%m-%d %H:%M:%S"), zone)[0]
    z = ZoneInfo(zone)
    instants = {t for fold in (0, 1) if (t := local.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)).astimezone(z).replace(tzinfo=None) == local}
    assert got == (int(instants.pop().timestamp() * 1000) if len(instants) == 1 else None)


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2026-05-13T16:17:54Z", "Etc/UTC", "en-GB"), (None, None, None)], "v string, z string, l string")
    assert [r.t.utc_ms for r in df.select(ts.to_utc(F.col("v"), F.col("z"), F.col("l")).alias("t")).collect()] == [ms("2026-05-13T16:17:54+00:00"), None]
    assert df.limit(0).select(ts.to_utc(F.col("v"), F.col("z"), F.col("l"))).count() == 0
