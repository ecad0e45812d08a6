import datetime as dt
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.operators import late_events as le

SCHEMA = "project_id string, id string, client_ts timestamp, received_at timestamp, ingest_seq long, user_id string, v long, extra string"
T = lambda d, h=0: dt.datetime(2026, 3, d, h, tzinfo=dt.UTC)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_fates_and_first_delivery(spark):
    df = rows(spark, [
        ("p", "a", T(1, 5), T(1, 6), 1, "u", 1, "x"), ("p", "a", T(1, 5), T(20), 2, "u", 1, "x"),  # the later delivery does not count
        ("p", "b", T(1), T(2), 3, "u", 2, "x"), ("p", "c", T(1), T(8, 23), 4, "w", 3, "x"), ("p", "d", T(1), T(9), 5, "u", 4, "x"),
        ("p", "e", None, T(9), 6, "u", 5, "x"), ("p", "f", T(3), None, 7, "u", 6, "x"), ("p", "g", T(5), T(1), 8, None, 7, "x"), ("p", None, T(5), T(5), 9, None, 7, "x"),
    ])
    got = {r.id: r.fate for r in le.ledger(df).collect()}
    assert got == {"a": "on_time", "b": "correction", "c": "correction", "d": "dropped", "e": "undated", "f": "undated", "g": "on_time", None: "undated"}


def test_totals_before_and_after(spark):
    df = rows(spark, [("p", "a", T(1), T(1), 1, "u", 1, "x"), ("p", "b", T(1), T(3), 2, "w", 1, "x"), ("p", "c", T(1), T(3), 3, "u", 1, "x"), ("p", "d", T(1), T(1), 4, None, 1, "x")])
    r = le.totals(le.multiset(le.ledger(df, values=("user_id",)), "user_id")).collect()
    assert [(x.n_on_time, x.n_corrected, x.distinct_on_time, x.distinct_corrected) for x in r] == [(2, 4, 1, 2)]


def test_folding_batches_equals_one_batch(spark):
    data = [("p", f"i{k}", T(1 + k % 3), T(1 + k % 7), k, f"u{k % 5}", k, "x") for k in range(60)]
    whole = le.multiset(le.ledger(rows(spark, data), values=("user_id",)), "user_id")
    a, b = (le.multiset(le.ledger(rows(spark, part), values=("user_id",)), "user_id") for part in (data[:31], data[31:]))
    key = lambda df: sorted(map(tuple, df.select("project_id", "day", "value", "on_time", "corrections").collect()))
    assert key(le.fold(b, a)) == key(whole)


def test_empty(spark):
    df = rows(spark, [])
    assert le.ledger(df).count() == 0
    assert le.order_statistics(le.multiset(le.ledger(df, values=("v",)), "v"), "on_time").count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.integers(-10**12, 10**12), st.integers(-3, 3)), min_size=1, max_size=60))
def test_order_statistics_are_exact(spark, values):
    data = [("p", f"i{k}", T(1), T(1), k, "u", v, "x") for k, v in enumerate(values)]
    r = le.order_statistics(le.multiset(le.ledger(rows(spark, data), values=("v",)), "v"), "on_time").collect()[0]
    assert (r.n, r.lo, r.hi) == (len(values), min(values), max(values))
    assert abs(r["median"] - statistics.median(values)) < 1e-3
