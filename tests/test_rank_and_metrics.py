import datetime as dt
import math
import random

from pyspark.sql import functions as F

from feedloom.operators import issues, metrics, rank

NOW = "2026-09-01T00:00:00Z"
D = lambda days: dt.datetime(2026, 9, 1, tzinfo=dt.UTC) - dt.timedelta(days=days)
SCHEMA = "cluster_id string, user_id string, kind string, client_ts timestamp, mrr double, seq long"


def ranked(spark, data, **k):
    return {r.cluster_id: r for r in rank.rank(spark.createDataFrame(data, SCHEMA), NOW, **k).collect()}


def test_one_user_counts_once_and_the_latest_row_counts(spark):
    r = ranked(spark, [("a", "u1", "bug", D(30), 100.0, 1), ("a", "u1", "bug", D(10), None, 2), ("a", "u2", "bug", D(0), 900.0, 3)])["a"]
    assert (r.unique_users, r.submissions) == (2, 3)
    assert math.isclose(r.score, 0.5 ** (10 / 60) + 2.0)


def test_ties_in_time_keep_the_first_inserted(spark):
    r = ranked(spark, [("a", "u", "bug", D(0), 900.0, 1), ("a", "u", "bug", D(0), None, 2)])["a"]
    assert math.isclose(r.score, 2.0)


def test_excluded_kinds_and_growth(spark):
    data = [("p", "u", "praise", D(1), None, 1)] + [("g", f"u{k}", "bug", D(1 if k < 9 else 9), None, k) for k in range(12)] + [("z", f"u{k}", "bug", D(9), None, k) for k in range(3)]
    r = ranked(spark, data)
    assert "p" not in r and r["g"].growth == 3.0 and r["z"].score == 0.0


def test_future_rows_do_not_decay_and_are_in_no_window(spark):
    r = ranked(spark, [("a", "u", "bug", D(-5), 0.0, 1)])["a"]
    assert (r.score, r.recent_users, r.prior_users) == (1.0, 0, 0)


def test_explanation(spark):
    df = rank.rank(spark.createDataFrame([("a", "u", "bug", D(0), None, 1)], SCHEMA), NOW)
    assert df.select(rank.explain().alias("e")).collect()[0].e == "1 user, 1 submission, demand 1.00, growth n/a (only 0 prior)"


def test_empty_and_null_kind(spark):
    assert ranked(spark, []) == {}
    assert ranked(spark, [("a", "u", None, D(0), None, 1)])["a"].score == 1.0


def table(spark, t, p):
    return metrics.contingency(spark.createDataFrame(list(zip(t, p)), "truth string, predicted string"))


def test_known_rand_value(spark):
    assert math.isclose(metrics.adjusted_rand(table(spark, "0012", "0011")).collect()[0].ari, 0.5714285714, rel_tol=1e-9)
    assert metrics.adjusted_rand(table(spark, "aaa", "bbb")).collect()[0].ari == 1.0


def test_metrics_against_pairs(spark):
    rng = random.Random(3)
    t, p = [rng.choices("abcd", k=80) for _ in range(2)]
    pairs = [(i, j) for i in range(80) for j in range(i)]
    both = sum(t[i] == t[j] and p[i] == p[j] for i, j in pairs)
    r = metrics.pairwise(table(spark, t, p)).collect()[0]
    assert math.isclose(r.precision, both / sum(p[i] == p[j] for i, j in pairs)) and math.isclose(r.recall, both / sum(t[i] == t[j] for i, j in pairs))
    v = metrics.v_measure(table(spark, t, t)).collect()[0]
    assert math.isclose(v.v, 1.0)


def test_diagnose_noise_and_hard_pairs(spark):
    t = table(spark, "aab", "xyx")
    assert [(r.label, r.parts) for r in metrics.diagnose(t).collect()] == [("a", 2)]
    assert [(r.label, r.parts) for r in metrics.diagnose(t, "predicted").collect()] == [("x", 2)]
    n = metrics.expand_noise(spark.createDataFrame([("1", "n"), ("2", "n"), ("3", "k")], "id string, predicted string"), "n")
    assert n.select("predicted").distinct().count() == 3
    labels = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, label string")
    hp = metrics.hard_pairs(labels, spark.createDataFrame([("1", "2", True, "t"), ("1", "3", True, "t"), ("1", "2", False, "s")], "a string, b string, same boolean, trap string"))
    assert [tuple(r) for r in hp.collect()] == [("s", 1, 0, 1, 0), ("t", 2, 1, 0, 1)]


def test_top_route_and_quotes(spark):
    m = spark.createDataFrame([("c", f"i{k}", ["/b", "/a", None][k % 3], D(k)) for k in range(9)], "cluster_id string, id string, route string, client_ts timestamp")
    r = issues.top_route(m).collect()[0]
    assert (r.route, r.share) == ("/a", 0.5)
    med = spark.createDataFrame([("i8",)], "id string")
    assert [r.id for r in issues.quotes(m, med).orderBy("k").collect()] == ["i8", "i0", "i1"]
    assert issues.quotes(m.limit(0)).count() == 0
    assert F is not None
