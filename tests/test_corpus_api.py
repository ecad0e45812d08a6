import json

import pytest
from pyspark.sql import functions as F

from feedloom import api
from feedloom.operators import corpus, queues
from feedloom.sources import seed


def test_validate(spark):
    items = spark.createDataFrame([("1", "c", "x", "2026-01-01"), ("1", "c", "x", "2026-01-01"), ("2", "zz", "", "bad"), ("3", "singleton-1", "x", "2026-01-01"), ("4", "singleton-1", "x", "2026-01-01")], "id string, cluster string, body string, client_ts string")
    clusters = spark.createDataFrame([("c",), ("none",)], "id string")
    pairs = spark.createDataFrame([("1", "2", True), ("1", "9", True), ("3", "3", True)], "a string, b string, same boolean")
    got = {tuple(r) for r in corpus.validate(items, clusters, pairs).collect()}
    assert got == {("duplicate-id", "1"), ("undeclared-cluster", "2"), ("empty-body", "2"), ("bad-timestamp", "2"), ("empty-cluster", "none"), ("undersized-cluster", "zz"), ("fat-singleton", "singleton-1"), ("pair-contradicts-labels", "1+2"), ("dangling-pair", "1+9"), ("self-pair", "3+3")}


def test_sweep_and_subset(spark):
    items = spark.createDataFrame([(str(k), "ab"[k % 2]) for k in range(8)], "id string, cluster string")
    by = lambda df, m: df.select("id", (F.col("id").cast("int") % m).cast("string").alias("label"))
    best = corpus.sweep(items, [{"m": 1}, {"m": 2}, {"m": 8}], by, baseline_precision=0.5).collect()
    assert best[0].m == 2 and best[0].ari == 1.0
    assert corpus.score_subset(items, F.col("id") < "4", lambda d: by(d, 2)).collect()[0].v == 1.0


def test_bounded_queue(spark):
    df = spark.createDataFrame([("c", k, "x" * 10, "r" * 10) for k in range(5)], "client string, seq long, payload string, capture_ref string")
    assert [(r.seq, r.capture_ref) for r in queues.bounded(df, 100, 60).collect()] == [(k, None) for k in range(5)]
    assert [r.seq for r in queues.bounded(df, 2, 1000).collect()] == [3, 4]
    assert [r.seq for r in queues.acknowledge(queues.bounded(df, 100, 35), df.filter("seq = 4")).orderBy("seq").collect()] == [2, 3]


def test_seed(spark):
    a, b = seed.generate(spark, 50, seed=3), seed.generate(spark, 50, seed=3)
    assert sorted(a.collect()) == sorted(b.collect()) and a.select("topic").distinct().count() > 2
    moved = seed.shift_to(a, "client_ts", "2027-01-01T00:00:00Z")
    assert moved.agg(F.date_format(F.max("client_ts"), "yyyy-MM-dd").alias("m")).collect()[0].m == "2027-01-01"


def test_limits():
    assert api.parse_limit(None) is None and api.parse_limit("5") == 5 and api.parse_limit("999") == 200
    for bad in ("0", "-1", "x", "1.5", ""):
        with pytest.raises(ValueError):
            api.parse_limit(bad)


ROWS = [("a", "csv export is broken", "u:1"), ("b", "csv export fails again", "u:2"), ("c", "export csv broken for me", "u:3"), ("d", "dark mode theme", "u:1"), ("e", "dark theme mode wanted", "u:2"), ("f", "lovely dark mode", "u:9")]


def facts(spark):
    return spark.createDataFrame([(i, "p", "praise" if i == "f" else "bug", t, t, u, None, k, "/x") for k, (i, t, u) in enumerate(ROWS)], "id string, project_id string, kind string, body string, cluster_text string, user_id string, mrr double, ingest_seq long, route string").withColumns(
        {"client_ts": F.timestamp_seconds(F.lit(1788000000) + F.col("ingest_seq")), "platform": F.lit("web"), "app_version": F.lit(None).cast("string")})


def test_issues(spark):
    got = api.list_issues(facts(spark), "p", "2026-09-01T00:00:00Z").collect()
    assert [(r.unique_users, r.submissions) for r in got] == [(3, 3), (2, 2)]
    assert got[0].title in [t for _, t, _ in ROWS[:3]] and {q.id for q in got[0].quotes} == {"a", "b", "c"} and got[1].kinds == {"bug": 2}
    assert len(api.list_issues(facts(spark), "p", "2026-09-01T00:00:00Z", "1").collect()) == 1
    labels = spark.createDataFrame([("p", "a", "L1"), ("p", "d", "L2")], "project_id string, id string, cluster_id string")
    assert api.list_issues(facts(spark), "p", "2026-09-01T00:00:00Z", assignments=labels).count() >= 2
    assert api.list_issues(facts(spark), "nobody", "2026-09-01T00:00:00Z").count() == 0


def test_ingest(spark):
    ev = {"id": "e1", "kind": "bug", "source": "nub", "clientTs": "2026-01-02T03:04:05Z", "body": "hi"}
    lines = spark.createDataFrame([(json.dumps({"v": 0, "project": p, "events": [ev, ev | {"id": "old"}]}),) for p in ("p", "q")], "value string")
    acc, dup, bad = api.ingest(spark, lines, spark.createDataFrame([("p", "old")], "project_id string, id string"), "p")
    assert [r.id for r in acc.collect()] == ["e1"] and [r.id for r in dup.collect()] == ["old"] and bad.count() == 1
