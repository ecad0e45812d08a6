import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from feedloom import api, runtime
from feedloom.functions import scalars
from feedloom.operators import clustering, corpus, embed, logs, queues, reports, vectors
from feedloom.sources import envelopes, inbound, store

NOW = "2026-05-01T00:00:00Z"


def test_capture_defaults_and_refusal(spark):
    r = inbound.captured(spark, {"body": "no map", "external_id": "7", "mrr": "$1,200"}, "p", NOW).collect()[0]
    assert (r.kind, r.source, r.user_id, r.attributed, r.mrr, r.client_ts) == ("feature_request", "api", "u:7", True, 1200.0, dt.datetime(2026, 5, 1))
    assert r.id.startswith("im_") and inbound.captured(spark, {"body": "x", "id": "k", "kind": "bug"}, "p", NOW).collect()[0].user_id == "d:2026-05-01"
    for body in (None, "", "  "):
        with pytest.raises(ValueError):
            inbound.captured(spark, {"body": body}, "p", NOW)


def test_anything_thrown_is_described(spark):
    cases = ['{"name": "TypeError", "message": "x is 3", "stack": "s"}', '{"message": "bare"}', '"just text"', "42", '{"code": 7}', None, ""]
    got = [tuple(r.d) for r in spark.createDataFrame([(c,) for c in cases], "t string").select(inbound.described(F.col("t")).alias("d")).collect()]
    assert got == [("TypeError", "x is 3", "s"), ("Error", "bare", None), ("Error", "just text", None), ("Error", "42", None), ("Error", '{"code": 7}', None), ("Error", "unknown", None), ("Error", "", None)]


def test_exceptions_become_bugs(spark):
    rows = [("E", "slot 12 taken", None, None, dt.datetime(2026, 5, 1)), ("E", "slot 99 taken", None, "u:1", dt.datetime(2026, 5, 1)), (None, None, None, " ", dt.datetime(2026, 5, 2))]
    got = inbound.exceptions_as_submissions(spark.createDataFrame(rows, "name string, message string, stack string, user_id string, client_ts timestamp"), "p").collect()
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[0].body == "E: slot 12 taken" and got[0].cluster_text == "E: slot <num> taken"
    assert got[0].user_id == f"x:{got[0].fingerprint}:2026-05-01" and not got[0].attributed and got[1].user_id == "u:1" and got[2].body == "Error: "


def test_import_is_sorted_and_counts(spark):
    rows = spark.createDataFrame([("p", "b", 3), ("p", "a", 1), ("p", "a", 2), ("p", "old", 0)], "project_id string, id string, t long").select("project_id", "id", F.timestamp_seconds("t").alias("client_ts"))
    new, result = inbound.imported(rows, spark.createDataFrame([("p", "old")], "project_id string, id string"))
    assert [(r.id, r.client_ts.second) for r in new.collect()] == [("a", 1), ("b", 3)] and tuple(result.collect()[0]) == (4, 2, 2)
    assert tuple(inbound.imported(rows.limit(0), rows)[1].collect()[0]) == (0, 0, 0)


def test_rejected_lines_and_events_are_kept(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": "1"}\n{broken\n\n')
    good, bad = store.read_jsonl(spark, str(tmp_path / "s.jsonl"))
    assert good.count() == 0 and bad.count() == 1
    lacking = store.lacking_jsonl(spark, str(tmp_path / "s.jsonl")).collect()
    assert [(r.value, r.fields[0], len(r.fields)) for r in lacking] == [('{"id": "1"}', "project_id", 7)]
    lines = spark.createDataFrame([('{"v": 0, "project": "p", "events": [{"id": "a", "kind": "bug", "clientTs": "nope"}, {"kind": "bug", "clientTs": "2026-05-01T00:00:00Z"}, {"id": "c", "kind": "bug", "clientTs": "2026-05-01T00:00:00Z", "element": {"selector": "#x"}, "context": {"custom": {"k": "v"}}}]}',)], "value string")
    parsed = envelopes.parse(lines)
    assert sorted((r.id or "", r.reason) for r in envelopes.rejected_events(parsed).collect()) == [("", "id"), ("a", "time")]
    kept = envelopes.to_submissions(parsed).collect()
    assert [r.id for r in kept] == ["c"] and kept[0].element.selector == "#x" and kept[0].custom == {"k": "v"}


def test_retry_headers_and_backoff(spark):
    now = F.lit("2026-05-01T00:00:00Z").cast("timestamp")
    cases = ["3", " 0 ", "Fri, 01 May 2026 00:00:10 GMT", "Thu, 30 Apr 2026 00:00:00 GMT", "soon", "", None]
    got = [r.m for r in spark.createDataFrame([(c,) for c in cases], "h string").select(scalars.retry_after_ms(F.col("h"), now).alias("m")).collect()]
    assert got == [3000, 0, 10_000, 0, None, None, None]
    r = spark.range(1).select(scalars.backoff_delay(F.lit(3), 100, 500, F.lit(0.5)).alias("a"), scalars.backoff_delay(F.lit(1), 100, 500, F.lit(0.999)).alias("b"), scalars.retry_after_seconds(F.lit(1)).alias("c"), scalars.retry_after_seconds(F.lit(2001)).alias("d")).collect()[0]
    assert tuple(r) == (250, 199, 1, 3)


def test_days_do_not_follow_the_session_zone(spark):
    t = spark.createDataFrame([(-1,), (86_399_999_999,), (86_400_000_000,)], "us long").select(F.timestamp_micros("us").alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [r.d for r in t.select(scalars.day_key(F.col("t")).alias("d")).collect()] == ["1969-12-31", "1970-01-01", "1970-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_transport_actions_queue_and_logs(spark):
    cases = [(200, 0, False, 5), (401, 0, False, 5), (413, 0, False, 5), (413, 0, True, 5), (413, 0, True, 1), (429, 1, False, 5), (429, 4, False, 5), (None, 2, False, 5), (503, 4, False, 5), (400, 0, False, 5), (404, 9, False, 5)]
    got = [r.a for r in spark.createDataFrame(cases, "s int, n int, x boolean, k int").select(queues.flush_action(F.col("s"), F.col("n"), F.col("x"), F.col("k")).alias("a")).collect()]
    assert got == ["acknowledge", "disable", "strip", "halve", "drop", "wait", "keep", "retry", "keep", "drop", "drop"]
    ev = spark.createDataFrame([("c", k) for k in range(45)], "client string, seq long")
    assert [r["count"] for r in queues.batches(ev).groupBy("batch").count().orderBy("batch").collect()] == [20, 20, 5] and [r.seq for r in queues.peek(ev, 2).collect()] == [0, 1]
    lines = spark.createDataFrame([("debug", "x"), ("WARN", "mail a@b.example"), ("error", "y" * 600), ("odd", "z"), ("info", None)], "level string, message string")
    out = [r.message for r in logs.emitted(lines).collect()]
    assert out == ["mail [redacted:email]", "y" * 512 + "…[+88]", ""]


def test_routes(spark):
    cases = [("GET", "/v0/health", 200), ("post", "/v0/ingest", 200), ("GET", "/v0/ingest", 405), ("GET", "/v0/issues?limit=3", 200), ("GET", "/v0/issues/abc/", 200), ("GET", "/v0/issues/abc/submissions", 200), ("GET", "/v0/issues/a/b", 404), ("GET", "/v1/health", 404), ("GET", "/", 404), ("GET", None, 404), (None, "/v0/health", 405)]
    got = [r.status for r in api.dispatch(spark.createDataFrame([c[:2] for c in cases], "method string, path string")).collect()]
    assert got == [c[2] for c in cases]


def test_embedding_answers_oracle_and_cache(spark):
    cases = [('{"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}', 2), ('{"data": [{"index": 0, "embedding": [1]}]}', 2), ('{"data": [{"index": 1, "embedding": [1]}, {"index": 1, "embedding": [1]}]}', 2),
             ('{"data": [{"index": 0, "embedding": [1, 2]}, {"index": 1, "embedding": [1]}]}', 2), ("nonsense", 1), ('{"data": []}', 0), (None, 1)]
    got = [r.v for r in spark.createDataFrame(cases, "a string, n int").select(embed.parse_response(F.col("a"), F.col("n")).alias("v")).collect()]
    assert got == [[[0.6, 0.8], [0.0, 1.0]], None, None, None, None, [], None]
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "label string, text string")
    pure = [r.v for r in df.select(embed.oracle_embedding(F.col("label"), F.col("text")).alias("v")).collect()]
    mixed = [r.v for r in df.select(embed.oracle_embedding(F.col("label"), F.col("text"), 0.5).alias("v")).collect()]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    assert pure[3] is None and math.isclose(dot(pure[0], pure[1]), 1) and abs(dot(pure[0], pure[2])) < 0.6 and 0.2 < dot(mixed[0], mixed[1]) < 0.999 and len(pure[0]) == 64
    assert [embed.resolve(s) for s in ({}, {"embedder": "hashing"}, {"embedder": "endpoint"}, {"embedder": "endpoint", "url": "u", "model": "m"}, {"embedder": "??"})] == ["none", "hashing", "none", "endpoint", "none"]
    texts = spark.createDataFrame([("1", "k"), ("2", "new"), ("3", "new"), ("4", None)], "id string, text string")
    cache = spark.createDataFrame([("m", "k", [1.0]), ("o", "new", [2.0])], "model string, text string, vector array<double>")
    assert tuple(embed.cache_statistics(texts, cache, "m").collect()[0]) == (1, 1, 1)
    full, made = embed.with_cache(texts, cache, "m", lambda c: F.array(F.length(c).cast("double")))
    assert {r.id: r.vector for r in full.collect()} == {"1": [1.0], "2": [3.0], "3": [3.0], "4": None} and made.count() == 1


def test_reports(spark):
    t = spark.createDataFrame([("x", "p1", 5), ("x", "p2", 4), ("y", "p2", 1), ("y", "p3", 9)], "truth string, predicted string, n long")
    pos = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3)], "label string, position int")
    assert [tuple(r) for r in reports.fragmentation(t, pos, 3).collect()] == [("x", 2)]
    w, f = spark.createDataFrame([("a", 1), ("b", 2)], "cluster_id string, position int"), spark.createDataFrame([("b", 1)], "cluster_id string, position int")
    assert sorted(map(tuple, reports.movement(w, f).collect())) == [("a", 1, 2, 1), ("b", 2, 1, -1)]
    assert [r.line for r in reports.as_text(spark.createDataFrame([("ab", 7, None)], "a string, n int, b string"), ["a", "n", "b"], [4, 3, 0]).collect()] == ["ab      7  -"]
    cells = spark.createDataFrame([(0, 9, 0.5, 0.2, True), (1, 6, 0.5, 0.2, False), (2, 6, 0.0, 0.3, False)], "cell int, hits int, semantic_weight double, threshold double, degenerate boolean")
    assert corpus.sweep_winner(cells).collect()[0].cell == 2 and corpus.sweep_winner(cells.filter("cell = 0")).collect()[0].cell == 0


def test_batch_clustering_with_corpus_weights_vectors_and_bonus(spark):
    rows = [("p", "1", ["map", "tile"], "k", [1.0, 0.0], 1), ("p", "2", ["clock"], "k", [1.0, 0.1], 2), ("p", "3", ["tile"], "z", [0.0, 1.0], 3), ("p", "4", ["other"], "k", None, 4)]
    docs = spark.createDataFrame(rows, "project_id string, id string, tokens array<string>, key string, vector array<double>, seq long")
    label = lambda **how: {r.id: r.cluster_id for r in clustering.leader_follower(docs, **how).collect()}
    assert label(threshold=0.5)["2"] != label(threshold=0.5)["1"]
    assert label(threshold=0.5, semantic_weight=1.0)["2"] == "c0" and label(threshold=0.5, structural_bonus=0.9)["4"] == "c0"
    idf = spark.createDataFrame([("p", "tile", 1.0), ("p", "map", 1e-6), ("p", "clock", 1.0)], "project_id string, term string, idf double")
    got = {r.id: (r.cluster_id, round(r.similarity, 3)) for r in clustering.leader_follower(docs.drop("vector"), threshold=0.5, idf=idf).collect()}
    assert got["3"] == ("c0", 1.0) and got["4"] == ("c2", 0.0) and len(got) == 4


def test_cosines_by_blocks(spark, monkeypatch):
    import random

    rng = random.Random(2)
    vecs = {k: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for k in range(60)}
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>").repartition(3)
    q = df.filter(F.col("vec_id") % 20 == 0)

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    got = {(r.query_id, r.vec_id): r.cosine for r in vectors.all_cosines(df, q).collect()}
    assert len(got) == 180 and all(math.isclose(v, cos(vecs[a], vecs[b]), abs_tol=1e-12) for (a, b), v in got.items())
    near = sorted((r.query_id, -r.cosine, r.vec_id) for r in vectors.nearest(df, q, 3).collect())
    want = sorted(x for a in (0, 20, 40) for x in sorted((a, -round(cos(vecs[a], vecs[b]), 5), b) for b in vecs if b != a)[:3])
    assert [(a, b) for a, _, b in near] == [(a, b) for a, _, b in want]
    assert vectors.nearest(df.limit(0), q, 3).count() == 0
    assert [r.seq for r in vectors.positions(df, "vec_id").orderBy("vec_id").collect()] == list(range(1, 61))


def test_a_side_is_broadcast_only_if_it_is_small(spark, monkeypatch):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.createDataFrame([(1, "x" * 100)], "a int, t string")
    assert hinted(runtime.maybe_broadcast(df)) and not hinted(runtime.maybe_broadcast(df, 10**9))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 50)
    assert not hinted(runtime.maybe_broadcast(df)) and hinted(runtime.maybe_broadcast(df.select("a"), 1))


def test_a_restored_index_assigns_as_the_old_one_would():
    import random

    rng = random.Random(6)
    records = [([f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 8))], rng.choice("ab"), [rng.random(), rng.random()] if k % 3 else None) for k in range(120)]
    for how in ({}, {"structural_bonus": 0.2, "semantic_weight": 0.4}):
        whole = clustering.Leader(0.3, **how)
        half = clustering.Leader(0.3, **how)
        want = [whole.assign(*r) for r in records]
        got = [half.assign(*r) for r in records[:60]]
        half = clustering.Leader.from_json(half.to_json())
        assert got + [half.assign(*r) for r in records[60:]] == want
    with pytest.raises(ValueError):
        clustering.Leader.from_json(half.to_json().replace('"version": 1', '"version": 2'))
