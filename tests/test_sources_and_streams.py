import json

import pytest

from feedloom.sources import delimited, envelopes, store
from feedloom.streaming import ingest, late


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿Ticket_ID, Created_At,description,mrr,type\r\nT1,2026-05-01T00:00:00Z,"a, ""b""\nc","$4,000",bug\r\nT2,1776421604,x,,odd\r\n')
    r = delimited.to_submissions(delimited.bind(delimited.read_records(spark, p)), "p").orderBy("id").collect()
    assert [(x.id, x.body.replace("\r", ""), x.mrr, x.kind, x.attributed) for x in r] == [("T1", 'a, "b"\nc', 4000.0, "bug", False), ("T2", "x", None, "feature_request", False)]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.read_records(spark, write(tmp_path / "d.csv", "a,A\n1,2\n"), ",")
    with pytest.raises(ValueError):
        delimited.read_records(spark, "x", ";;")
    with pytest.raises(Exception):
        delimited.read_records(spark, write(tmp_path / "r.csv", "a,b\n1,2,3\n")).collect()


LINE = dict(id="s1", project_id="p", kind="bug", source="api", body="x", cluster_text="x", user_id="u:1", attributed=True, client_ts="2026-01-01T00:00:00Z", received_at="2026-01-01T00:00:00Z", ingest_seq=1)


def test_jsonl(spark, tmp_path):
    lines = [json.dumps(LINE), json.dumps(LINE | {"ingest_seq": 2, "body": "later"}), "{broken", json.dumps(LINE | {"id": "s2", "user_id": None}), json.dumps(LINE | {"id": "s3", "extra": 1})]
    good, bad = store.read_jsonl(spark, write(tmp_path / "l.jsonl", "\n".join(lines)))
    assert sorted((r.id, r.body) for r in good.collect()) == [("s1", "x"), ("s3", "x")]
    assert [r._corrupt for r in bad.collect()] == ["{broken"]


def test_split_new(spark):
    old = spark.createDataFrame([("p", "a")], "project_id string, id string")
    new = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "b", 3), ("q", "a", 4)], "project_id string, id string, ingest_seq long")
    acc, dup = store.split_new(new, old)
    assert sorted((r.project_id, r.id, r.ingest_seq) for r in acc.collect()) == [("p", "b", 2), ("q", "a", 4)]
    assert sorted(map(tuple, dup.collect())) == [("p", "a"), ("p", "b")]


def envelope(events, v=0):
    return json.dumps({"v": v, "sentAt": "x", "project": "p", "events": events})


EVENT = {"id": "e1", "kind": "bug", "source": "nub", "clientTs": "2026-01-02T03:04:05Z", "body": "hi", "user": {"externalId": "7", "traits": {"mrr": "$40"}}, "context": {"route": "/r"}}


def test_envelopes(spark):
    df = spark.createDataFrame([(envelope([EVENT, EVENT | {"id": "e2", "user": None, "body": None}, EVENT | {"id": "e3", "clientTs": "bad"}]),), (envelope([EVENT], 1),), ("{",), (envelope([]),)], "value string")
    parsed = envelopes.parse(df)
    assert [r.reason for r in parsed.collect()] == [None, "version", "malformed", None]
    rows = {r.id: r for r in envelopes.to_submissions(parsed).collect()}
    assert set(rows) == {"e1", "e2"} and rows["e1"].user_id == "u:7" and rows["e1"].mrr == 40.0 and rows["e2"].user_id == "d:2026-01-02" and rows["e2"].body == ""


def test_idempotent_stream_and_late_state(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    for k in range(2):
        write(src / f"{k}.txt", envelope([EVENT, EVENT | {"id": f"x{k}"}]) + "\n")
        q = spark.readStream.text(str(src)).writeStream.foreachBatch(ingest.idempotent_writer(spark, out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["e1", "x0", "x1"]

    batches = [[("p", "a", "2026-01-01T05:00:00Z", "2026-01-01T06:00:00Z", 1, "u")], [("p", "b", "2026-01-01T05:00:00Z", "2026-01-03T06:00:00Z", 2, "u"), ("p", "c", "2026-01-01T05:00:00Z", "2026-02-03T06:00:00Z", 3, "w")]]
    w = late.batch_writer(state, "user_id")
    for k in (0, 1, 1):
        b = spark.createDataFrame(batches[k], "project_id string, id string, c string, r string, ingest_seq long, user_id string").selectExpr("project_id", "id", "timestamp(c) client_ts", "timestamp(r) received_at", "ingest_seq", "user_id")
        w(b, k)
    assert [(r.value, r.on_time, r.corrections) for r in late.read_state(spark, state).collect()] == [("u", 1, 1)]
    late.compact(spark, state, str(tmp_path / "c"))
    assert late.read_state(spark, str(tmp_path / "c")).count() == 1


def test_assignment_stream(spark, tmp_path):
    src = tmp_path / "docs"
    src.mkdir()
    write(src / "a.json", "\n".join(json.dumps({"project_id": "p", "id": f"d{k}", "tokens": t, "seq": k}) for k, t in enumerate([["csv", "export"], ["dark", "mode"], ["csv", "export"]])))
    docs = spark.readStream.schema("project_id string, id string, tokens array<string>, seq long").json(str(src))
    q = ingest.assign_stream(docs).writeStream.format("memory").queryName("assigned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.cluster_id for r in spark.table("assigned").collect()}
    assert got["d0"] == got["d2"] != got["d1"]


def test_stored_facts_are_the_first_writes(spark):
    rows = [("p", "a", 3, "x"), ("p", "a", 1, "y"), ("p", "b", 2, "z"), ("q", "a", 4, None), (None, "a", 6, "u"), (None, "a", 5, "v"), ("p", None, 7, "w"), ("p", None, 8, "w")]
    df = spark.createDataFrame(rows, "project_id string, id string, ingest_seq long, body string")
    got = {tuple(r) for r in store.stored_facts(df).select("project_id", "id", "ingest_seq", "body").collect()}
    assert got == {tuple(r) for r in store.first_writes(df).select("project_id", "id", "ingest_seq", "body").collect()} and len(got) == 5
    assert store.stored_facts(df.limit(0)).count() == 0
