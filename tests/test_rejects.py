import pytest

from feedloom.operators import rejects

HEAD = "﻿Ticket_ID,requester, Created_At,message,MRR,kind,page"
GOOD = "T-1,c,2026-05-13T16:17:54Z,hello,5,bug,/x"


def load(spark, records, header=HEAD, delim=","):
    raw = [("e", 0, header)] + [("e", i + 1, r) for i, r in enumerate(records)]
    df = spark.createDataFrame([(a, b, c, "clash") for a, b, c in raw], "export_id string, rec_no int, raw string, reason string").drop("reason")
    ex = spark.createDataFrame([("e", delim)], "export_id string, delim string")
    return {r.rec_no: r for r in rejects.load_exports(df, ex).collect()}


def test_reasons(spark):
    cases = [
        (GOOD, None), (GOOD + "\r", None), ('T-1,c,2026-05-13T16:17:54Z,"a ""b"", c\nd",5,bug,/x', None), ('"T-2","c","2026-05-13T16:17:54Z","x","","",""', None),
        ('T-1,c,2026-05-13T16:17:54Z,he "quoted" it,5,bug,/x', "broken_quoting"), ('T-1,c,2026-05-13T16:17:54Z,"open,5,bug,/x', "broken_quoting"), ('T-1,c,2026-05-13T16:17:54Z,"a" b,5,bug,/x', "broken_quoting"),
        ("T-1,c,2026-05-13T16:17:54Z,hello,5,bug", "wrong_column_count"), (GOOD + ",more", "wrong_column_count"), ("x", "wrong_column_count"),
        ("T1,c,2026-05-13T16:17:54Z,hello,5,bug,/x", "invalid_value"), ("T-١,c,2026-05-13T16:17:54Z,hello,5,bug,/x", "invalid_value"), ("T-1,c,2026-02-30T16:17:54Z,hello,5,bug,/x", "invalid_value"),
        ("T-1,c,2026-05-13T24:17:54Z,hello,5,bug,/x", "invalid_value"), ("T-1,c,2026-05-13T16:17:54Z,  ,5,bug,/x", "invalid_value"), ("T-1,c,2026-05-13T16:17:54Z,a�b,5,bug,/x", "invalid_value"),
        (" T-1 ,c, 2026-05-13T16:17:54Z ,hello,whatever,??,", None), (GOOD, None),
    ]
    got = load(spark, [c for c, _ in cases])
    assert [got[i + 1].reason for i in range(len(cases))] == [r for _, r in cases]
    assert got[3].body == 'a "b", c\nd'


def test_blank_rows_and_nulls_are_no_records(spark):
    assert load(spark, ["", "\r", "  ", None]) == {}


@pytest.mark.parametrize("delim", ["|", ";", "\t", "'"])
def test_delimiters(spark, delim):
    got = load(spark, [GOOD.replace(",", delim), f'T-1{delim}c'], HEAD.replace(",", delim), delim)
    assert [got[1].reason, got[2].reason] == [None, "wrong_column_count"]


def test_no_usable_header(spark):
    assert load(spark, ["a,b"], "foo,bar")[1].reason == "no_header"
    assert load(spark, ["a,b"], None)[1].reason == "no_header"
    assert load(spark, ["a,b"], HEAD, None)[1].reason == "no_header"


def test_one_broken_record_among_many_spoils_no_other(spark):
    recs = [GOOD.replace("T-1", f"T-{i}") for i in range(300)]
    recs[37] = 'T-37,c,2026-05-13T16:17:54Z,"open,5,bug,/x'
    recs[38] = 'T-38,c,2026-05-13T16:17:54Z,"fine, here",5,bug,/x'
    got = load(spark, recs)
    assert [i for i in range(300) if got[i + 1].reason] == [37] and got[39].body == "fine, here"


def test_equals_the_grammar_on_random_records(spark):
    import random

    rng = random.Random(3)
    pieces = ['a', '"', '""', ',', 'x y', '\n', '"q"', '"a,b"', ' ', 'T-1', '2026-05-13T16:17:54Z', '"c\r\nd"', "\r"]
    records = []
    for k in range(1500):
        fields = [f"T-{k}", "c", "2026-05-13T16:17:54Z", "hello", "5", "bug", "/x"]
        for _ in range(rng.choice([0, 1, 1, 2])):
            fields[rng.randrange(7)] = "".join(rng.choices(pieces, k=rng.randrange(1, 5)))
        if rng.random() < 0.1:
            fields.pop(rng.randrange(7))
        records.append(",".join(fields))
    got = load(spark, records)

    def reason(raw):
        fields = rejects.split_record(raw, ",")
        if fields is None:
            return "broken_quoting"
        if len(fields) != 7:
            return "wrong_column_count"
        ok = fields[0].strip() in {f"T-{k}" for k in range(1500)} and fields[3].strip() and fields[2].strip() == "2026-05-13T16:17:54Z"
        return None if ok else "invalid_value"

    for k, raw in enumerate(records):
        if raw.strip():
            assert got[k + 1].reason == reason(raw), raw
            if got[k + 1].reason is None:
                assert got[k + 1].body == rejects.split_record(raw, ",")[3]


def test_typed(spark):
    df = spark.createDataFrame([("e", 0, HEAD), ("e", 1, "T-1,,2026-05-13T16:17:54Z,hello,\"$4,000\",,")], "export_id string, rec_no int, raw string")
    ex = spark.createDataFrame([("e", ",")], "export_id string, delim string")
    r = rejects.valid(rejects.load_exports(df, ex)).collect()[0]
    assert (r.ticket_id, r.mrr, r.requester_id, r.kind) == ("T-1", 4000.0, None, None)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "export_id string, rec_no int, raw string")
    assert rejects.load_exports(df, spark.createDataFrame([], "export_id string, delim string")).count() == 0
