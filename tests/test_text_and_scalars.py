import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import hashing, scalars, text


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.o for r in df.select(f(F.col("v")).alias("o")).collect()]


def test_normalize(spark):
    assert col(spark, ["Hello,  World!", "  café\n", "", None], text.normalize) == ["hello world", "caf", "", None]


@pytest.mark.parametrize("word,want", [("as", "as"), ("queries", "query"), ("classes", "class"), ("buses", "bus"), ("boxes", "box"), ("matches", "match"), ("exports", "export"), ("status", "status"), ("class", "class"), ("running", "run"), ("seeing", "see"), ("stopped", "stop"), ("agreed", "agre"), ("sing", "sing"), ("red", "red")])
def test_stem(spark, word, want):
    assert col(spark, [word], text.stem) == [want]


def test_tokenize(spark):
    f = lambda c: text.tokenize(c, bigrams=True)
    assert col(spark, ["Please add CSV exports to the billing pages", "the of", "", None], f) == [["csv", "export", "bil", "page", "csv_export", "export_bil", "bil_page"], [], [], None]


def test_shingles(spark):
    assert col(spark, [" abcd ", "ab", "", "abc"], text.shingles) == [["abc", "bcd"], ["ab"], [], ["abc"]]


def test_scrub(spark):
    a, b = col(spark, ["Timeout after 30012ms fetching order A-4471", "Timeout after 28004ms fetching order B-9982"], text.scrub_variable_data)
    assert a == b
    got = col(spark, ["id 123e4567-e89b-12d3-a456-426614174000 at 2026-01-02T03:04:05Z 0xff 12 plain"], text.scrub_variable_data)[0]
    assert got == "id <uuid> at <ts> <hex> <num> plain"


def test_cap(spark):
    assert col(spark, ["abcdef", "abc", None], lambda c: text.cap(c, 3)) == ["abc…[+3]", "abc", None]
    assert col(spark, ["abc"], lambda c: text.cap(c, 0)) == [""]


def test_mrr_and_identity(spark):
    assert col(spark, ["$4,000", "", "n/a", "-50", "0", "NaN", "true", None, "12.5"], scalars.parse_mrr) == [4000.0, None, None, None, None, None, None, None, 12.5]
    df = spark.createDataFrame([("x", "y"), ("", "y"), (None, " "), (None, None)], "e string, a string")
    got = df.select(scalars.resolve_user(F.col("e"), F.col("a"), F.lit("d:1")).alias("u")).collect()
    assert [(r.u.user_id, r.u.attributed) for r in got] == [("u:x", True), ("a:y", True), ("d:1", False), ("d:1", False)]


def test_derived_ids(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", None)], "a string, b string")
    ids = [r.i for r in df.select(scalars.derived_id(F.col("a"), F.col("b")).alias("i")).collect()]
    assert len(set(ids)) == 3 and all(re.fullmatch("im_[0-9a-f]{16}", i) for i in ids)


def test_instants(spark):
    got = col(spark, ["1776421604", "1776421604000", "20260101", "2026-01-01T00:00:00Z", "x", None], lambda c: F.unix_seconds(scalars.instant(c)))
    assert got == [1776421604, 1776421604, None, 1767225600, None, None]


def test_ulid(spark):
    assert col(spark, ["01ARZ3NDEKTSV4RRFFQ69G5FAV", "nope", None], scalars.ulid_millis) == [1469922850259, None, None]


def fnv(s):
    h = 0x811C9DC5
    for ch in s:
        h = ((h ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    return h


def test_fnv1a(spark):
    values = ["", "a", "hello world", "x" * 300]
    assert col(spark, values, hashing.fnv1a) == [fnv(v) for v in values]


def slow_simhash(t, size=3):
    t = t.strip()
    if not t:
        return 0
    votes = [0] * 64
    for g in [t] if len(t) <= size else [t[i:i + size] for i in range(len(t) - size + 1)]:
        low, high = 0x811C9DC5, 0x9E3779B9
        for ch in g:
            low = ((low ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
        for ch in reversed(g):
            high = ((high ^ ord(ch)) * 0x85EBCA6B) & 0xFFFFFFFF
        h = high << 32 | low
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    v = sum(1 << b for b in range(64) if votes[b] > 0)
    return v - (1 << 64) if v >> 63 else v


def test_simhash_and_bands(spark):
    values = ["", "ab", "the csv export is broken", "the csv exports are broken", "x" * 5000]
    fps = col(spark, [*values, None], hashing.simhash)
    assert fps[:-1] == [slow_simhash(v) for v in values] and fps[-1] is None
    df = spark.createDataFrame([(f,) for f in fps[:-1]], "fp long")
    chunks = df.select([hashing.band_chunk(F.col("fp"), F.lit(b)).alias(f"b{b}") for b in range(8)]).collect()
    for r, f in zip(chunks, fps):
        assert sum(r[f"b{b}"] << (8 * b) for b in range(8)) == f & (2**64 - 1)
    with pytest.raises(ValueError):
        hashing.band_chunk(F.lit(1), F.lit(0), 7)
