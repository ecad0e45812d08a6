import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom import runtime
from feedloom.functions import bags
from feedloom.functions.text import tokenize
from feedloom.operators import vectors


def corpus(spark, n=300, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghinorstuxz") for _ in range(r.randint(1, 7))) + r.choice(["", "", "s", "es", "ies", "sses", "ing", "ed", "ches", "us", "lling", "pped"]) for _ in range(400)] + ["The", "add", "İKK9", "a1-b2"]
    rows = [(k, " ".join(r.choice(words[: 20 + 4 * (k % 90)]) for _ in range(r.randint(0, 30)))) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "dogs"), (None, rows[1][1]), (1, "a second text of the first id running")], "doc_id bigint, text string")


def test_bags_are_the_tokens_of_the_expression(spark):
    docs = corpus(spark)
    want = {(d, t): n for d, t, n in vectors.term_counts(docs.select("doc_id", tokenize(F.col("text")).alias("tokens")), F.col("tokens")).collect()}
    got = Counter({(r.doc_id, t): n for r in bags.token_bags(docs, "doc_id", "text").collect() for t, n in zip(r.terms, r.tf)})
    assert len(want) > 1000 and got == want


@pytest.mark.parametrize("small", [False, True])
def test_matches_are_those_of_the_join_and_shuffle_none_of_it(spark, monkeypatch, small):
    docs = corpus(spark)
    n = docs.count()
    counts = vectors.term_counts(docs.select("doc_id", tokenize(F.col("text")).alias("tokens")), F.col("tokens"))
    long = vectors.tfidf(counts, vectors.document_frequency(counts, n))
    want = {(q, d): c for q, d, c in vectors.query_cosines(long, long.filter("doc_id % 4 = 0")).filter("cosine >= 0.2").collect()}
    if small:  # the vocabulary is joined, several blocks of queries, several steps a batch
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(vectors, "MATCH_QUERIES", 20)
        monkeypatch.setattr(vectors, "MATCH_CELLS", 300)
    v = runtime.written(vectors.bag_vectors(bags.token_bags(docs, "doc_id", "text"), n, "doc_id"), "test-bags")
    found = vectors.cosine_matches(v, v.filter("doc_id % 4 = 0"), 0.2)
    rows = found.collect()
    got = {(r.query_id, r.doc_id): r.cosine for r in rows}
    assert len(want) > 500 and len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - c) < 1e-9 for k, c in want.items())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_queries_no_terms(spark):
    docs = spark.createDataFrame([(1, "the"), (2, None)], "doc_id bigint, text string")
    v = vectors.bag_vectors(bags.token_bags(docs, "doc_id", "text"), 2, "doc_id")
    assert v.count() == 0 and vectors.cosine_matches(v, v, 0.3).count() == 0


def test_registered_query_shuffles_no_pairs(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["sparse_cosine_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
