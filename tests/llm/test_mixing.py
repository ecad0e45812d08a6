import random

from feedloom.llm import mixing


def docs(spark, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        source = rng.choices(["big", "mid", "small", None], [0.7, 0.2, 0.05, 0.05])[0]
        rows.append((k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(1, 60))), source, "x"))
    rows += [(700, None, "big", "x"), (701, "", "big", "x"), (702, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.2, 2), ("none", 0.0, 1), ("absent", 0.01, None)]


def test_plan_and_mixture(spark):
    sized = mixing.sizes(docs(spark))
    plan = mixing.plan(sized, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    p = {r.source: r for r in plan.collect()}
    rows = sized.collect()
    total = sum(r.tokens for r in rows)
    distinct = {s: sum({r.text_key: r.tokens for r in rows if r.source == s}.values()) for s in p}
    for s, r in p.items():
        assert (r.supply or 0) == distinct[s]
        assert r.short == ((r.target_share or 0) * total > distinct[s] * (r.max_repeats or 1))
    assert {r.source: r.short for r in mixing.supplies(sized, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")).collect()} == {s: r.short for s, r in p.items()}
    used = mixing.mixture(sized, plan).collect()
    for s, r in p.items():
        own = [u for u in used if u.source == s]
        assert sum(u.tokens * u.copies for u in own) == r.reached and all(u.copies <= r.max_repeats for u in own)
        if not r.short and r.supply:
            assert r.goal - 100 <= r.reached <= r.goal  # within one text of the budget
    assert len({u.doc_id for u in used}) == len(used) and 702 not in {u.doc_id for u in used}


def test_shares_and_empty(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    s = mixing.shares(mixing.plan(mixing.sizes(docs(spark)), t)).collect()
    assert abs(sum(r.actual_share for r in s) - 1) < 1e-9
    e = mixing.plan(mixing.sizes(docs(spark).limit(0)), t).collect()
    assert len(e) == 5 and all(r.reached == 0 for r in e)


def test_token_counts_match_the_library(spark):
    from pyspark.sql import functions as F

    enc = mixing._encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    texts = ["Hello, world!", "", "  spaces   and\nlines ", "<|endoftext|> ünïcode 123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(mixing.token_count(F.col("t")).alias("n")).collect()] == [len(enc.encode_ordinary(t)) for t in texts]
