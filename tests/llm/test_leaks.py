import random
import re

from feedloom.llm import leaks


def grams(t, n=13):
    w = re.findall(r"[^\W_]+", re.sub(r"</?[A-Za-z][^<>]*>|&\w+;", " ", t).lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(30, 50)))) for k in range(20)]
    docs = []
    for k in range(120):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split()
            n = rng.randrange(9, 20)
            s = rng.randrange(len(w) - n)
            cut = w[s:s + n]
            words[len(words) // 2:len(words) // 2] = [f"<b>{cut[0].upper()}</b>,", *cut[1:]]
        docs.append((k, (" " if k % 2 else "\n> ").join(words)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (903, items[0][1]), (904, "x " * 20_000)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")).collect()}
    want = {(d, i) for d, t in docs if t for i, u in items if grams(t) & grams(u)}
    assert got == want and (903, 0) in got
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    joined = {(r.doc_id, r.item_id) for r in leaks.leaks(d, i, send=0).collect()}
    assert joined == want


def test_markup_of_any_length_breaks_no_run(spark):
    words = [f"v{k}" for k in range(40)]
    tag = "<span class='" + "x" * 5000 + "'>"
    docs = [("a", " ".join(words[:20]).replace("v7", tag + "v7</span>")), ("b", " ".join(words[:6]) + " if a &lt; b " + " ".join(words[6:14])), ("c", " ".join(words[27:40])), ("d", " ".join(words[28:40]))]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")).collect()
    assert {(r.doc_id, r.longest_run) for r in got} == {("a", 20), ("c", 13)}


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(d, i).count() == 0
