import random

from pyspark.sql import functions as F

from feedloom.llm import spam


def test_keyword_and_link_pages_are_told_from_text(spark):
    rng = random.Random(6)
    roots = ["plan", "driv", "weld", "till", "roof", "paint", "buy", "guid", "clean", "build"]
    who = [f"the {r}er" for r in roots] + [f"our {r}ing team" for r in roots]
    does = [f"{v} {p} the" for v in ("opens", "moves", "checks", "writes", "closes", "counts") for p in ("down", "up", "back")]
    what = [f"{a} {n}" for a in ("old", "new", "red", "tall") for n in ("winch", "depot", "pump", "crane", "gate", "hoist")]
    page = lambda n: " ".join(f"{rng.choice(who)} {rng.choice(does)} {rng.choice(what)}." for _ in range(n // 2))
    good = [page(12) for _ in range(400)] + [page(12) + "\nTags: cheap crane, crane rental" for _ in range(10)] + [page(12) + "\nhttps://a.example/x/y" for _ in range(10)]
    stuffed = [" ".join(rng.choices(["cheap", "crane", "rental", "deal", "online", "best"], k=80)) for _ in range(8)]
    clocked = ["\n".join(["12:00:07 cheap crane rental deal online best"] * 40), "\n".join(f"2026-01-01 12:00:{k:02d} " + " ".join(rng.choices(["buy", "sell", "swap", "lease", "hire"], k=6)) for k in range(30))]
    links = ["\n".join(f"{k}. https://h{k}.example/p{rng.randrange(999)}/q" for k in range(30)) for _ in range(4)]
    logs = [page(4) + "\n" + "\n".join(f"2026-01-01T10:{k:02d}:11 WARN esk code={k} retry" for k in range(20)) for _ in range(4)]
    texts = good + stuffed + clocked + links + logs + [None, "", "one"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    n = len(good)
    assert got == set(range(n, n + len(stuffed) + len(clocked) + len(links)))
    a, b = (sorted(map(tuple, spam.page_scores(df, send).collect())) for send in (spam.SEND, 0))
    assert a == b and len(a) == len(texts) - 3


def test_copies_of_a_list_do_not_vouch_for_it(spark):
    rng = random.Random(7)
    page = lambda: " ".join(f"the {rng.choice(('old', 'new', 'red'))} {rng.choice(('pump', 'crane', 'gate'))} opens {rng.choice(('up', 'down'))} again." for _ in range(6))
    tags = " ".join(f"#tag{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(40))
    texts = [page() for _ in range(200)] + [tags] * 5 + [tags.upper(), tags.replace(" #", ", ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for send in (spam.SEND, 0):
        assert {r.share for r in spam.page_scores(df, send).filter(F.col("doc_id") >= 200).collect()} == {1.0}


def test_means_equal_brute_force(spark):
    import collections
    import math

    rng = random.Random(12)
    vocab = [f"w{chr(97 + k)}" for k in range(12)]
    texts = list(dict.fromkeys(" ".join(rng.choices(vocab, k=rng.randrange(2, 25))) for _ in range(60)))
    pairs = [list(zip(t.split(), t.split()[1:])) for t in texts]
    df = collections.Counter(p for ps in pairs for p in set(ps))
    times = collections.Counter(p for ps in pairs for p in ps)
    left, right = collections.Counter(), collections.Counter()
    for (a, b), n in df.items():
        left[a] += n
        right[b] += n
    d = sum(df.values())

    def worth(p):
        n = df[p] - 1
        return 0.0 if n == 0 or times[p] >= spam.BURST * df[p] else max(-1.0, min(1.0, math.log(n * d / (left[p[0]] * right[p[1]])) / -math.log(n / d)))

    want = {}
    for k, ps in enumerate(pairs):
        v = [worth(p) for p in ps]
        cuts = [v[max(i - spam.REACH, 0):min(i + spam.REACH, len(v))] for i in range(len(v) + 1)]
        want[k] = sum(sum(c) / len(c) for c in cuts) / len(cuts)
    got = spam.page_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and all(abs(r["mean"] - want[r.doc_id]) < 1e-3 for r in got)


def test_a_corpus_without_repeated_wording_has_no_border(spark):
    df = spark.createDataFrame([(k, " ".join(f"q{chr(97 + k)}{chr(97 + j)}" for j in range(20))) for k in range(5)], "doc_id long, text string")
    assert spam.spam_pages(df).count() == 0


def test_empty(spark):
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
