import collections
import itertools
import random

from feedloom.llm import issues_by_text as it


def test_clusters_follow_issues(spark):
    rng = random.Random(8)
    topics = ["label", "map", "clock", "login", "export", "photo"]
    issues = [([f"the {t} {x}" for x in ("sheet", "view")], [f"{v} the {t} {o}" for v, o in (("loses", "stripe"), ("hides", "corner"))], [f"every {t} {x} looked fine before" for x in ("copy", "draft")]) for t in topics]
    firms = ["driver", "buyer", "mason", "roofer", "tiler", "painter", "welder", "clerk", "nurse", "planner", "guide", "tailor"]
    remarks = [f"a {a} asked our {b} about {c}" for a, b, c in itertools.product(firms, firms, ["prices", "visits", "delays", "crews", "wages", "keys", "doors", "tools"])]
    rows, truth = [], {}
    for k in range(1500):
        i = rng.randrange(6)
        s, p, d = issues[i]
        text = f"Hello, {rng.choice(s)} {rng.choice(p)}. {rng.choice(d).capitalize()}. " + " ".join(f"{r.capitalize()}." for r in rng.sample(remarks, 2)) + (f" In short, {rng.choice(s)} {rng.choice(p)}." if rng.random() < 0.5 else "")
        if k % 10 == 0:
            text = f"{rng.choice(s)} {rng.choice(p)} again"
        rows.append((f"r{k}", text))
        truth[f"r{k}"] = i
    rows += [("null", None), ("empty", ""), ("e1", "Error: slot 12 taken"), ("e2", "Error: slot 99 taken"), ("e3", "Error: slot 5 taken")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec string, text string, cluster int")
    got = {r.rec: r.cluster for r in it.clusters(df).collect()}
    assert len(got) == len(rows) and got["null"] is None and got["empty"] is None and got["e1"] == got["e2"] == got["e3"] != None  # noqa: E711
    names = {i: {got[r] for r, t in truth.items() if t == i and got[r] is not None} for i in range(6)}
    right = sum(1 for r, t in truth.items() if got[r] == max(names[t], key=lambda c: sum(got[x] == c for x, u in truth.items() if u == t)))
    assert right >= 0.97 * len(truth)
    s = {r["cluster"]: r for r in it.summary(it.clusters(df), df).collect()}
    assert sum(r["size"] for r in s.values()) == sum(c is not None for c in got.values()) and all(len(r["typical"]) <= 3 for r in s.values())


def test_an_issue_of_a_third_of_all_records_is_found(spark):
    rng = random.Random(3)
    names = ["label", "map", "clock", "login", "export", "photo", "stock", "badge", "forms", "roster", "route", "quote", "visit"]
    rows, truth = [], {}
    for k in range(3000):
        i = 0 if rng.random() < 0.33 else rng.randrange(1, len(names))
        say = lambda: f"the {names[i]} {rng.choice(['sheet', 'view', 'panel', 'screen'])} {rng.choice(['loses', 'hides', 'doubles', 'drops', 'mixes'])} {names[i]} {rng.choice(['rows', 'colours', 'dates'])}"  # noqa: E731, B023
        rest = [f"we asked {rng.choice(['driver', 'buyer', 'mason', 'clerk', 'nurse'])} number {k} about {rng.choice(['prices', 'visits', 'delays', 'crews'])}", f"it is {rng.choice(['cold', 'warm', 'late', 'early'])} in {rng.choice(['town', 'port', 'yard'])}"]
        rows.append((f"r{k}", ". ".join([say(), *rest, *([f"in short, {say()}"] if rng.random() < 0.6 else [])])))
        truth[f"r{k}"] = i
    got = {r.rec: r.cluster for r in it.clusters(spark.createDataFrame(rows, "rec string, text string")).collect()}
    for i in range(len(names)):
        counts = collections.Counter(got[r] for r, t in truth.items() if t == i).most_common(1)[0]
        assert counts[1] >= 0.9 * sum(t == i for t in truth.values()) and counts[1] >= 0.9 * sum(c == counts[0] for c in got.values())


def brute_counts(texts):
    f, r = collections.Counter(), collections.Counter()
    for t in texts:
        seen = collections.Counter()
        for clause in t.lower().split("."):
            w = clause.split()
            seen.update({x for x in w if len(x) >= 4} | set(zip(w, w[1:])))
        f.update(seen.keys())
        r.update(x for x, n in seen.items() if n > 1)
    return f, r


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ab", "cde", "fghi", "jklmn") for b in "opqrstu"]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))) + "." for _ in range(300)]
    streams = it.token_streams(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "rec string, text string").repartition(3))
    got = streams.select("ws").mapInArrow(it._counts, "term long, f long, r long").groupBy("term").agg({"f": "sum", "r": "sum"}).collect()
    f, r = brute_counts(texts)
    assert sorted((x["sum(f)"], x["sum(r)"]) for x in got) == sorted((n, r[t]) for t, n in f.items())


def test_joining_the_terms_gives_the_same_classes(spark):
    rng = random.Random(7)
    texts = ["", None, "12", "lone", *[". ".join(" ".join(rng.choices(["lamp", "door", "gate", "roof", "wall"], k=4)) for _ in range(3)) for _ in range(50)], "lamp door, " * 4000]
    streams = it.token_streams(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "rec string, text string"))
    codes = sorted({x.term for x in streams.select("ws").mapInArrow(it._counts, "term long, f long, r long").collect()})[::3]
    terms = spark.createDataFrame([(c, 1) for c in codes], "term long, f long")
    a, b = ({r.rid: (r.sig, r.cls, sorted(map(tuple, r.cs))) for r in it.classes_of(streams, terms, send).collect()} for send in (it.SEND, 0))
    assert a == b and len(a) == len(texts)


def test_repeated_wordings_and_clause_order_count_once(spark):
    base = ["the lamp flickers badly. the old gate squeaks", "the old gate squeaks. the lamp flickers badly"]
    df = spark.createDataFrame([(str(k), base[k % 2] if k < 8 else f"{base[0]} {k}") for k in range(12)], "rec string, text string")
    got = {r.rec: r.cluster for r in it.clusters(df).collect()}
    assert len(got) == 12 and None not in got.values() and len(set(got.values())) <= 2


def test_empty(spark):
    assert it.clusters(spark.createDataFrame([], "rec string, text string")).count() == 0
