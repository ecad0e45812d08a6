"""Merges, splits and outliers against plain one-at-a-time versions."""

import itertools
import math
import random

import pytest

from feedloom.operators import consolidate


def corpus(spark, seed, n=16, k=6, terms=7):
    rng = random.Random(seed)
    vecs, labels = {}, {}
    for i in range(n):
        v = [rng.random() if rng.random() < 0.45 else 0.0 for _ in range(terms)]
        length = math.sqrt(sum(x * x for x in v))
        vecs[f"m{i:02d}"] = [x / length for x in v] if length else v
        labels[f"m{i:02d}"] = f"c{rng.randrange(k)}"
    df = spark.createDataFrame([(i, f"t{j}", x) for i, v in vecs.items() for j, x in enumerate(v) if x], "id string, term string, w double")
    return vecs, labels, df, spark.createDataFrame(list(labels.items()), "id string, cluster_id string")


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b))


def linked(a, b, how):
    all_pairs = [cosine(x, y) for x in a for y in b]
    return {"single": max, "complete": min, "average": lambda x: sum(x) / len(x)}[how](all_pairs)


def brute_merges(vecs, labels, threshold, how, ratio=0.0, rejected=(), cap=0):
    groups = {(c,): [vecs[i] for i in vecs if labels[i] == c] for c in set(labels.values())}
    out = []
    while True:
        admitted = []
        for x, y in itertools.combinations(groups, 2):
            big, small = max(len(groups[x]), len(groups[y])), min(len(groups[x]), len(groups[y]))
            if (ratio and big / small > ratio) or "+".join(sorted(x + y)) in rejected:
                continue
            admitted.append((linked(groups[x], groups[y], how), x, y))
        best = max(admitted, default=None)
        if best is None or best[0] < threshold or (cap and len(out) == cap):
            return sorted(((s, "+".join(k), z) for s, k, z in out), key=lambda r: (-r[0], r[1]))
        s, x, y = best
        out.append((round(s, 9), tuple(sorted(x + y)), {len(groups[x]), len(groups[y])}))
        groups[tuple(sorted(x + y))] = groups.pop(x) + groups.pop(y)


def rows(df):
    return [(round(r.similarity, 9), r.key, {r.size_a, r.size_b}) for r in df.collect()]


@pytest.mark.parametrize("how,threshold", [("average", 0.3), ("single", 0.8), ("complete", 0.02)])
def test_merges_equal_merging_one_pair_at_a_time(spark, how, threshold):
    vecs, labels, v, l = corpus(spark, 3)
    want = brute_merges(vecs, labels, threshold, how)
    assert rows(consolidate.merge_proposals(v, l, threshold, linkage=how)) == want and len(want) >= 2


def test_ratio_rejections_locks_and_cap(spark):
    vecs, labels, v, l = corpus(spark, 5)
    free = brute_merges(vecs, labels, 0.3, "average")
    refused = [free[0][1], free[-1][1]]
    r = spark.createDataFrame([(k,) for k in refused], "key string")
    assert rows(consolidate.merge_proposals(v, l, 0.3, rejected=r)) == brute_merges(vecs, labels, 0.3, "average", rejected=refused)
    assert rows(consolidate.merge_proposals(v, l, 0.3, max_size_ratio=2.0)) == brute_merges(vecs, labels, 0.3, "average", ratio=2.0)
    assert rows(consolidate.merge_proposals(v, l, 0.3, max_proposals=2)) == brute_merges(vecs, labels, 0.3, "average", cap=2)
    held = sorted(set(labels.values()))[:2]
    open_ones = {i: c for i, c in labels.items() if c not in held}
    got = rows(consolidate.merge_proposals(v, l, 0.3, locked=spark.createDataFrame([(c,) for c in held], "cluster_id string")))
    assert got == brute_merges({i: vecs[i] for i in open_ones}, open_ones, 0.3, "average")
    assert consolidate.merge_proposals(v, l, 2.0).count() == 0 and consolidate.merge_proposals(v.limit(0), l.limit(0), 0.3).count() == 0


def test_overlapping_accepted_merges_compose(spark):
    l = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", None)], "id string, cluster_id string")
    acc = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "cluster_ids array<string>")
    assert {r.id: r.cluster_id for r in consolidate.apply_merges(l, acc).collect()} == {"1": "a", "2": "a", "3": "a", "4": "d", "5": None}


def test_poles_and_splits_equal_all_pairs(spark):
    for seed, terms in ((1, 7), (4, 2)):
        vecs, labels, v, l = corpus(spark, seed, n=18, k=3, terms=terms)
        got = {r.cluster_id: (r.pole_a, r.pole_b) for r in consolidate.diameter_pairs(v, l, salts=2).collect()}
        sides = {}
        for r in consolidate.split_proposals(v, l, 0.9, 2, -1.0).collect():
            sides.setdefault(r.cluster_id, {})[r.id] = (r.side, round(r.cross, 9), round(r.within_a, 9), round(r.within_b, 9))
        for c in set(labels.values()):
            ids = sorted(i for i in labels if labels[i] == c)
            poles = min(itertools.combinations(ids, 2), key=lambda p: (round(cosine(vecs[p[0]], vecs[p[1]]), 12), p))
            assert got[c] == poles
            a = [i for i in ids if round(cosine(vecs[i], vecs[poles[0]]), 12) >= round(cosine(vecs[i], vecs[poles[1]]), 12)]
            b = [i for i in ids if i not in a]
            if b and min(b) < min(a):
                a, b = b, a
            within = lambda g: 1.0 if len(g) < 2 else sum(cosine(vecs[x], vecs[y]) for x, y in itertools.combinations(g, 2)) / math.comb(len(g), 2)
            if min(len(a), len(b)) < 2 or linked([vecs[i] for i in a], [vecs[i] for i in b], "average") >= 0.9:
                assert c not in sides
                continue
            cross = round(linked([vecs[i] for i in a], [vecs[i] for i in b], "average"), 9)
            assert sides[c] == {i: ("a" if i in a else "b", cross, round(within(a), 9), round(within(b), 9)) for i in ids}


def test_splits_order_rejection_cap_and_suffixes(spark):
    _, _, v, l = corpus(spark, 1, n=18, k=3)
    s = consolidate.split_proposals(v, l, 0.9, 2, -1.0)
    keys = {r.cluster_id: (r.cross, r.key) for r in s.collect()}
    assert len(keys) >= 2
    first = min(keys.values())
    assert {r.key for r in consolidate.split_proposals(v, l, 0.9, 2, -1.0, max_proposals=1).collect()} == {first[1]}
    assert first[1] not in {r.key for r in consolidate.split_proposals(v, l, 0.9, 2, -1.0, rejected=spark.createDataFrame([(first[1],)], "key string")).collect()}
    acc = spark.createDataFrame([("x", "1", "a", "k1"), ("x", "2", "b", "k1"), ("x", "3", "b", "k2"), ("x", "1", "a", "k2")], "cluster_id string, id string, side string, key string")
    lab = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y")], "id string, cluster_id string")
    assert {r.id: r.cluster_id for r in consolidate.apply_splits(lab, acc).collect()} == {"1": "x", "2": "xb", "3": "xc", "4": "y"}


def test_outliers_equal_brute_force(spark):
    vecs, labels, v, l = corpus(spark, 8, n=18, k=3)
    want = []
    for c in set(labels.values()):
        ids = [i for i in labels if labels[i] == c]
        mean = {i: round(sum(cosine(vecs[i], vecs[j]) for j in ids if j != i) / (len(ids) - 1), 12) for i in ids} if len(ids) > 1 else {}
        weak = sorted((m, i) for i, m in mean.items() if m < 0.4)
        want += [(m, f"outlier:{c}:{i}") for m, i in weak[:max(len(ids) - 3, 0)]]
    got = [(round(r.mean_similarity, 12), r.key) for r in consolidate.outlier_proposals(v, l, 0.4, 3).collect()]
    assert [k for _, k in got] == [k for _, k in sorted(want)] and got
    assert [r.key for r in consolidate.outlier_proposals(v, l, 0.4, 3, max_proposals=2).collect()] == [k for _, k in got[:2]]
    locked = spark.createDataFrame([(c,) for c in set(labels.values())], "cluster_id string")
    assert consolidate.outlier_proposals(v, l, 0.4, 3, locked=locked).count() == 0
