import random

from feedloom.operators.linkage import average_linkage


def brute_average(edges, threshold):
    sim = {frozenset(e[:2]): e[2] for e in edges}
    groups = [{n} for n in {x for e in edges for x in e[:2]}]
    while True:
        best = max(((sum(sim.get(frozenset((a, b)), 0) for a in x for b in y) / (len(x) * len(y)), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups[:i])), default=(0, 0, 0))
        if best[0] < threshold:
            return {frozenset(g) for g in groups}
        groups[best[1]] |= groups[best[2]]
        del groups[best[2]]


def test_reciprocal_merging_equals_merging_one_pair_at_a_time(spark):
    rng = random.Random(9)
    edges = [(a, b, rng.random()) for a in range(25) for b in range(a) if rng.random() < 0.3]
    got = average_linkage(spark.createDataFrame(edges, "a long, b long, sim double"), 0.2).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_average(edges, 0.2)


def test_sizes_ties_and_empty_input(spark):
    edges = [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (5, 5, 9.0), (None, 1, 9.0), (4, 6, 0.1)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, sim double, cluster string")
    assert {r.id: r.cluster for r in average_linkage(df, 0.5).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6}
    sizes = spark.createDataFrame([(1, 4), (2, 2), (9, 3)], "id long, n long")
    assert {r.id: r.cluster for r in average_linkage(df, 0.5, sizes).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 6: 6, 9: 9}
    assert average_linkage(df.limit(0), 0.5).count() == 0


def test_long_chains_end(spark):
    edges = [(k, k + 1, 1 - k / 100) for k in range(60)]
    df = spark.createDataFrame(edges, "a long, b long, sim double")
    groups = {}
    for r in average_linkage(df, 0.2).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_average(edges, 0.2)
