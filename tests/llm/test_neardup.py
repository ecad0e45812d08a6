import random
import re

import numpy as np
import pytest

from feedloom.llm import neardup

WORD = re.compile(r"[^\W_]+")


def brute(rows, least):
    sets = [(i, set(WORD.findall(t.lower()))) for i, t in rows if t]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return {tuple(sorted((a, b))) for k, (a, s) in enumerate(sets) for b, u in sets[:k] if a != b and 5 * len(s & u) >= 4 * len(s | u)}


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(9)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rng.shuffle(words)
        else:
            words = rng.choices(vocab, k=rng.randrange(15, 70))
        rows.append((f"r{k:03d}", " ".join(words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "rec string, text string, key int")


def test_equals_brute_force(spark):
    rows = corpus() + [("n", None), ("e", ""), ("long", " ".join(f"q{k}" for k in range(5000))), ("long2", " ".join(f"q{k}" for k in range(4990)))]
    got = {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows, 20) and ("long", "long2") in got


@pytest.mark.parametrize("n", [20, 64, 143, 575, 1151, 1152, 1153, 1200, 1300, 2303, 2304, 2305, 3000])
def test_no_length_is_lost(n):
    """Two texts of n and more words just inside the threshold, at every multiple of the counters' widths."""
    rng = np.random.default_rng(n)
    most = n // 9  # words replaced: (n - k) / (n + k) >= 4/5
    for k in {0, 1, most // 2, most}:
        a = rng.integers(-2**62, 2**62, n)
        b = np.concatenate([a[k:], rng.integers(-2**62, 2**62, k)])
        flat, row = np.concatenate([a, b]), np.repeat([0, 1], [n, n])
        parity, u0, u1 = neardup.embed(flat, row, 2)
        cell = {"n": np.array([n, n], np.int32), "pos": np.zeros(2, np.int32), "key": np.array([1, 2]), "side": np.full(2, neardup.BOTH, np.int8), "parity": parity.view(np.int64), "u0": u0.view(np.int64), "u1": u1.view(np.int64)}
        assert [x.tolist() for x in neardup.compare(cell)] == [[1], [2]]


def test_long_texts_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k, n in enumerate((40, 600, 1100, 1152, 1200, 1300, 2304, 3000)):
        words = [f"w{k}x{j}" for j in range(n)]
        for j, share in enumerate((0, 0.05, 0.09, 0.15)):
            cut = int(n * share)
            rows.append((f"r{k}{j}", " ".join(rng.sample(words[cut:], n - cut) + [f"z{j}{k}{i}" for i in range(cut)])))
    assert {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()} == brute(rows, 20)


def test_large_cells_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus(seed=5)
    assert {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()} == brute(rows, 20)


def test_many_copies_are_paired_with_their_representative(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 3)
    base = " ".join(f"w{k}" for k in range(30))
    rows = [(f"c{k}", base) for k in range(6)] + [("x", base + " extra")]
    got = {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()}
    assert got == {("c0", f"c{k}") for k in range(1, 6)} | {("c0", "x")}
    groups = {r.rec: r.group_id for r in neardup.groups(frame(spark, rows)).collect()}
    assert len(set(groups.values())) == 1 and len(groups) == 7


def test_different_texts_of_one_class_are_all_paired(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 3)
    words = [f"w{k}" for k in range(30)]
    rng = random.Random(2)
    rows = [(f"o{k:02d}", " ".join(rng.sample(words, 30))) for k in range(12)] + [(f"c{k}", " ".join(words)) for k in range(5)]
    rows += [(f"x{k}", " ".join(rng.sample([*words, "extra"], 31))) for k in range(6)]
    shown = [r for r in rows if r[0] not in {f"c{k}" for k in range(1, 5)}]
    for spread in (neardup.SPREAD, 4):
        monkeypatch.setattr(neardup, "SPREAD", spread)
        got = {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()}
        assert got == brute(shown, 20) | {("c0", f"c{k}") for k in range(1, 5)}


def test_empty(spark):
    assert neardup.similar_pairs(frame(spark, corpus(3)).limit(0)).count() == 0


def test_the_embedding_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = rng.integers(-2**62, 2**62, 60)
        b = np.concatenate([a[: rng.integers(30, 60)], rng.integers(-2**62, 2**62, 8)])
        flat, row = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        parity, u0, u1 = neardup.embed(flat, row, 2)
        d = len(set(a) ^ set(b))
        assert int(np.bitwise_count(parity[0] ^ parity[1])) <= d
        assert int(np.bitwise_count(u0[0] ^ u0[1])) + int(np.bitwise_count(u1[0] ^ u1[1])) <= d
