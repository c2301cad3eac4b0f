import random

import numpy as np
import pytest

from tempograph.llm import near_dedup as n


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(rows, size, percent=80):
    sets = sets_of(rows, size)
    ids = sorted(sets)
    component = {i: i for i in ids}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                component[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 12, 60, 200]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            text = " ".join(copy)
            rows.append(text.upper() if r.random() < 0.2 else text)
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)] + [(0, None), (1000, ""), (1001, " \n"), (1002, "one two"), (1003, "ONE two"), (1004, "w " * 30_000), (1005, "w " * 20_000)]


@pytest.mark.parametrize("options", [{}, {"block": 5}, {"block_bytes": 2000}])
def test_against_brute_force(spark, options):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, component int, rep string").repartition(4)
    for size in (4, 5) if not options else (4,):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in n.near_duplicates(df, size=size, **options).collect()}
        assert got == brute(rows, size)


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in n.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False)], key=str)
    assert n.near_duplicates(df.limit(0)).collect() == []
    assert [x.doc_id for x in n.without_near_duplicates(df.where("doc_id > 4 or doc_id = 4").distinct()).collect()] == [4]


def test_pruning_keeps_what_it_should():
    least = n.least_matches(0.8, 1e-6, [30, 60, 90, 120, 150])
    assert least == sorted(least) and least[-1] / 150 < 0.8 and least[0] < 24
    r = np.random.default_rng(0)
    kept = r.binomial(30, 0.8, 100_000) >= least[0]
    assert kept.mean() > 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (70, 71), (200, 100), (300, 300)]
    got = {x.node: x.component for x in n.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in (50, 70, 71, 100, 200)}
