import hashlib
import random

import numpy as np
import pytest

from tempograph.llm import exact_dedup as e


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_rice_round_trip(n):
    r = np.random.default_rng(n)
    for low, high in ((0, 1 << 64), (1 << 63, (1 << 63) + 5 * n)):
        x = np.unique(r.integers(low, high - 1, n, dtype=np.uint64))
        k, q, rest = e.rice_encode(x, low)
        assert (e.rice_decode(len(x), k, q, rest, low) == x).all()


def brute(rows):
    norm = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_against_brute_force(spark):
    r = random.Random(1)
    pool = ["Alpha É", "alpha É", "ALPHA é", "", "x" * 50_000, "b\nc"] + [f"text {i}" for i in range(30)]
    rows = [(i, r.choice(pool)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "only one")]
    df = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, keep_id string, owner int")
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in e.exact_duplicates(df.repartition(5), sender_docs=20).collect()}
    assert got == brute(rows)
    assert e.exact_duplicates(df.limit(0)).collect() == []
    kept = e.without_duplicates(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "z")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in e.exact_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (None, None, 1, True)], key=str)


def test_the_least_id_is_no_null(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a"), (None, "b"), (least, "c"), (7, "c")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in e.exact_duplicates(df).collect()), key=str)
    assert got == sorted([(least, least, 1, True), (None, None, 1, True), (least, 7, 2, False), (7, 7, 2, True)], key=str)
