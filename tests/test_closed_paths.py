"""Closed paths against brute force, and walked once for each head."""

import random

from tempograph.operators import graph as N


def test_closed_paths(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(7), rng.choice("xyz"), rng.randrange(7)) for _ in range(40)}
    anchors = [e for e in sorted(edges) if e[1] == "x"]
    want = set()
    for h, r, t in anchors:
        walks = [((h,), ())]
        for _ in range(3):
            walks = [((*seen, b), (*path, s)) for seen, path in walks for a, s, b in edges if a == seen[-1] and b not in seen]
            want |= {(h, r, t, path) for seen, path in walks if seen[-1] == t and path != (r,)}
            walks = [w for w in walks if w[0][-1] != t]
    schema = "head long, rel string, tail long"
    df = spark.createDataFrame(sorted(edges), schema)
    twice = N.closed_paths(spark.createDataFrame(anchors, schema), df.union(df), 3)
    once = N.closed_paths(spark.createDataFrame(anchors, schema), df, 3, distinct=True)
    for out in (twice, once):
        rows = [(r.head, r.rel, r.tail, tuple(r.path)) for r in out.collect()]
        assert len(rows) == len(want) and set(rows) == want
    walked = [line for line in once._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in line and " AS seen#" in line]
    assert walked and not any("tail#" in line.split("AS seen#")[0] and "rel#" in line for line in walked)  # no anchor on the way


def test_by_blocks(spark, monkeypatch):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(8)}", rng.choice("xyz"), f"n{rng.randrange(8)}") for _ in range(50)})
    schema = "head string, rel string, tail string"
    df = spark.createDataFrame([*edges, edges[0], (None, "x", "n1"), ("n1", "y", None)], schema)
    anchors = spark.createDataFrame([*edges[::2], edges[0], ("n1", "x", "far"), ("far", "x", "n1"), ("n1", "x", None)], schema)
    for longest in (1, 2, 3, 4):
        want = {(r.head, r.rel, r.tail, tuple(r.path)) for r in N.closed_paths(anchors, df, longest).collect()}
        monkeypatch.setattr(N, "AT_ONCE", 3 if longest < 4 else 1000)
        out = N.closed_paths_by_blocks(anchors, df, longest)
        rows = [(r.head, r.rel, r.tail, tuple(r.path)) for r in out.collect()]
        assert want and len(rows) == len(want) and set(rows) == want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_anchors_of_every_flag(spark, tmp_path):
    from tempograph.plans import catalogue

    lines = [(50, "A", 1), (50, "N", 1), (50, "R", 2), (7, "A", 2), (7, "R", 1)]
    spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "l_orderkey long, l_suppkey long, l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {tuple(r) for r in catalogue.g5_closed_paths(spark, str(tmp_path)).select("head", "rel", "tail", "path").collect()}
    part = 10_000_000
    want = {(50, "A", part + 1, "N"), (50, "N", part + 1, "A"), *((50, r, part + 1, "R|inv_A|R") for r in "AN"), *((50, "R", part + 2, f"{r}|inv_R|A") for r in "AN")}
    assert found == want
