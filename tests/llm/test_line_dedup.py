import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tempograph.llm import line_dedup as l

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WHITE))

    firsts, docs = {}, {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs.setdefault(key(x), set()).add(i)
    firsts = {k: min(v) for k, v in docs.items() if len(k) >= least and len(v) > 1}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if firsts.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("sample_rows", [100_000, 50])
def test_against_brute_force(spark, sample_rows):
    r = random.Random(2)
    pool = ["A shared line here", "\ta shared LINE here \r", "short", "", "É shared line ÉÉ", "é shared line éé", "the very hot line"] + [f"own line number {i}" for i in range(60)]
    rows = [(i, "\n".join([r.choice(pool) for _ in range(r.choice([1, 3, 90]))] + ["the very hot line"])) for i in r.sample(range(900), 150)] + [(1000, None), (1001, ""), (1002, "\n\n")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, word int, bits string").repartition(4)
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in l.digests(df, sample_rows=sample_rows).collect()}
    assert got == brute(rows)
    assert l.digests(df.limit(0)).collect() == []


def test_null_id(spark):
    df = spark.createDataFrame([(None, "one long line"), (3, "one long line\nx")], "doc_id long, text string")
    assert {x.doc_id: x.n_dropped for x in l.digests(df).collect()} == {None: 0, 3: 1}


def test_the_second_hash_is_no_function_of_the_first(spark):
    df = spark.createDataFrame([(f"line {i}",) for i in range(50)], "key string")
    rows = df.select(*l.key_hash("key"), F.xxhash64(F.lit(1), F.lit("x")).alias("other"), F.xxhash64("key", F.lit(1)).alias("chained")).collect()
    assert len({r.h2 for r in rows}) == 50 and all(r.h2 not in (r.h, r.chained, r.other) for r in rows)


def test_long_texts_and_repeated_rows(spark):
    text = "\n".join(f"line number {i}" for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, text + "\nits own long line"), (3, "once more\n" * 2), (3, "once more\n" * 2)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in l.deduplicated(df).collect())
    assert got == [(1, 5000, 0), (2, 5001, 5000), (3, 3, 0), (3, 3, 0)]
