"""Hand-made graphs for what is easy to get wrong."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tempograph.functions import rules as R
from tempograph.operators import candidates as C
from tempograph.operators import cleaning as U
from tempograph.operators import confidence as A
from tempograph.operators import governance as G
from tempograph.operators import ranking as K
from tempograph.operators import retrieval as M
from tempograph.operators import sampling as S
from tempograph.operators import walks as J
from tempograph.sources import files, quads
from tempograph.streaming import quads as stream

RULE = "rule_id string, head_rel string, body_rels array<string>, var_constraints array<array<int>>, rule_order long, llm_confidence double"


def facts(spark, rows):
    return spark.createDataFrame(rows, "sub long, rel string, obj long, ts long")


def rules(spark, *rows):
    return spark.createDataFrame([(f"r{i}", h, b, c, i, 0.0) for i, (h, b, c) in enumerate(rows)], RULE)


def test_times_along_the_body_and_after_it(spark):
    f = facts(spark, [(1, "A", 2, 1), (2, "B", 3, 1), (2, "B", 3, 0), (1, "H", 3, 1), (1, "H", 3, 2), (1, "H", 3, 2)])
    got = A.confidences(rules(spark, ("H", ["A", "B"], []), ("H", ["B", "A"], []), ("X", ["A"], [])), f)
    assert {x.rule_id: (x.body_supp, x.rule_supp, x.conf) for x in got.collect()} == {"r0": (1, 1, 1.0), "r1": (0, 0, 0.0), "r2": (1, 0, 0.0)}
    assert A.confidences(rules(spark, ("H", ["A", "B"], [])), f, relax=True).first().body_supp == 2
    assert A.kept(got).count() == 1


def test_constraints_exact_in_confidence_included_in_application(spark):
    f = facts(spark, [(1, "A", 2, 1), (2, "iA", 1, 2), (1, "A", 2, 3)])
    r = rules(spark, ("A", ["A", "iA", "A"], [[0, 2], [1, 3]]), ("A", ["A", "iA", "A"], [[0, 2]]))
    assert {x.rule_id: x.body_supp for x in A.confidences(r, f).collect()} == {"r0": 1, "r1": 0}
    q = spark.createDataFrame([(7, 1, "A", 2, 9)], "qid long, sub long, rel string, obj long, ts long")
    assert {x.rule_id for x in C.evidence(r, f, q).collect()} == {"r0", "r1"}


def test_windows(spark):
    f = facts(spark, [(1, "A", k, t) for k, t in ((1, 4), (2, 5), (3, 9), (4, 10))])
    q = spark.createDataFrame([(1, 1, "A", 0, 10)], "qid long, sub long, rel string, obj long, ts long")
    assert sorted(x.obj for x in J.window_edges(f, q, 5).collect()) == [2, 3]
    assert sorted(x.obj for x in J.window_edges(f, q, 0).collect()) == [1, 2, 3]
    assert sorted(x.obj for x in J.window_edges(f, q, -1).collect()) == [1, 2, 3, 4]


def scores(spark, rows):
    return spark.createDataFrame(rows, "qid long, entity long, rule_id string, rule_idx long, score double")


def test_aggregates_and_deltas(spark):
    s = scores(spark, [(1, 5, "a", 0, 0.5), (1, 5, "b", 1, 0.25), (1, 5, "c", 2, 0.1)])
    assert C.aggregated(s).first().score == pytest.approx(0.6625)
    got = {x.rule_id: x.delta for x in C.deltas(s, weight=1.0).collect()}
    assert got == pytest.approx({"a": 0.5 * 0.75 * 0.9, "b": 0.25 * 0.5 * 0.9, "c": 0.1 * 0.5 * 0.75})
    one = scores(spark, [(1, 5, "a", 0, 1.0), (1, 5, "b", 1, 0.5), (1, 5, "c", 2, 0.0)])
    assert {x.rule_id: x.delta for x in C.deltas(one, weight=1.0).collect()} == pytest.approx({"a": 0.5, "b": 0.0, "c": 0.0})


def test_ranks_with_ties_and_missing_answers(spark):
    c = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.2), (2, 1, 0.1)], "qid long, entity long, score double")
    a = spark.createDataFrame([(1, 2), (2, 9), (3, 1)], "qid long, entity long")
    got = {x.qid: (x.best, x.average, x.worst, x.cand_rank) for x in K.ranks(c, a, 50).collect()}
    assert got == {1: (2, 2, 3, 2), 2: (50, 50, 50, None), 3: (50, 50, 50, None)}
    split = spark.createDataFrame([(1, 1, "r", 2, 5), (2, 1, "r", 1, 5), (3, 1, "r", 3, 5)], "qid long, sub long, rel string, obj long, ts long")
    assert sorted(x.entity for x in K.filtered(c, split).where("qid = 1").collect()) == [2, 4]
    assert K.dense_ranks([0.7, 0.5, 0.5, 0.0], 1, [0]) == {"ill": 1, "harsh": 2, "balance": 2, "random": 2}
    assert K.dense_ranks([0.7, 0.5, 0.5, 0.0], 3, [0])["balance"] == 3


def test_early_stop_needs_different_lists(spark):
    s = scores(spark, [(1, 1, "a", 0, 0.5), (1, 2, "a", 0, 0.5), (1, 1, "b", 1, 0.4), (1, 3, "c", 2, 0.9)])
    assert sorted(x.rule_id for x in C.early_stop(s, 2).collect()) == ["a", "a", "b"]
    assert C.early_stop(s, 3).count() == 4
    assert sorted(x.rule_id for x in C.rule_priority(s, 1).collect()) == ["a", "a", "b"]


def test_eager_equals_listed(spark):
    f = facts(spark, [(i % 4, "A", i % 3, i) for i in range(30)] + [(i % 3, "B", i % 5, i) for i in range(30)])
    listed = J.chain(f, ["A", "B"]).groupBy("e0", "e2", "t1").count()
    eager = J.eager_counts(f, ["A", "B"]).select("e0", F.col("ek").alias("e2"), F.col("t_last").alias("t1"), F.col("bodies").alias("count"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, eager.collect()))


def test_sampled_confidence_reaches_the_exact_one(spark):
    f = facts(spark, [(i % 4, "A", i % 3, i) for i in range(20)] + [(i % 4, "H", i % 3, i + 4) for i in range(0, 20, 2)])
    r = rules(spark, ("H", ["A"], []))
    exact, sampled = A.confidences(r, f).first(), A.sampled_confidences(r, f).first()
    assert (sampled.body_supp, sampled.rule_supp, sampled.conf) == (exact.body_supp, exact.rule_supp, exact.conf)


def test_walks_are_cyclic_and_go_back_in_time(spark):
    base = facts(spark, [(i % 5, "A", (i * 3) % 7, i) for i in range(60)])
    f = quads.with_inverses(base, F.concat(F.lit("inv_"), "rel"))
    inverse = spark.createDataFrame([("A", "inv_A"), ("inv_A", "A")], "rel string, inv string")
    for weighting in ("unif", "exp"):
        walks = S.sample_walks(f, inverse, length=4, walks=40, weighting=weighting).collect()
        assert walks
        for w in walks:
            t = w.timestamps
            assert w.entities[0] == w.entities[-1] and t[1] < t[0] and t[1] >= t[2] >= t[3] and w.relations[0] == w.rel


def test_patch_and_overlay(spark):
    r = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.9, 0.2), ("c", 0.4, 0.3)], "rule_id string, conf double, llm_confidence double")
    p = spark.createDataFrame([("delete", 0, "a", None), ("promote", 0, "a", 1.1), ("promote", 1, "b", 9.0), ("downweight", 0, "c", 0.01), ("delete", 1, "zz", None)], "action string, pos int, rule_id string, scale double")
    v = G.valid_patch(p, r)
    assert {(x.action, x.rule_id) for x in v.collect()} == {("delete", "a"), ("promote", "b"), ("downweight", "c")}
    assert {x.rule_id: (round(x.conf, 6), x.llm_confidence) for x in G.apply_patch(r, v).collect()} == {"b": (1.0, 0.2), "c": (0.08, 0.3)}
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "qid long, entity long")
    new = spark.createDataFrame([(2, 7)], "qid long, entity long")
    gone = spark.createDataFrame([(2,), (3,)], "qid long")
    assert sorted(map(tuple, G.overlay(old, new, gone).collect())) == [(1, 1), (2, 7)]
    rounds = spark.createDataFrame([(0, 0.5, 0.2), (1, 0.6, 0.1), (2, 0.6, 0.1)], "round int, mrr double, hits1 double")
    assert G.best_round(rounds).first()["round"] == 1


def test_rule_strings(spark):
    line = spark.createDataFrame([("A/B(X0, X1, T1) <- Über_rel (x)(X0,X1,T0)",)], "rule string")
    assert line.select(R.relations(F.col("rule"))).first()[0] == ["B", "Über_rel (x)"]
    assert line.select(R.rule_id(F.col("rule"))).first()[0] == R.rule_id_text("A/B(X0, X1, T1) <- Über_rel (x)(X0,X1,T0)")
    assert U.clean_rule("clik(X0,X1,T1)<-view(X0,X1,T0)", ["click", "view"], frozenset(["click", "view"])) == ("click(X0,X1,T1)<-view(X0,X1,T0)", None)
    path = spark.createDataFrame([("h", ["a", "b"])], "head string, path array<string>")
    assert path.select(R.path_rule(F.col("head"), F.col("path"))).first()[0] == "h(X,Y) <- a(X,Z_1)&b(Z_1,Y)"


def test_retrieval_of_two_diverse_examples(spark):
    tokens = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "C"), (3, "D"), (3, "E")], "doc long, token string")
    index = M.tfidf(tokens)
    q = M.query_vectors(spark.createDataFrame([(0, "A"), (0, "B")], "query long, token string"), index)
    sims = M.cosine(q, index)
    assert [x.doc for x in M.diverse(M.most_similar(sims, 3), index, 2, 0.7).orderBy("place").collect()] == [1, 2]
    unknown = M.query_vectors(spark.createDataFrame([(0, "Z")], "query long, token string"), index).first()
    assert unknown.weight == pytest.approx(math.log(4) + 1)


def test_files(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"3": [{"head_rel": 3, "body_rels": [1, 2], "var_constraints": [[0, 2]], "conf": 0.5, "rule_supp": 1, "body_supp": 2}]}')
    rule = files.read_rules(spark, str(path)).first()
    assert (rule.head_rel, rule.body_rels, rule.llm_confidence) == (3, [1, 2], 0.0)
    (tmp_path / "c.json").write_text('{"7": {"1": 0.5, "2": 0.25}}')
    c = files.read_candidates(spark, str(tmp_path / "c.json"))
    files.write_candidates(c, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_written_candidates(spark, str(tmp_path / "out")).collect())) == [(7, 1, 0.5), (7, 2, 0.25)]
    (tmp_path / "p.json").write_text('{"actions": {"delete": ["a"], "downweight": {"b": 0.5}, "promote": {}}}')
    assert {tuple(x) for x in files.read_patch(spark, str(tmp_path / "p.json")).collect()} == {("delete", 0, "a", None), ("downweight", 0, "b", 0.5)}
    (tmp_path / "train.txt").write_text("a\tr\tb\t2014-01-01\n")
    (tmp_path / "e.json").write_text('{"a": 0, "b": 1}')
    (tmp_path / "r.json").write_text('{"r": 4}')
    (tmp_path / "t.json").write_text('{"2014-01-01": 9}')
    vocabularies = [quads.read_vocabulary(spark, str(tmp_path / f"{x}.json")) for x in "ert"]
    assert tuple(quads.encode(quads.read_named_quads(spark, str(tmp_path / "train.txt")), *vocabularies).first()) == (0, 4, 1, 9)
    (tmp_path / "train.txt").write_text("a\tr\tzz\t2014-01-01\n")
    with pytest.raises(Exception, match="unknown object"):
        quads.encode(quads.read_named_quads(spark, str(tmp_path / "train.txt")), *vocabularies).collect()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    os.makedirs(source)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.mode("append").parquet(str(source))
    flow = stream.windowed_counts(stream.quad_stream(spark, str(source)))
    running = flow.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert spark.table("counts").count() > 0
