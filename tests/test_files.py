"""Writers and readers, and functions over single values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tempograph.functions import rules as R
from tempograph.operators import cleaning, diagnostics, generation, governance, graph, profile, ranking, retrieval, sampling, selection
from tempograph.sources import files, quads


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(0, 7, [1, 2, 3], [[0, 2]], 0.5, 5, 10, 0.25), (1, 7, [2], [], 0.125, 1, 8, 0.0), (2, 9, [1], [], 0.25, 2, 8, 0.0)]
    df = spark.createDataFrame(rows, "rule_order long, head_rel long, body_rels array<long>, var_constraints array<array<int>>, conf double, rule_supp long, body_supp long, llm_confidence double")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (7, "h"), (9, "k")], "id long, name string")
    return files.identified(df, names)


def test_rules_round_trip(spark, rules, tmp_path):
    path = f"file://{tmp_path}/rules"
    files.write_rules(rules, path)
    columns = ["rule_order", "rule_id", "head_rel", "body_rels", "var_constraints", "conf", "rule_supp", "body_supp", "llm_confidence"]
    assert sorted(files.read_written_rules(spark, path).select(columns).collect()) == sorted(rules.select(columns).collect())
    first = rules.where("rule_order = 0").first()
    assert first.rule == "h(X0,X2,T3) <- a(X0,X1,T0)&b(X1,X0,T1)&c(X0,X2,T2)" and first.rule_id == R.rule_id_text(first.rule) == R.rule_id_text(first.rule.replace(" <- ", "<-").replace("&", " & "))


@pytest.mark.parametrize("form, line", [("rule", "k(X0,X1,T1) <- a(X0,X1,T0)"), ("id", "\tk(X0,X1,T1) <- a(X0,X1,T0)"), ("confidence", "0.250000     2     8  k(X0,X1,T1) <- a(X0,X1,T0)")])
def test_rule_text(spark, rules, tmp_path, form, line):
    files.write_rule_text(rules, f"file://{tmp_path}/{form}", form)
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/{form}").collect()]
    assert len(lines) == 3 and any(x.endswith(line) for x in lines)
    if form == "confidence":
        bare = spark.read.text(f"file://{tmp_path}/{form}").select(R.without_measures(F.col("value")).alias("x"))
        assert "k(X0,X1,T1) <- a(X0,X1,T0)" in [r.x for r in bare.collect()]


def test_ranked_trace_pool_and_paths(spark, rules, tmp_path):
    files.write_ranked(rules, f"file://{tmp_path}/ranked")
    assert sorted((r.head_name, r.body_names) for r in spark.read.json(f"file://{tmp_path}/ranked").collect()) == [("h", ["a", "b", "c"]), ("h", ["b"]), ("k", ["a"])]
    trace = spark.createDataFrame([(2, "r", 5, 6, None, 3, 5, ["x"], ["GRAPH"]), (1, "r", 5, 5, 1, 3, 5, ["x"], ["x"])], files.TRACE)
    files.write_trace(trace, f"file://{tmp_path}/trace")
    assert sorted(files.read_trace(spark, f"file://{tmp_path}/trace").collect()) == sorted(trace.collect(), key=lambda r: r.qid)
    pool = spark.createDataFrame([("1", "h", ["p"], ["r"], ["a"])], files.POOL)
    files.write_pool(pool, f"file://{tmp_path}/pool")
    assert files.read_pool(spark, f"file://{tmp_path}/pool").collect() == pool.collect()
    (tmp_path / "paths.txt").write_text("index 1\nh(X0,X1,T1)<-b(X0,X1,T0)\n\nh(X0,X1,T1)<-a(X0,X1,T0)\n")
    assert [(r.head, len(r.paths)) for r in files.read_paths(spark, f"file://{tmp_path}/paths.txt").collect()] == [("h", 2)]
    assert files.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/pool"]).endswith("pool")
    assert files.first_existing(spark, [f"file://{tmp_path}/none"]) is None
    files.write_csv(pool.select("ex_id"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["ex_id"]


def test_static_triples_and_names(spark, tmp_path):
    (tmp_path / "facts.txt").write_text("a\tr\tb\nb\tr\tc\nc\tr\td\nd\tr\te\n")
    triples = quads.static_triples(spark, f"file://{tmp_path}/facts.txt")
    assert quads.thinned(triples, 0.5).count() == 2 and quads.thinned(triples, 0.5).collect() == quads.thinned(triples, 0.5).collect()
    (tmp_path / "names.txt").write_text("x\ny\n\nz\n")
    assert sorted((r.name, r.id) for r in quads.read_numbered(spark, f"file://{tmp_path}/names.txt").collect()) == [("x", 0), ("y", 1), ("z", 3)]
    assert [r.x for r in spark.range(4).select(quads.inverse_relation(F.col("id"), 2).alias("x")).collect()] == [2, 3, 0, 1]


def test_single_values(spark):
    one = spark.createDataFrame([("1. h(X0,X1,T1) <- a(X0,X1,T0)&b(X0,X1,T0)", 'text {"a": 1} more', 0.12345)], "line string, j string, v double")
    row = one.select(
        R.extracted(F.col("line")).alias("rule"), R.first_json(F.col("j"), "a int")["a"].alias("a"), R.percent(F.col("v")).alias("p"), R.short_number(F.col("v")).alias("s"),
        R.path_tokens(R.extracted(F.col("line"))).alias("tokens"), R.relation_list(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("names"),
        R.hours_between(F.lit(datetime.datetime(2024, 1, 1)), F.lit(datetime.datetime(2024, 1, 2, 3))).alias("h"),
    ).first()
    assert tuple(row) == ("h(X0,X1,T1) <- a(X0,X1,T0)&b(X0,X1,T0)", 1, "12.3%", "0.1235", ["a", "b"], "a;b", 27) or row.s in ("0.1234", "0.1235")
    assert R.to_bool(" Yes ") and not R.to_bool("0") and len(R.config_id({"b": 1, "a": 2})) == 8
    assert R.config_id({"a": 2, "b": 1}) == R.config_id({"b": 1, "a": 2})
    with pytest.raises(ValueError):
        R.to_bool("maybe")


def test_missing_baseline_rows(spark):
    q = spark.createDataFrame([(0, 1, 1, 1, 1), (1, 2, 2, 2, 2)], "qid long, sub long, rel long, obj long, ts long")
    base = spark.createDataFrame([(1, 1, 1, 1, [0.5, 0.1], 9), (1, 1, 1, 1, [0.25, 0.1], 3)], "sub long, rel long, obj long, ts long, scores array<double>, pos long")
    assert {r.qid: r.scores for r in selection.baseline_rows(q, base, 2, missing="zeros").collect()} == {0: [0.25, 0.1], 1: [0.0, 0.0]}
    assert {r.qid: r.scores for r in selection.baseline_rows(q, base, 2, missing="null").collect()} == {0: [0.25, 0.1], 1: None}
    with pytest.raises(Exception, match="no baseline row for query 1"):
        selection.baseline_rows(q, base, 2).collect()


def test_evidence_bundle(spark, rules):
    trace = spark.createDataFrame([(1, "r", 5, 6, 2, 3, 5, ["x"], ["y"]), (2, "r", 5, 5, 1, 3, 5, ["x"], ["x"])], files.TRACE)
    train = spark.createDataFrame([(1, "r", 6, 0)], "sub long, rel string, obj long, ts long")
    found = {k: v.collect() for k, v in diagnostics.evidence_bundle(trace, rules, train).items()}
    assert {k: len(v) for k, v in found.items()} == {"breakdown": 2, "worst_relations": 1, "harmful_rules": 1, "risky_rules": 3, "cases": 2}
    assert found["worst_relations"][0].overlap == 1


def test_rules_of_two_rounds(spark):
    old = spark.createDataFrame([("h(X0,X1,T1)<-a(X0,X1,T0)",), ("h(X0,X1,T1)<-b(X0,X1,T0)",)], "rule string")
    new = spark.createDataFrame([("h(X0,X1,T1) <- a(X0,X1,T0)",)], "rule string")
    assert sorted(r.rule for r in cleaning.not_regenerated(old, new).collect()) == ["h(X0,X1,T1) <- a(X0,X1,T0)", "h(X0,X1,T1)<-b(X0,X1,T0)"]
    rules = spark.createDataFrame([(f"r{i}", "h", [1], 0.5, 0.0) for i in range(60)], "rule_id string, head_rel string, body_rels array<int>, conf double, llm_confidence double")
    patch = spark.createDataFrame([("promote", i, f"r{i}", 1.1) for i in range(60)], "action string, pos int, rule_id string, scale double")
    assert governance.valid_patch(patch, rules).count() == 20  # the cap of promotions
    history = governance.govern(rules, lambda r: {"mrr": 0.5, "hits1": r.agg(F.max("conf")).first()[0]}, lambda r, k: patch, 1)
    assert [h["hits1"] for h in history] == [0.5, pytest.approx(0.55)]


def test_small_functions(spark):
    assert graph.enumerated([[1, 2], [3]]) == [(1, 3), (2, 3)]
    assert generation.profile_block({"n": 3, "level": None, "density": 0.5}) == "- facts: 3\n- facts per time step: 0.5"
    calls = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.25)], "input_tokens long, output_tokens long, cost double")
    assert tuple(generation.usage(calls).first()) == (2, 4, 6, 0.75)
    heads = spark.createDataFrame([(0, 5), (9, 0), (9, 9), (3, 3), (3, 9), (9, 3)], "n_paths int, n_rules int")
    assert [r.x for r in heads.select(retrieval.bottleneck().alias("x")).collect()] == ["missing_paths", "missing_rules", "ok_full", "both_short", "paths_short", "rules_short"]
    ranked = spark.createDataFrame([(1,), (4,)], "rank int")
    assert ranking.rank_summary(ranked).first().mrr == 0.625
    assert callable(sampling.task_rng) and callable(profile.month)
