"""Error diagnosis: breakdowns, relations, popularity, harmful and risky rules, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINELS = ("GRAPH", "GRAPH_MISSING", "TRACE_ERROR")


def percentile(column: str, p: float) -> Column:
    """Exact, linear between neighbours; p in 0..1."""
    return F.percentile(column, p)


def bucket() -> Column:
    """NoCand, HitTop1, NoHit, HitNotTop1, in this order; a trace row has cand_size, pred_top1, gt_tail, gt_rank."""
    return F.when(F.col("cand_size") == 0, "NoCand").when(F.col("pred_top1") == F.col("gt_tail"), "HitTop1").when(F.col("gt_rank").isNull(), "NoHit").otherwise("HitNotTop1")


def breakdown(trace: DataFrame) -> DataFrame:
    """Rows and share of each bucket, with statistics of the ranks."""
    total = F.greatest(F.sum(F.count(F.lit(1))).over(Window.partitionBy()), F.lit(1))  # over four rows
    grouped = trace.withColumn("bucket", bucket()).groupBy("bucket")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / total, 6).alias("share"), F.round(F.avg("gt_rank"), 6).alias("mean_rank"),
        F.round(percentile("gt_rank", 0.5), 6).alias("median_rank"), F.round(percentile("gt_rank", 0.95), 6).alias("p95_rank"),
    )


def harm_and_improve(trace: DataFrame) -> DataFrame:
    """harm: the graph was right and the fusion is wrong; improve: the reverse."""
    graph, fusion = F.col("graph_top1") == F.col("gt_tail"), F.col("pred_top1") == F.col("gt_tail")
    kind = F.when(graph & ~fusion, "harm").when(~graph & fusion, "improve").otherwise("same")
    return trace.withColumn("effect", kind).groupBy("effect").agg(F.count(F.lit(1)).alias("n"))


def relation_diagnosis(trace: DataFrame, min_n: int = 1) -> DataFrame:
    """By relation: NoHit and Hit (rank null or not), Top1, its ratio to hits (not restricted to them), size and rank percentiles."""
    hit, top1 = F.col("gt_rank").isNotNull(), F.col("pred_top1") == F.col("gt_tail")
    n, hits, firsts = F.count(F.lit(1)), F.sum(hit.cast("long")), F.sum(top1.cast("long"))
    out = trace.groupBy("relation").agg(
        n.alias("n"), (n - hits).alias("nohit"), hits.alias("hit"), firsts.alias("top1"), F.round(F.try_divide(firsts, hits), 6).alias("cond_top1_given_hit"),
        F.sum((~top1).cast("long")).alias("wrong_top1"), F.round(percentile("cand_size", 0.95), 6).alias("cand_size_p95"), F.round(F.avg("gt_rank"), 6).alias("mean_rank"),
    )
    return out.where(F.col("n") >= min_n)


def worst_relations(diagnosis: DataFrame, k: int = 30) -> DataFrame:
    """The k relations with the most misses and wrong answers."""
    return diagnosis.orderBy(F.desc(F.col("nohit") + F.col("wrong_top1")), F.desc("n"), "relation").limit(k)


def top_counts(df: DataFrame, by: str, item: str, k: int, first: str | None = None) -> DataFrame:
    """The k most frequent items of each group: count descending, then where they first stood (or the item)."""
    agg = [F.count(F.lit(1)).alias("n")] + ([F.min(first).alias("first")] if first else [])
    counted = df.groupBy(by, item).agg(*agg)
    order = Window.partitionBy(by).orderBy(F.desc("n"), "first" if first else item)
    return counted.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def popularity_bias(trace: DataFrame, train: DataFrame, k: int = 10, min_n: int = 1) -> DataFrame:
    """By relation: how many of its k most frequent wrong answers are among the k most frequent training objects."""
    wrong = trace.where("pred_top1 <> gt_tail")
    top_wrong = top_counts(wrong, "relation", "pred_top1", k, "qid").select("relation", F.col("pred_top1").alias("eid"), F.col("n").alias("wrong"))
    popular = top_counts(train.select(F.col("rel").alias("relation"), F.col("obj").alias("eid")), "relation", "eid", k).select("relation", "eid", F.col("place").alias("train_rank"))
    both = top_wrong.join(popular, ["relation", "eid"], "left")
    out = both.groupBy("relation").agg(F.count(F.lit(1)).alias("wrong_items"), F.count("train_rank").alias("overlap"), F.sum("wrong").alias("wrong"))
    return out.where(F.col("wrong") >= min_n).withColumn("overlap_share", F.round(F.col("overlap") / F.col("wrong_items"), 6))


def harmful_rules(trace: DataFrame, k: int = 200) -> DataFrame:
    """trace has rule_id arrays top1_rules and ans_rules. Harm is the share of wrong answers among those a rule triggered."""
    correct = F.col("pred_top1") == F.col("gt_tail")
    top = trace.select(F.explode("top1_rules").alias("rule_id"), correct.alias("right"), "gt_rank").where(~F.col("rule_id").isin(*SENTINELS))
    top = top.groupBy("rule_id").agg(F.count(F.lit(1)).alias("trigger"), F.sum((~F.col("right")).cast("long")).alias("wrong"), F.round(F.avg("gt_rank"), 6).alias("avg_gt_rank"))
    ans = trace.where(correct).select(F.explode("ans_rules").alias("rule_id")).where(~F.col("rule_id").isin(*SENTINELS))
    ans = ans.groupBy("rule_id").agg(F.count(F.lit(1)).alias("help"))
    out = top.join(ans, "rule_id", "full").fillna(0, ["trigger", "wrong", "help"])
    harm = F.coalesce(F.round(F.try_divide(F.col("wrong"), F.col("trigger")), 6), F.lit(0.0))
    return out.withColumn("harm_rate", harm).orderBy(F.desc("harm_rate"), F.desc("wrong"), F.desc("trigger"), "rule_id").limit(k)


def risky_rules(rules: DataFrame, per_relation: int = 5) -> DataFrame:
    """conf (1 + 1/sqrt(supp + 1)) (1 + 0.1 max(0, length - 1)), the highest of each head relation."""
    risk = F.col("conf") * (1 + 1 / F.sqrt(F.col("rule_supp") + 1)) * (1 + 0.1 * F.greatest(F.lit(0), F.size("body_rels") - 1))
    order = Window.partitionBy("head_rel").orderBy(F.desc("risk"), "rule_id")
    return rules.withColumn("risk", F.round(risk, 6)).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= per_relation)


def sample_cases(trace: DataFrame, k: int) -> DataFrame:
    """The first k cases of each relation: errors before others, each in file order."""
    error = (F.col("pred_top1") != F.col("gt_tail")).cast("int")
    order = Window.partitionBy("relation").orderBy(F.desc("is_error"), "qid")
    return trace.withColumn("is_error", error).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def trace_of_candidates(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """A trace from candidates alone, where no trace was written: qid, gt_tail, pred_top1, cand_size, gt_rank."""
    best = F.max_by("entity", F.struct("score", -F.col("entity")))
    size = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("cand_size"), best.alias("pred_top1"))
    own = queries.select("qid", F.col("obj").alias("entity")).join(candidates, ["qid", "entity"]).select("qid", F.col("score").alias("own"))
    above = candidates.join(own, "qid").groupBy("qid").agg((F.sum((F.col("score") > F.col("own")).cast("long")) + 1).alias("gt_rank"))
    out = queries.select("qid", F.col("obj").alias("gt_tail")).join(size, "qid", "left").join(above, "qid", "left")
    return out.fillna(-1, ["pred_top1"]).fillna(0, ["cand_size"])


def worst_with_popularity(diagnosis: DataFrame, popularity: DataFrame, k: int = 30) -> DataFrame:
    """The worst relations with their popularity bias; null where none was measured."""
    return worst_relations(diagnosis, k).join(popularity, "relation", "left")


def evidence_bundle(trace: DataFrame, rules: DataFrame, train: DataFrame, k: int = 30) -> dict[str, DataFrame]:
    """What a round's proposal reads: breakdown, worst relations with popularity, harmful and risky rules, cases."""
    popularity = popularity_bias(trace, train)
    return {
        "breakdown": breakdown(trace), "worst_relations": worst_with_popularity(relation_diagnosis(trace), popularity, k),
        "harmful_rules": harmful_rules(trace), "risky_rules": risky_rules(rules), "cases": sample_cases(trace, 20),
    }
