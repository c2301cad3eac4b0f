"""Edits of rule confidences between rounds, and incremental recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOWN, UP = (0.2, 0.9), (1.0, 1.2)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def valid_patch(patch: DataFrame, allowed: DataFrame, *, max_delete: int = 50, max_downweight: int = 50, max_promote: int = 20) -> DataFrame:
    """patch (action, pos, rule_id, scale): known rules, scales clipped, the first ones of each action, delete before others."""
    known = patch.where("rule_id is not null").join(allowed.select("rule_id").distinct(), "rule_id", "left_semi")
    known = known.where("action = 'delete' or scale is not null")
    scale = F.when(F.col("action") == "downweight", clipped(F.col("scale"), *DOWN)).when(F.col("action") == "promote", clipped(F.col("scale"), *UP))
    place = F.row_number().over(Window.partitionBy("action").orderBy("pos"))
    most = F.when(F.col("action") == "delete", max_delete).when(F.col("action") == "downweight", max_downweight).otherwise(max_promote)
    capped = known.withColumn("scale", scale).withColumn("place", place).where(F.col("place") <= most).drop("place")
    deleted = capped.where("action = 'delete'")
    return deleted.unionByName(capped.where("action <> 'delete'").join(deleted.select("rule_id"), "rule_id", "left_anti"))


def apply_patch(rules: DataFrame, patch: DataFrame) -> DataFrame:
    """Deletes; conf times the downweight, then times the promotion, inside [0, 1]. llm_confidence stays."""
    scales = patch.groupBy("rule_id").agg(
        F.max((F.col("action") == "delete").cast("int")).alias("gone"), F.max(F.when(F.col("action") == "downweight", clipped(F.col("scale"), *DOWN))).alias("down"),
        F.max(F.when(F.col("action") == "promote", clipped(F.col("scale"), *UP))).alias("up"),
    )
    joined = rules.join(scales, "rule_id", "left").where("coalesce(gone, 0) = 0")
    conf = clipped(F.col("conf") * F.coalesce("down", F.lit(1.0)) * F.coalesce("up", F.lit(1.0)), 0.0, 1.0)
    return joined.withColumn("conf", conf).drop("gone", "down", "up")


def affected_queries(rules: DataFrame, patch: DataFrame, queries: DataFrame) -> DataFrame:
    """The queries whose relation is the head of a changed rule."""
    heads = rules.join(patch.select("rule_id").distinct(), "rule_id", "left_semi").select(F.col("head_rel").alias("rel")).distinct()
    return queries.join(heads, "rel", "left_semi")


def overlay(old: DataFrame, new: DataFrame, qids: DataFrame | None = None) -> DataFrame:
    """old with the queries of new (or of qids, which may have no rows left in new) replaced by new's rows."""
    replaced = (new if qids is None else qids).select("qid").distinct()
    return old.join(replaced, "qid", "left_anti").unionByName(new)


def best_round(rounds: DataFrame) -> DataFrame:
    """The round with the highest (mrr, hits1), the earliest on a tie."""
    return rounds.orderBy(F.desc("mrr"), F.desc("hits1"), "round").limit(1)


def govern(rules: DataFrame, evaluate, propose, rounds: int) -> list[dict]:
    """The loop: evaluate(rules) gives mrr and hits1, propose(rules, round) a patch; each round starts from the last rules."""
    history = []
    for k in range(rounds + 1):
        scores = evaluate(rules)
        history.append({"round": k, "mrr": scores["mrr"], "hits1": scores["hits1"], "rules": rules})
        if k < rounds:
            rules = apply_patch(rules, valid_patch(propose(rules, k), rules))
    return history
