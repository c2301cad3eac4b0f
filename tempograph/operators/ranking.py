"""Filtered ranks, Hits@k, MRR, fusion with a baseline, predicted top answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = tuple(i / 20 for i in range(21))


def other_answers(split: DataFrame) -> DataFrame:
    """(qid, entity): the other true objects at a query's (sub, rel, ts), of the evaluated split."""
    q = split.select("qid", "sub", "rel", "ts", "obj")
    other = split.select("sub", "rel", "ts", F.col("obj").alias("entity")).distinct()
    return q.join(other, ["sub", "rel", "ts"]).where("entity <> obj").select("qid", "entity").distinct()


def filtered(candidates: DataFrame, split: DataFrame) -> DataFrame:
    """The filtered setting: candidates without other true answers."""
    return candidates.join(other_answers(split), ["qid", "entity"], "left_anti")


def ranks(candidates: DataFrame, answers: DataFrame, n_entities: int) -> DataFrame:
    """(qid, best, average, worst, cand_rank) of each answer (qid, entity).

    An answer that isn't a candidate has rank n_entities. cand_rank is null then, else the best rank.
    """
    truth = answers.select("qid", F.col("entity").alias("answer"))
    scores = truth.join(candidates, "qid", "left")
    own = F.max(F.when(F.col("entity") == F.col("answer"), F.col("score"))).over(Window.partitionBy("qid", "answer"))
    counted = scores.withColumn("own", own).groupBy("qid", "answer").agg(
        F.max("own").alias("own"), F.sum((F.col("score") > F.col("own")).cast("long")).alias("above"), F.sum((F.col("score") == F.col("own")).cast("long")).alias("equal")
    )
    found = F.col("own").isNotNull()
    best, worst = F.col("above") + 1, F.col("above") + F.col("equal")
    n = F.lit(n_entities).cast("long")
    return counted.select(
        "qid", F.when(found, best).otherwise(n).alias("best"), F.when(found, F.floor((best + worst) / 2)).otherwise(n).cast("long").alias("average"),
        F.when(found, worst).otherwise(n).alias("worst"), F.when(found, best).alias("cand_rank"),
    )


def hits_and_mrr(ranked: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Hits@1, @3, @10 and MRR, 6 digits."""
    hit = [F.round(F.avg(F.when(F.col(column) <= k, 1.0).otherwise(0.0)), 6).alias(f"hits{k}") for k in (1, 3, 10)]
    return ranked.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), *hit, F.round(F.avg(1.0 / F.col(column)), 6).alias("mrr"))


def fused(rule: DataFrame, graph: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """graph + w (rule - graph) for every weight: (qid, w, entity, score); a missing score is 0.

    The weights are at most a few tens of constants, so they are an array to explode, not a join.
    """
    r, g = rule.select("qid", "entity", F.col("score").alias("r")), graph.select("qid", "entity", F.col("score").alias("g"))
    both = r.join(g, ["qid", "entity"], "full").fillna(0.0, ["r", "g"])
    each = both.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return each.select("qid", "w", "entity", (F.col("g") + F.col("w") * (F.col("r") - F.col("g"))).alias("score"))


def rank_grid(scores: DataFrame, answers: DataFrame, setting: str = "best") -> DataFrame:
    """(qid, w, rank) for fused scores; an answer without any score ties with the other zeros at 0."""
    truth = answers.select("qid", F.col("entity").alias("answer"))
    joined = scores.join(truth, "qid")
    own = F.coalesce(F.max(F.when(F.col("entity") == F.col("answer"), F.col("score"))).over(Window.partitionBy("qid", "w")), F.lit(0.0))
    counted = joined.withColumn("own", own).groupBy("qid", "w").agg(F.sum((F.col("score") > F.col("own")).cast("long")).alias("above"), F.sum((F.col("score") == F.col("own")).cast("long")).alias("equal"))
    best, worst = F.col("above") + 1, F.col("above") + F.greatest("equal", F.lit(1))
    rank: dict[str, Column] = {"best": best, "worst": worst, "average": F.floor((best + worst) / 2).cast("long")}
    return counted.select("qid", "w", rank[setting].alias("rank"))


def nearest_weight(grid: DataFrame, wanted: float) -> DataFrame:
    place = F.row_number().over(Window.orderBy(F.abs(F.col("w") - wanted), "w"))  # one row per weight
    return grid.withColumn("place", place).where("place = 1").drop("place")


def predicted(scores: DataFrame) -> DataFrame:
    """(qid, pred_top1, top_score): the best candidate, the smallest entity on a tie."""
    best = F.max_by("entity", F.struct("score", -F.col("entity")))
    return scores.groupBy("qid").agg(best.alias("pred_top1"), F.max("score").alias("top_score"))


def predicted_by(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(qid, a column for each name): the best candidate at its weight, in one pass over the fused scores."""
    best = F.struct("score", -F.col("entity"))
    return scores.groupBy("qid").agg(*[F.max_by("entity", F.when(F.col("w") == w, best)).alias(name) for name, w in weights.items()])


def dense_ranks(scores, answer: int, exclude: list[int] | None = None) -> dict[str, int]:
    """The other rank definitions on one dense score vector: ill, harsh, balance and random (which draws nothing)."""
    import numpy as np

    scores = np.asarray(scores, float)
    truth = np.zeros(len(scores), bool)
    truth[list(exclude or [])] = True
    others = ~truth
    others[answer] = False
    own = scores[answer]
    order = np.argsort(scores)[::-1]
    allowed = [i for i in order if others[i] or i == answer]
    nonzero = int(np.count_nonzero(scores[others]))
    at_least = int((scores[others] >= own).sum()) + 1
    return {"ill": int((scores[others] > own).sum()) + 1, "harsh": at_least, "balance": allowed.index(answer) + 1 if own != 0 else nonzero + 1, "random": at_least}


def rank_summary(ranked: DataFrame, column: str = "rank") -> DataFrame:
    return hits_and_mrr(ranked, column)
