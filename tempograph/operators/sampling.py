"""Seeded sampling: cyclic temporal walks, edges by time, row samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.operators.confidence import rule_seed


def edges_by_time(facts: DataFrame, by: str, seed: int = 0) -> DataFrame:
    """Keeps an edge with probability (t - min) / (max - min), nudged inside (0, 1); all of them where min = max."""
    bounds = facts.groupBy(by).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "sub", "rel", "obj", "ts"), F.lit(1 << 40)) / float(1 << 40)
    chance = (F.col("ts") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * (1 - 2e-10) + 1e-10
    return facts.join(bounds, by).where((F.col("low") == F.col("high")) | (draw < chance)).select(facts.columns)


def seeded_sample(rows: DataFrame, k: int, key: list[str], seed: int = 0) -> DataFrame:
    """k rows in a seeded order, the same for equal inputs."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k)


def sample_walks(facts: DataFrame, inverse: DataFrame, *, length: int = 3, walks: int = 100, weighting: str = "unif", relax: bool = False, seed: int = 1) -> DataFrame:
    """Cyclic walks of each relation: (rel, entities, relations, timestamps), those that succeed.

    A walk starts with a random edge of the relation; the next edge is earlier, later ones not later than the one before, and
    not its inverse; the last returns to the start. Steps are joins: each walk draws its next edge by the least hash of (walk,
    step, edge), or the least exponential race with rate exp(ts - now), so the graph is never held in one place.
    """
    e = facts.distinct().select(F.col("sub").alias("f"), F.col("rel").alias("r"), F.col("obj").alias("o"), F.col("ts").alias("t"))

    def draw(*key) -> Column:
        unit = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return -F.log(unit)

    numbers = e.select("r").distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    sized = e.withColumn("p", F.xxhash64(F.lit(seed), "f", "r", "o", "t"))
    ranked = sized.withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy("p", "f", "o", "t")))
    counts = e.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    starts = numbers.join(counts, "r").withColumn("place", (F.pmod(F.xxhash64(F.lit(seed + 1), "r", "walk"), F.col("n")) + 1).cast("int")).join(ranked, ["r", "place"])
    now = starts.select(F.col("r").alias("rel"), "walk", F.array("f", "o").alias("entities"), F.array("r").alias("relations"), F.array("t").alias("timestamps"))
    for step in range(1, length):
        last = F.element_at("timestamps", -1)
        limit = F.element_at("timestamps", 1) if relax else last
        open_ = now.withColumn("node", F.element_at("entities", -1)).withColumn("last", last).withColumn("limit", limit)
        open_ = open_.join(inverse.select(F.col("rel").alias("prev"), "inv"), F.element_at("relations", -1) == F.col("prev")).drop("prev")
        on = (F.col("node") == F.col("f")) & (F.col("t") < F.col("limit") if step == 1 else F.col("t") <= F.col("limit"))
        if step > 1:
            on = on & ~((F.col("r") == F.col("inv")) & (F.col("o") == F.element_at("entities", -2)) & (F.col("t") == F.col("last")))
        if step == length - 1:
            on = on & (F.col("o") == F.element_at("entities", 1))
        race = draw("rel", "walk", F.lit(step), "f", "r", "o", "t")
        if weighting == "exp":
            race = race / F.exp(F.greatest(F.col("t") - F.col("last"), F.lit(-700)).cast("double"))
        chosen = open_.join(e, on).groupBy("rel", "walk", "entities", "relations", "timestamps").agg(F.min_by(F.struct("r", "o", "t"), race).alias("next"))
        now = chosen.select("rel", "walk", F.concat("entities", F.array("next.o")).alias("entities"), F.concat("relations", F.array("next.r")).alias("relations"), F.concat("timestamps", F.array("next.t")).alias("timestamps"))
    return now


def task_rng(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(rule_seed(seed, "|".join(map(str, key))))


def shuffled(items: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """Each group's items in a seeded order: (by, items)."""
    order = F.struct(F.xxhash64(F.lit(seed), by, key).alias("h"), F.col(key).alias("item"))
    return items.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["item"]).alias("items"))

