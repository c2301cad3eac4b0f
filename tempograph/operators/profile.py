"""Relation profiles: counts, density, terciles, country pairs, reservoir samples, inverse flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relation_profile(facts: DataFrame) -> DataFrame:
    """By relation: count, first and last time, span, density n / (span + 1), and its class by the global terciles."""
    base = facts.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    base = base.withColumn("span", F.col("last_ts") - F.col("first_ts")).withColumn("density", F.col("n") / (F.col("span") + 1))
    cuts = base.agg(F.percentile("density", 1 / 3).alias("p33"), F.percentile("density", 0.5).alias("p50"), F.percentile("density", 2 / 3).alias("p66"))
    level = F.when(F.col("density") <= F.col("p33"), "LOW").when(F.col("density") <= F.col("p66"), "MEDIUM").otherwise("HIGH")
    return base.crossJoin(F.broadcast(cuts)).select("rel", "n", "first_ts", "last_ts", "span", F.round("density", 6).alias("density"), F.round("p50", 6).alias("median_density"), level.alias("level"))


def pair_shares(rows: DataFrame, by: str = "rel", source: str = "source", target: str = "target", k: int = 5) -> DataFrame:
    """The k most frequent (source, target) pairs of each group with their share of it."""
    counted = rows.groupBy(by, source, target).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), source, target))
    return counted.withColumn("share", F.round(share, 6)).withColumn("place", place.cast("long")).where(F.col("place") <= k)


def prefer_complete(rows: DataFrame, key: list[str], order: str, source: str, target: str) -> DataFrame:
    """One row per key: the last with both countries if there is one, else the first."""
    both = F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != "") & (F.col(target) != "")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("both"), F.when(F.col("both"), -F.col(order)).otherwise(F.col(order))))
    return rows.withColumn("both", both).withColumn("place", place).where("place = 1").drop("both", "place")


def reservoir(rows: DataFrame, by: str, k: int, key: list[str], seed: int = 0) -> DataFrame:
    """A seeded uniform sample of k rows of each group, the same for equal inputs."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *key), *key))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def flipped_pairs(pairs: str = "pairs") -> Column:
    """An inverse relation's pairs: source and target change places."""
    return F.transform(pairs, lambda p: F.struct(p["target"].alias("source"), p["source"].alias("target"), p["n"].alias("n")))


def month(date: str) -> Column:
    return F.substring(date, 1, 7)
