"""Which queries, relations, rules and walks take part: subsets, lookups and plain frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward(queries: DataFrame, n_base: int) -> DataFrame:
    """Queries of base relations; inverse ones have ids from n_base on."""
    return queries.where(F.col("rel") < n_base)


def of_qids(df: DataFrame, qids: DataFrame) -> DataFrame:
    return df.join(qids.select("qid").distinct(), "qid", "left_semi")


def requested(queries: DataFrame, qids: DataFrame | None, n_base: int | None) -> DataFrame:
    """The forward queries (n_base given) among the requested ones (qids given)."""
    out = queries if n_base is None else forward(queries, n_base)
    return out if qids is None else of_qids(out, qids)


def of_relations(df: DataFrame, relations: DataFrame, n_base: int) -> DataFrame:
    """Rows whose relation, or whose inverse's base relation, is selected: adds base_rel."""
    folded = df.withColumn("base_rel", F.col("rel") % n_base)
    return folded.join(relations.select((F.col("rel") % n_base).alias("base_rel")).distinct(), "base_rel", "left_semi")


def baseline_rows(queries: DataFrame, baseline: DataFrame, n_entities: int, *, missing: str = "error", order: str = "pos") -> DataFrame:
    """queries with the scores array of their baseline row, the first of equal quads.

    A query without one raises (error), gets n_entities zeros (zeros) or null (null).
    """
    key = ["sub", "rel", "obj", "ts"]
    first = baseline.groupBy(*key).agg(F.min_by("scores", order).alias("scores"))
    out = queries.join(first, key, "left")
    if missing == "null":
        return out
    none = F.array_repeat(F.lit(0.0).cast(baseline.schema["scores"].dataType.elementType), n_entities)
    if missing == "error":
        none = F.when(F.raise_error(F.concat(F.lit("no baseline row for query "), F.col("qid").cast("string"))).isNull(), none)
    return out.withColumn("scores", F.coalesce("scores", none))


def frontier(facts: DataFrame, starts: DataFrame, body: list) -> DataFrame:
    """(hop, sub, rel, obj, ts): the facts of each body atom whose subject the atom before reaches, without a time test."""
    reached, out = starts.select(F.col("sub")).distinct(), None
    for hop, rel in enumerate(body):
        step = facts.where(F.col("rel") == F.lit(rel)).join(reached, "sub", "left_semi").select(F.lit(hop).alias("hop"), "sub", "rel", "obj", "ts")
        out = step if out is None else out.unionByName(step)
        reached = step.select(F.col("obj").alias("sub")).distinct()
    return out


def complete_walks(facts: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """e0, r0, t0, e1, ..., of all time-ordered walks of this length from the starts, with their relations."""
    out = starts.select(F.col("sub").alias("e0")).distinct()
    for i in range(length):
        atom = facts.select(F.col("sub").alias("from"), F.col("rel").alias(f"r{i}"), F.col("ts").alias(f"t{i}"), F.col("obj").alias(f"e{i + 1}"))
        on = F.col(f"e{i}") == F.col("from")
        out = out.join(atom, on & (F.col(f"t{i - 1}") <= F.col(f"t{i}")) if i else on).drop("from")
    return out


def with_rows(quads: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """quads with the columns of the first row (by order) that has their names; nulls without one."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    first = rows.withColumn("place", place).where("place = 1").drop("place", order)
    return quads.join(first, key, "left")


def by_paths(heads: DataFrame, paths: DataFrame) -> DataFrame:
    """(head, has_paths)."""
    have = paths.select("head").distinct().withColumn("has_paths", F.lit(True))
    return heads.select("head").distinct().join(have, "head", "left").fillna(False, ["has_paths"])


def candidate_relations(similar: DataFrame, seen: DataFrame) -> DataFrame:
    """(rel, other): relations similar to rel, or seen on its paths."""
    return similar.select("rel", "other").unionByName(seen.select("rel", "other")).where("rel <> other").distinct()


def final_rules(low: DataFrame, high: DataFrame) -> DataFrame:
    """(place, rule): the distinct rules of both sides in their order, numbered per head so that no task sorts them all."""
    both = low.select("head", "rule").unionByName(high.select("head", "rule")).distinct()
    return both.withColumn("place", (F.row_number().over(Window.partitionBy("head").orderBy("rule")) - 1).cast("long"))


def indexed(paths: DataFrame, vocabulary: DataFrame, column: str = "path") -> DataFrame:
    """paths (id, path "r1|r2|...") with rels: the relations' ids in order; null where a name is unknown."""
    each = paths.select("id", F.posexplode(F.split(column, r"\|")).alias("pos", "name")).join(vocabulary.select("name", F.col("id").alias("rel")), "name", "left")
    rels = F.transform(F.sort_array(F.collect_list(F.struct("pos", "rel"))), lambda x: x["rel"])
    return paths.join(each.groupBy("id").agg(rels.alias("rels")), "id")


def descendants(triples: DataFrame) -> DataFrame:
    """(head, tails): the sorted distinct tails of each head."""
    return triples.select("head", "tail").distinct().groupBy("head").agg(F.sort_array(F.collect_list("tail")).alias("tails"))
