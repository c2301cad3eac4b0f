"""Cleaning generated rules: spelling of relations, chain form and time order; first-occurrence dedup; overwrites."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import get_close_matches

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions.rules import ATOM_TEXT, normal, normal_constraints_sql

ERRORS = ("no atom", "time is no number", "unknown relation", "no chain", "time order")


def clean_rule(line: str, relations: list[str], known: frozenset[str]) -> tuple[str | None, str | None]:
    """(the rule, None) or (None, what is wrong with it). Misspelt relations become the closest known one."""
    atoms, node, end, head_time, times = [], None, None, None, []
    parts = [p for p in line.replace("<-", "&").split("&")]
    for i, part in enumerate(parts):
        found = ATOM_TEXT.search(part.strip())
        if not found:
            return None, ERRORS[0]
        relation, subject, object_, time = (found[k].strip() for k in range(1, 5))
        if not time[1:].isdigit():
            return None, ERRORS[1]
        if relation not in known:
            close = get_close_matches(relation, relations, n=1)
            if not close:
                return None, ERRORS[2]
            relation = close[0].strip()
        atoms.append(f"{relation}({subject},{object_},{time})")
        if i == 0:
            node, end, head_time = subject, object_, int(time[1:])
        elif node != subject:
            return None, ERRORS[3]
        else:
            node = object_
            times.append(int(time[1:]))
    if node != end or not times:
        return None, ERRORS[3]
    if times != sorted(times) or head_time < times[-1]:
        return None, ERRORS[4]
    return atoms[0] + "<-" + "&".join(atoms[1:]), None


def clean_rules(lines: DataFrame, relations: list[str], column: str = "rule") -> DataFrame:
    """lines with clean and error; relations is the vocabulary. Blank lines are left out."""
    known = frozenset(relations)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [clean_rule(x, relations, known) for x in batch[column]]
            yield batch.assign(clean=[b[0] for b in both], error=[b[1] for b in both])

    return lines.where(F.trim(column) != "").mapInPandas(run, ", ".join([*fields, "clean string", "error string"]))


def first_occurrences(lines: DataFrame, key, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("place", place).where("place = 1").drop("place")


def distinct_rules(rules: DataFrame, order: str = "rule_order") -> DataFrame:
    """One rule per head, body and constraints, the first; constraints that differ in order or in singletons are the same."""
    key = F.expr(normal_constraints_sql("var_constraints", "size(body_rels)"))
    place = F.row_number().over(Window.partitionBy("head_rel", "body_rels", key).orderBy(order))
    return rules.withColumn("place", place).where("place = 1").drop("place")


def cleaning_counts(cleaned: DataFrame, original: DataFrame) -> DataFrame:
    """(outcome, n) of cleaned lines: each error, kept (distinct rules) and new (kept ones that original lacks)."""
    bad = cleaned.where("error is not null").groupBy(F.col("error").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    kept = cleaned.where("clean is not null").select(normal(F.col("clean")).alias("rule")).distinct()
    new = kept.join(original.select(normal(F.col("rule")).alias("rule")).distinct(), "rule", "left_anti")
    out = bad
    for name, df in (("kept", kept), ("new", new)):
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n"))
    return out


def not_regenerated(original: DataFrame, new: DataFrame) -> DataFrame:
    """new rules, and the originals whose normal form isn't among them."""
    key = normal(F.col("rule"))
    return original.withColumn("key", key).join(new.select(key.alias("key")).distinct(), "key", "left_anti").drop("key").unionByName(new.select(original.columns))


def split_by_confidence(rules: DataFrame, min_conf: float) -> DataFrame:
    return rules.withColumn("side", F.when(F.col("conf") > min_conf, "high").otherwise("low"))


def stable_order(rules: DataFrame) -> DataFrame:
    """The total order of rules of a head: measures descending, then body and constraints."""
    return rules.orderBy("head_rel", F.desc("conf"), F.desc("llm_confidence"), F.desc("rule_supp"), F.desc("body_supp"), "body_rels", "var_constraints")


def length_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(F.size("body_rels").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("rules"), F.countDistinct("head_rel").alias("relations"))


def renamed(rules: DataFrame, names: DataFrame) -> DataFrame:
    """Head and body ids as names: adds head_name and body_names. names (id, name) is a vocabulary."""
    mapping = names.agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("name_of"))
    out = rules.crossJoin(F.broadcast(mapping))
    return out.withColumn("head_name", F.expr("name_of[head_rel]")).withColumn("body_names", F.expr("transform(body_rels, r -> name_of[r])")).drop("name_of")
