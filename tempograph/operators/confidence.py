"""Support and confidence of rules: exact by joins, or estimated by sampling bodies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.operators.walks import atoms, free, ground, of_relations, small, supports


def pair_max_ts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("rel", "sub", "obj").agg(F.max("ts").alias("max_ts"))


def rule_support(bodies: DataFrame, facts: DataFrame) -> DataFrame:
    """bodies (head_rel, e0, ek, t_last, ...) with holds: does the head hold strictly after the body's last time?"""
    last = pair_max_ts(facts).select(F.col("rel").alias("head_rel"), F.col("sub").alias("e0"), F.col("obj").alias("ek"), "max_ts")
    return bodies.join(last, ["head_rel", "e0", "ek"], "left").withColumn("holds", F.coalesce(F.col("max_ts") > F.col("t_last"), F.lit(False))).drop("max_ts")


def confidences(rules: DataFrame, facts: DataFrame, *, relax: bool = False, digits: int = 6, distinct: bool = False) -> DataFrame:
    """rules with body_supp, rule_supp and conf; a rule without a body has zeros. Constraints must match exactly. distinct: the
    facts are known to hold no row twice, so they needn't be shuffled to find out."""
    rules = small(rules)
    facts = of_relations(facts.select("sub", "rel", "obj", "ts"), atoms(rules).select("atom_rel").unionByName(rules.select(F.col("head_rel").alias("atom_rel"))), "rel")
    facts = (facts if distinct else facts.distinct()).persist(StorageLevel.DISK_ONLY)  # every hop reads them
    listed = rules if relax else rules.where(~free(rules))
    bodies = ground(listed, facts, relax=relax, exact=True, merged=False).join(F.broadcast(rules.select("rule_id", "head_rel")), "rule_id")
    counts = rule_support(bodies, of_relations(facts, listed.select(F.col("head_rel").alias("atom_rel")), "rel")).groupBy("rule_id").agg(F.sum("bodies").alias("body_supp"), F.sum(F.when(F.col("holds"), F.col("bodies")).otherwise(0)).alias("rule_supp"))
    if not relax:
        heads = pair_max_ts(of_relations(facts, rules.where(free(rules)).select(F.col("head_rel").alias("atom_rel")), "rel")).select(F.col("rel").alias("head_rel"), F.col("sub").alias("e0"), F.col("obj").alias("ek"), "max_ts")
        counts = counts.unionByName(supports(rules.where(free(rules)), facts, heads))
    out = rules.drop("body_supp", "rule_supp", "conf").join(counts, "rule_id", "left").fillna(0, ["body_supp", "rule_supp"])
    return out.withColumn("conf", F.coalesce(F.round(F.try_divide(F.col("rule_supp"), F.col("body_supp")), digits), F.lit(0.0)))


def kept(rules: DataFrame) -> DataFrame:
    """Rules with a confidence of either kind."""
    return rules.where("conf <> 0 or coalesce(llm_confidence, 0) <> 0")


def rule_seed(base_seed: int, text: str) -> int:
    """A rule's own seed, from its text."""
    return int.from_bytes(hashlib.blake2b(f"{base_seed}|{text}".encode(), digest_size=8).digest(), "little")


def sampled_confidences(rules: DataFrame, facts: DataFrame, *, samples: int = 2000, base_seed: int = 1, relax: bool = False) -> DataFrame:
    """body_supp and rule_supp over distinct sampled bodies: (rule_id, body_supp, rule_supp, conf).

    Each relation a rule needs is one row with its sorted edges; rules meet only the relations of their body and head, so
    memory per rule is that of a few relations. Every rule draws from a generator of its own seed.
    """
    edges = facts.distinct().groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("sub", "ts", "obj"))).alias("edges"))
    needs = rules.select("rule_id", "head_rel", "body_rels", "var_constraints", F.explode(F.array_distinct(F.concat("body_rels", F.array("head_rel")))).alias("rel"))
    joined = needs.join(edges, "rel", "left")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        tables = {}
        for rel, found in zip(rows["rel"], rows["edges"]):
            tables[rel] = np.array([(e["sub"], e["ts"], e["obj"]) for e in found], np.int64).reshape(-1, 3) if found is not None else np.zeros((0, 3), np.int64)
        body, head = list(first["body_rels"]), first["head_rel"]
        wanted = sorted(sorted(int(x) for x in g) for g in first["var_constraints"])
        rng = np.random.default_rng(rule_seed(base_seed, str(first["rule_id"])))
        bodies = set()
        for _ in range(samples if all(len(tables[r]) for r in body) else 0):
            s, t, o = tables[body[0]][rng.integers(len(tables[body[0]]))]
            walk = [int(s), int(t), int(o)]
            for rel in body[1:]:
                table = tables[rel]  # sorted by (sub, ts)
                low, high = np.searchsorted(table[:, 0], [walk[-1], walk[-1] + 1])
                if not relax:
                    low += np.searchsorted(table[low:high, 1], walk[-2])
                if low >= high:
                    break
                _, t, o = table[rng.integers(low, high)]
                walk += [int(t), int(o)]
            else:
                if wanted and groups_of(walk[::2]) != wanted:
                    continue
                bodies.add(tuple(walk))
        latest: dict = {}
        for s, t, o in tables[head].tolist():
            latest[s, o] = max(t, latest.get((s, o), t))
        holds = sum(latest.get((b[0], b[-1]), -1 << 62) > b[-2] for b in bodies)
        conf = round(holds / len(bodies), 6) if bodies else 0.0
        return pd.DataFrame({"rule_id": [key[0]], "body_supp": [len(bodies)], "rule_supp": [holds], "conf": [conf]})

    return joined.groupBy("rule_id").applyInPandas(run, f"rule_id {rules.schema['rule_id'].dataType.simpleString()}, body_supp long, rule_supp long, conf double")


def groups_of(entities: list) -> list[list[int]]:
    """Sorted groups of two or more positions that share an entity."""
    at: dict = {}
    for i, e in enumerate(entities):
        at.setdefault(e, []).append(i)
    return sorted(g for g in at.values() if len(g) > 1)
