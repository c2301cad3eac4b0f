"""Rules, candidates, traces, patches and baselines as files; readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.functions.rules import canonical, rule_id, verbalised

RULE = "struct<head_rel:bigint,body_rels:array<bigint>,var_constraints:array<array<int>>,conf:double,rule_supp:bigint,body_supp:bigint,llm_confidence:double,rule_id:string>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object head_rel -> list of rules; rule_order is the place in the file.

    A rule without an id gets that of its canonical string over relation ids; identified() gives those over names.
    """
    text = spark.read.text(path, wholetext=True)
    heads = text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,array<{RULE}>>"))).alias("h", "entry"))
    rows = heads.select("h", F.posexplode("entry.value").alias("i", "r")).select("h", "i", "r.*")
    named = rows.withColumn("rule_id", F.coalesce("rule_id", rule_id(canonical("cast(head_rel as string)", "transform(body_rels, r -> cast(r as string))", "coalesce(var_constraints, array())"))))
    out = named
    out = out.withColumn("rule_order", F.col("h").cast("long") * (1 << 32) + F.col("i"))
    return out.withColumn("llm_confidence", F.coalesce("llm_confidence", F.lit(0.0))).drop("h", "i")


def write_rules(rules: DataFrame, path: str) -> None:
    """One JSON line per head with its rules in order; read_written_rules reads it."""
    fields = ["rule_order", "rule_id", "head_rel", "body_rels", "var_constraints", "conf", "rule_supp", "body_supp", "llm_confidence"]
    rules.groupBy("head_rel").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rules")).write.mode("overwrite").json(path)


def read_written_rules(spark: SparkSession, path: str) -> DataFrame:
    """What write_rules wrote, a row each."""
    rule = RULE.replace("struct<", "struct<rule_order:bigint,")
    return spark.read.schema(f"head_rel long, rules array<{rule}>").json(path).select(F.explode("rules").alias("r")).select("r.*")


def identified(rules: DataFrame, names: DataFrame) -> DataFrame:
    """rules with head_name, body_names, rule (the canonical string) and its rule_id; names (id, name) is a vocabulary."""
    from tempograph.operators.cleaning import renamed

    out = renamed(rules, names)
    return out.withColumn("rule", canonical("head_name", "body_names")).withColumn("rule_id", rule_id(F.col("rule")))


def write_rule_text(rules: DataFrame, path: str, form: str = "rule") -> None:
    """A line a rule, by head and place: the rule, its id and rule with a tab between, or its measures before it."""
    line = {"rule": F.col("rule"), "id": F.concat_ws("\t", "rule_id", "rule"), "confidence": verbalised(F.col("rule"))}[form]
    rules.orderBy("head_rel", "rule_order").select(line.alias("value")).write.mode("overwrite").text(path)


def write_ranked(rules: DataFrame, path: str) -> None:
    """Ranked rules with names: a JSON line each, by head and place."""
    out = rules.withColumn("abstract_rule", verbalised(F.col("rule"))).withColumn("confidence", F.col("conf"))
    fields = ["rule_id", "head_rel", "head_name", "body_rels", "body_names", "var_constraints", "conf", "rule_supp", "body_supp", "rule", "abstract_rule", "confidence"]
    out.orderBy("head_rel", "rule_order").select(*fields).write.mode("overwrite").json(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """A JSON line per query, by qid."""
    trace.orderBy("qid").write.mode("overwrite").json(path)


POOL = "ex_id string, head_rel_name string, paths array<string>, rules array<string>, path_rels array<string>"


def write_pool(pool: DataFrame, path: str) -> None:
    pool.orderBy("head_rel_name", "ex_id").write.mode("overwrite").json(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """An example pool of JSON lines; blank lines are left out."""
    return spark.read.schema(POOL).json(path).where("ex_id is not null")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(head, paths) of a text file with a path rule a line; lines without an arrow, as the index lines, are left out."""
    lines = read_rule_lines(spark, path)
    return lines.groupBy("head").agg(F.sort_array(F.collect_set("rule")).alias("paths"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, of a chain of fallbacks; None if none does."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    return next((p for p in paths if (at := hadoop.Path(p)).getFileSystem(conf).exists(at)), None)


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(head, rule) of text files with a rule a line; lines without an arrow are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("rule")).where(F.col("rule").contains("<-"))
    return lines.select(F.trim(F.regexp_extract("rule", r"^(.*?)\(\w+,\s*\w+,\s*\w+\)\s*<-", 1)).alias("head"), "rule")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object qid -> {entity: score} as (qid, entity, score)."""
    text = spark.read.text(path, wholetext=True)
    queries = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("qid", "found"))
    return queries.select(F.col("qid").cast("long").alias("qid"), F.explode("found").alias("entity", "score")).select("qid", F.col("entity").cast("long").alias("entity"), "score")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """One JSON line per query: qid and its candidates, the best first."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity", "score")))
    out = candidates.groupBy("qid").agg(F.transform(order, lambda x: F.struct(x["entity"].alias("entity"), x["score"].alias("score"))).alias("candidates"))
    out.write.mode("overwrite").json(path)


def read_written_candidates(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("qid long, candidates array<struct<entity:bigint,score:double>>").json(path)
    return rows.select("qid", F.explode("candidates").alias("c")).select("qid", "c.*")


TRACE = "qid long, relation string, gt_tail long, pred_top1 long, gt_rank long, cand_size long, graph_top1 long, top1_rules array<string>, ans_rules array<string>"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def read_patch(spark: SparkSession, path: str) -> DataFrame:
    """(action, pos, rule_id, scale) of a patch file."""
    schema = "actions struct<delete:array<string>,downweight:map<string,double>,promote:map<string,double>>"
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("p")).select("p.actions.*")
    deleted = row.select(F.posexplode("delete").alias("pos", "rule_id")).select(F.lit("delete").alias("action"), "pos", "rule_id", F.lit(None).cast("double").alias("scale"))
    out = deleted
    for action in ("downweight", "promote"):
        part = row.select(F.posexplode(F.map_entries(action)).alias("pos", "e")).select(F.lit(action).alias("action"), "pos", F.col("e.key").alias("rule_id"), F.col("e.value").alias("scale"))
        out = out.unionByName(part)
    return out


def read_baseline(spark: SparkSession, quads_path: str, scores_path: str, hours: bool = False) -> DataFrame:
    """(sub, rel, obj, ts, scores array<float>) of two .npy files on the driver, the first row of equal quads.

    Convert large ones to Parquet once; this reader takes blocks through a memory map. hours: times are hours, kept as days.
    """
    import numpy as np

    quads, scores = np.load(quads_path, mmap_mode="r"), np.load(scores_path, mmap_mode="r")
    if len(quads) != len(scores):
        raise ValueError("quads and scores differ in length")
    rows = [(*map(int, q), i) for i, q in enumerate(quads)]
    index = spark.createDataFrame(rows, "sub long, rel long, obj long, ts long, i long")

    def run(batches):
        held = np.load(scores_path, mmap_mode="r")
        for batch in batches:
            yield batch.assign(scores=[held[i].astype("float32").tolist() for i in batch["i"]])

    first = index.groupBy("sub", "rel", "obj", "ts").agg(F.min("i").alias("i"))
    out = first.mapInPandas(run, "sub long, rel long, obj long, ts long, i long, scores array<float>").drop("i")
    return out.withColumn("ts", F.floor(F.col("ts") / 24)) if hours else out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_geo_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A similarity matrix as Parquet cells (i, j, sim)."""
    return spark.read.schema("i long, j long, sim double").parquet(path)
