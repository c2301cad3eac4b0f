"""Facts (sub, rel, obj, ts): files, vocabularies, inverses, splits, and the quads derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("sub", T.LongType()), ("rel", T.LongType()), ("obj", T.LongType()), ("ts", T.LongType()))])
NAMED_SCHEMA = "subject string, relation string, object string, timestamp string"
#: Which splits each background choice reads.
BACKGROUNDS = {
    "all": ("train", "valid", "test"), "train": ("train",), "valid": ("valid",), "test": ("test",),
    "train_valid": ("train", "valid"), "train_test": ("train", "test"), "valid_test": ("valid", "test"),
}
INVERSE_OFFSET = 1000


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object name -> id as (name, id)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "id"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A file of names, one a line: (name, id), the id being the line's number from 0."""
    lines = spark.read.text(path)
    numbered = lines.rdd.zipWithIndex().map(lambda x: (x[0].value.strip(), x[1]))
    return spark.createDataFrame(numbered, "name string, id long").where("name <> ''")


def relations_with_inverses(relations: DataFrame) -> DataFrame:
    """(name, id, inv_id, is_inverse): the inverse of base id i is i + the number of base relations."""
    n = relations.agg(F.count(F.lit(1)).alias("n"))
    base = relations.crossJoin(n)
    forward = base.select("name", "id", (F.col("id") + F.col("n")).alias("inv_id"), F.lit(False).alias("is_inverse"))
    inverse = base.select(F.concat(F.lit("inv_"), "name").alias("name"), (F.col("id") + F.col("n")).alias("id"), F.col("id").alias("inv_id"), F.lit(True).alias("is_inverse"))
    return forward.unionByName(inverse)


def inverse_relation(rel: Column, n_base: int) -> Column:
    return F.when(rel < n_base, rel + n_base).otherwise(rel - n_base)


def read_named_quads(spark: SparkSession, path: str) -> DataFrame:
    """A headerless TSV of names."""
    return spark.read.schema(NAMED_SCHEMA).option("sep", "\t").option("quote", "").csv(path)


def encode(named: DataFrame, entities: DataFrame, relations: DataFrame, timestamps: DataFrame) -> DataFrame:
    """Names to ids; an unknown name is an error, raised when its row is read."""
    out = named
    for column, vocabulary, new in (("subject", entities, "sub"), ("relation", relations, "rel"), ("object", entities, "obj"), ("timestamp", timestamps, "ts")):
        keyed = vocabulary.select(F.col("name").alias(column), F.col("id").alias(new))
        out = out.join(keyed, column, "left")
        unknown = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("long")
        out = out.withColumn(new, F.coalesce(F.col(new), unknown))
    return out.select("sub", "rel", "obj", "ts")


def with_inverses(facts: DataFrame, inverse: Column) -> DataFrame:
    """facts and, swapped and with the inverse relation, their inverses; a qid of an inverse comes after all forward ones."""
    if "qid" in facts.columns:
        n = facts.agg((F.max("qid") + 1).alias("n_forward"))
        swapped = facts.crossJoin(n).select((F.col("qid") + F.col("n_forward")).alias("qid"), F.col("obj").alias("sub"), inverse.alias("rel"), F.col("sub").alias("obj"), "ts")
        return facts.select("qid", "sub", "rel", "obj", "ts").unionByName(swapped)
    swapped = facts.select(F.col("obj").alias("sub"), inverse.alias("rel"), F.col("sub").alias("obj"), "ts")
    return facts.select("sub", "rel", "obj", "ts").unionByName(swapped)


def background(facts: DataFrame, choice: str) -> DataFrame:
    return facts.where(F.col("split").isin(*BACKGROUNDS[choice]))


def split_by_time(facts: DataFrame, valid_from: int, test_from: int) -> DataFrame:
    split = F.when(F.col("ts") < valid_from, "train").when(F.col("ts") < test_from, "valid").otherwise("test")
    return facts.withColumn("split", split)


def between_times(facts: DataFrame, low: int, high: int) -> DataFrame:
    """The closed interval of a test mask."""
    return facts.where(F.col("ts").between(low, high))


def timestamp_vocabulary(dates: DataFrame, column: str) -> DataFrame:
    """(date, ts): the rank of each distinct value, from 0, where no vocabulary file exists. One row per distinct value."""
    from pyspark.sql import Window

    distinct = dates.select(F.col(column).alias("date")).distinct()
    return distinct.select("date", (F.dense_rank().over(Window.orderBy("date")) - 1).cast("long").alias("ts"))


def quads_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, code of the return flag, 10,000,000 + part, days since 1992-01-01), distinct."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return joined.select(F.col("o_custkey").alias("sub"), F.ascii("l_returnflag").cast("long").alias("rel"), (F.col("l_partkey") + 10_000_000).alias("obj"), days.alias("ts")).distinct()


def quads_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, event type, k of the properties, hours since 2024-01-01), distinct."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "props", "ts")
    hours = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    return events.select(F.col("user_id").alias("sub"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("obj"), hours.alias("ts")).distinct()


def static_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("head string, relation string, tail string").option("sep", "\t").option("quote", "").csv(path)


def thinned(triples: DataFrame, sparsity: float, seed: int = 0) -> DataFrame:
    """int(n * sparsity) rows in a seeded order: the sampling operator, so a limit is its meaning."""
    n = int(triples.count() * sparsity)
    return triples.orderBy(F.xxhash64(F.lit(seed), *triples.columns), *triples.columns).limit(n)
