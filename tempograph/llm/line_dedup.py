"""Line dedup by hashes alone, in DataFrame operations only.

Each line's key (stripped at both ends, A-Z lower-cased) becomes a 128-bit hash. The rows (hash, doc_id, position) go into
the shared folder, are dealt out by ranges of the hash, and sorted there by document and position; the first document of a
hash is taken as the rows stream by. What comes back to a document is a bitmap of the lines to drop, 64 lines to a word and
only the words that aren't zero. No text is shuffled but that of the final join.

A hash that many documents share would fill one range, so hot hashes are salted: those that hold a large share of a bounded
sample of the hashes are spread by document over `salts` ranges, each range gives its first document, and the smallest of
these (salts x hot hashes, both bounded, broadcast) is the first. Which hashes are salted changes no result.

Cases: a null or empty text is one empty line; equal doc_ids count as one document and get the bits of both; a null doc_id
counts as one document that comes before all others; repeated rows are one document, so its lines are dropped only for another
document's; a very long text is one row of lines, a bitmap holds 64 of them to a word; ties don't occur, as the smallest doc_id
decides; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, stored

SPACES = " \t\n\x0b\f\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: DataFrame) -> DataFrame:
    """doc_id, pos and key of every line; text has doc_id and text."""
    low = F.when(F.length("text") == F.octet_length("text"), F.lower("text")).otherwise(F.translate("text", CAPITALS, SMALL))
    lines = text.select("doc_id", F.posexplode(F.split(low, "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.btrim("line", F.lit(SPACES)).alias("key"))


def key_hash(column: str) -> list[Column]:
    """h and h2, 64 bits each. A hash of several columns goes on from the last one's, so the number that tells the two apart
    must stand first: h2 is then the column's hash from another seed, and not a function of h."""
    return [F.xxhash64(column).alias("h"), F.xxhash64(F.lit(1), F.col(column)).alias("h2")]


def dropped_lines(docs: DataFrame, *, min_chars: int = 10, salts: int = 64, sample_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and words: array<struct<word, bits>>, one row for each document that loses lines."""
    spark = docs.sparkSession
    keys = line_keys(ids_and_text(docs, id_col, text_col)).where(F.length("key") >= min_chars)
    hashes = stored(keys.select(*key_hash("key"), "doc_id", "pos"), "line-hashes")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hashes.count()
    sample = hashes.sample(min(1.0, sample_rows / max(1, rows)), seed=7).groupBy("h").count()
    hot = sample.where(F.col("count") > F.lit(max(20, min(rows, sample_rows) // (8 * ranges)))).select("h")  # at most 8 x ranges
    salted = hashes.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "h", "left")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0))
    dealt = salted.withColumn("salt", salt).repartitionByRange("h", "salt").sortWithinPartitions("h", "salt", "h2", "doc_id", "pos")
    stream = Window.partitionBy("h", "salt", "h2").orderBy("doc_id", "pos")
    seen = dealt.withColumn("first", F.first("doc_id").over(stream)).withColumn("leads", F.row_number().over(stream) == 1)
    seen = stored(seen.where("is_hot or not (doc_id <=> first)"), "line-repeats")

    least = F.struct(F.col("first").isNotNull().alias("set"), F.col("first").alias("id"))  # a null doc_id comes first
    firsts = seen.where("is_hot and leads").groupBy("h", "h2").agg(F.min(least)["id"].alias("least"))
    of_hot = seen.where("is_hot").join(F.broadcast(firsts), ["h", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("least")))
    drops = seen.where("is_hot is null").select("doc_id", "pos").unionByName(of_hot.select("doc_id", "pos"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = drops.groupBy("doc_id", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, text without the lines to drop (null if none stays), n_lines, n_dropped."""
    text = ids_and_text(docs, id_col, text_col)
    bitmaps = stored(dropped_lines(text, **options), "line-bitmaps").withColumnRenamed("doc_id", "of")
    joined = text.join(bitmaps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    dense = "transform(sequence(0, words[size(words) - 1].word), w -> coalesce(element_at(map_from_entries(words), w), 0L))"
    split = joined.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.when(F.col("words").isNotNull(), F.expr(dense)).alias("bits"))
    stay = "case when bits is null then lines else filter(lines, (x, i) -> i div 64 >= size(bits) or getbit(bits[cast(i div 64 as int)], cast(i % 64 as int)) = 0) end"
    kept = split.select("doc_id", "lines", F.expr(stay).alias("kept"))
    n_lines, n_kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    return kept.select("doc_id", F.array_join("kept", "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def digests(docs: DataFrame, **options) -> DataFrame:
    return deduplicated(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with lines as (
  select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), firsts as (
  select k, min(doc_id) as f from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
  select keyed.doc_id, pos, line, f is not null and keyed.doc_id <> f as gone from keyed left join firsts using (k)
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
