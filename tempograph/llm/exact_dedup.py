"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. A sender (a run of rows of one input partition) hashes its normalised texts, sorts the distinct 64-bit fingerprints,
   and sends to each owner of a fingerprint range the sorted list as Golomb-Rice coded differences: a few bytes a
   document instead of its text. Its own ledger (doc_id and sha256 by fingerprint) stays in the shared folder.
2. An owner merges the lists of its range and returns to each sender a bitmap: which of its fingerprints others have too.
   A sender sends a fingerprint once, however many rows have it, so the hottest text gives one entry per sender.
3. Fingerprints that others have, or that a sender has twice, make suspects. Only their texts move on: they are grouped by
   their bytes (partial aggregation first, so one row per distinct text and task is shuffled).

Texts are equal when identical after lower-casing A-Z. Of equal texts the largest doc_id stays.
Cases: a null text counts as empty; equal doc_ids with equal texts all count and are all marked alike; a null doc_id never
wins against another; a very long text is one row, hashed whole; ties are rows of one text, of which the largest doc_id stays; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, small_batches, stored, without

SENT = "sender long, owner int, doc_ids binary, hashes binary, n long, rice int, quotients binary, remainders binary"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rice_encode(values: np.ndarray, base: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 values from base on: the parameter, the unary quotients, the fixed-width remainders."""
    gaps = np.diff(values, prepend=np.uint64(base))
    mean = max(1, int(values[-1] - np.uint64(base)) // len(values))
    k = max(0, int(mean * 0.69).bit_length() - 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, bool)
    unary[ones] = True
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(bool) if k else np.zeros((len(gaps), 0), bool)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def rice_decode(n: int, k: int, quotients: bytes, remainders: bytes, base: int) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps = (gaps << np.uint64(k)) + (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def owner_base(owner: int, owners: int) -> int:
    return -(-(owner << 64) // owners)


def sender_rows(sender: int, doc_ids: list, hashes: list[bytes], owners: int) -> Iterator[tuple]:
    """The ledger (its remainders say which ids are null), then a message for each owner."""
    table = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 32)
    prints = np.ascontiguousarray(table[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(prints, kind="stable")
    ids = np.array([x or 0 for x in doc_ids], "<i8")[order]
    unset = np.packbits(np.array([x is None for x in doc_ids])[order]).tobytes()
    yield sender, None, ids.tobytes(), table[order].tobytes(), len(ids), None, None, unset
    distinct = np.unique(prints)
    bases = np.array([owner_base(o, owners) for o in range(owners)], np.uint64)
    split = np.searchsorted(distinct, bases, "left").tolist() + [len(distinct)]
    for o in range(owners):
        part = distinct[split[o] : split[o + 1]]
        if len(part):
            k, q, r = rice_encode(part, int(bases[o]))
            yield sender, o, None, None, len(part), k, q, r


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def exact_duplicates(docs: DataFrame, *, sender_docs: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    owners = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = ids_and_text(docs, id_col, text_col)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, names, hashes = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            hashes += [hashlib.sha256(t.lower()).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]  # bytes.lower() knows A-Z alone
            if len(names) >= sender_docs:
                yield batch_of(list(sender_rows(sender, names, hashes, owners)), SENT)
                sender, names, hashes = sender + 1, [], []
        if names:
            yield batch_of(list(sender_rows(sender, names, hashes, owners)), SENT)

    sent = stored(texts.mapInArrow(send, SENT), "fingerprints")

    def own(group: pa.Table) -> pa.Table:
        owner = group.column("owner")[0].as_py()
        columns = [group.column(x).to_pylist() for x in ("n", "rice", "quotients", "remainders")]
        lists = [rice_decode(n, k, q, r, owner_base(owner, owners)) for n, k, q, r in zip(*columns)]
        merged = np.sort(np.concatenate(lists))
        shared = np.unique(merged[1:][merged[1:] == merged[:-1]])
        bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
        return pa.table({"sender": group.column("sender"), "owner": group.column("owner"), "n": group.column("n"), "bitmap": pa.array(bitmaps, pa.binary())})

    messages = sent.where("owner is not null").select("sender", "owner", "n", "rice", "quotients", "remainders")
    bitmaps = messages.groupBy("owner").applyInArrow(own, "sender long, owner int, n long, bitmap binary")

    def mark(ledgers: pa.Table, answers: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(ledgers.column("doc_ids").to_pylist()), "<i8")
        hashes = b"".join(ledgers.column("hashes").to_pylist())
        table = np.frombuffer(hashes, np.uint8).reshape(-1, 32)
        prints = np.ascontiguousarray(table[:, :8]).view(">u8").ravel().astype(np.uint64)
        answers = answers.sort_by("owner")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for n, b in zip(answers.column("n").to_pylist(), answers.column("bitmap").to_pylist())]
        _, where, count = np.unique(prints, return_inverse=True, return_counts=True)
        suspect = (np.concatenate(bits).astype(bool) | (count > 1))[where]
        hexes = hashes.hex()
        unset = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for n, b in zip(ledgers.column("n").to_pylist(), ledgers.column("remainders").to_pylist())]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=np.concatenate(unset).astype(bool)),
            "text_sha256": pa.array([hexes[i : i + 64] for i in range(0, len(hexes), 64)], pa.string()),
            "suspect": pa.array(suspect, pa.bool_()),
        })

    ledgers = sent.where("owner is null").select("sender", "doc_ids", "hashes", "n", "remainders")
    marked = ledgers.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(mark, "doc_id long, text_sha256 string, suspect boolean")
    marked = stored(marked, "suspects")

    suspects = marked.where("suspect").select(F.col("doc_id").alias("suspect_id")).distinct()
    suspected = texts.join(suspects.hint("merge"), F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    low = F.when(F.length("text") == F.octet_length("text"), F.lower("text")).otherwise(F.translate("text", CAPITALS, SMALL))
    by_bytes = suspected.select("doc_id", low.alias("low")).groupBy("low").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = by_bytes.select(F.sha2("low", 256).alias("text_sha256"), "keep_id", "group_size")
    classes = by_hash.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one sha256")).cast("long")).otherwise(F.col("keep_id"))
    classes = classes.select("text_sha256", checked.alias("keep_id"), "group_size")
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    grouped = marked.where("suspect").join(classes, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their columns."""
    return without(docs, exact_duplicates(docs, **options).where("not kept"), "exact-dropped")


ORACLE_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
