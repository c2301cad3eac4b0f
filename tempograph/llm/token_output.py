"""Token-id output compressed by Re-Pair grammars.

Documents are put into ascending doc_id order by a range partition, encoded, and cut into blocks of whole documents.
In each block frequent pairs of neighbouring symbols become nonterminals, round after round, until no pair occurs `least`
times. A block's bytes, all little-endian:

    magic "RPG1", then unsigned 32-bit: documents, first nonterminal, rules, symbols; unsigned 64-bit: tokens
    documents x int64 doc_id, documents x uint8 is-set, documents x uint32 tokens
    rules x uint32 left, rules x uint32 right, rules x uint32 expansion length
    symbols x 3 bytes, the sequence; uint32 crc32 of all that stands before

Symbol first + i expands to rule i's left, then its right. With the expansion lengths, the symbol that holds token n is
found by a search in their running sum, so one document is decoded without the rest of its block. Blocks are rows of a
Parquet table in the shared folder, so any store that Spark reaches can hold them.

Cases: null texts count as empty and give the end id alone; a null doc_id comes first; equal doc_ids keep all their
rows; an empty table gives no blocks; a text longer than a block makes a block of its own; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm.bpe import default_path, shared_bpe
from tempograph.llm.common import ids_and_text, small_batches, stored

HEAD = struct.Struct("<4sIIIIQ")
BLOCK_SCHEMA = "shard int, block int, n_docs int, n_tokens long, n_symbols long, payload binary"
READ_SCHEMA = "shard int, block int, doc_id long, start_in_block long, n_tokens long, ids_crc32 long"
NEVER = np.int32((1 << 31) - 1)
PASSES = 3  # over the overlaps of a round's pairs; what is still open waits for the next round


def alternate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs don't overlap an equal pair before them: in a run of one symbol, every second."""
    valid = np.ones(len(a), bool)
    same = np.flatnonzero(a == b)
    if len(same):
        at = np.arange(len(same))
        begins = np.maximum.accumulate(np.where(np.diff(same, prepend=-2) != 1, at, 0))
        valid[same[(at - begins) % 2 == 1]] = False
    return valid


def ranked_pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the pairs at the places at: the places of those that occur `least` times, the rank of each (0: the most frequent),
    and the number of ranks. Pairs are counted exactly, by one sort of pair and place together."""
    place_bits, symbol_bits = int(len(a)).bit_length(), int(max(a.max(), b.max())).bit_length()
    left, right = a[at].astype(np.uint64), b[at].astype(np.uint64)
    if 2 * symbol_bits + place_bits <= 64:
        both = np.sort((left << np.uint64(symbol_bits + place_bits)) | (right << np.uint64(place_bits)) | at.astype(np.uint64))
        pair, place = both >> np.uint64(place_bits), (both & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    else:
        pair = (left << np.uint64(symbol_bits)) | right
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], at[order]
    begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(begins, append=len(pair))
    frequent = np.flatnonzero(count >= least)
    rank = np.empty(len(frequent), np.int32)
    rank[np.argsort(-count[frequent], kind="stable")] = np.arange(len(frequent), dtype=np.int32)
    sizes = count[frequent]
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place[np.repeat(begins[frequent], sizes) + inside], np.repeat(rank, sizes), len(frequent)


def grammar(ids: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that remain, and the rules' left and right sides: Re-Pair until no pair occurs `least` times.

    A round counts pairs and replaces many: where frequent pairs overlap, the more frequent one is replaced. Pairs of old
    symbols only get rarer, so after the first round only pairs with a new symbol, or frequent ones that lost a place to
    another, are counted again.
    """
    seq, lefts, rights, free = ids.astype(np.uint32), [], [], first
    open_ = np.ones(max(0, len(seq) - 1), bool)  # pairs to count, by their left place
    while len(seq) > 1 and free < 1 << 24:
        a, b = seq[:-1], seq[1:]
        at = np.flatnonzero(open_ & alternate(a, b))
        if len(at) < least:
            break
        place, rank, n = ranked_pairs(a, b, at, least)
        n = min(n, (1 << 24) - free)
        if not n:
            break
        ranks = np.full(len(seq) + 1, NEVER, np.int32)  # ranks[i + 1]: of the pair at i
        ranks[place + 1] = np.where(rank < n, rank, NEVER)
        chosen, few = [], 8 * len(place) < len(seq)
        for _ in range(PASSES):
            if few:  # the same test at the ranked places alone
                own = ranks[place + 1]
                won = place[(own < ranks[place]) & (own < ranks[place + 2])]
            else:
                own = ranks[1:-1]
                won = np.flatnonzero((own < ranks[:-2]) & (own < ranks[2:]))
            if not len(won):
                break
            chosen.append((won, ranks[won + 1]))
            ranks[won], ranks[won + 1], ranks[won + 2] = NEVER, NEVER, NEVER
        where, rule = (np.concatenate(x) for x in zip(*chosen))
        used = np.bincount(rule, minlength=n) >= least
        where, rule = where[used[rule]], rule[used[rule]]
        number = np.cumsum(used) - 1
        sides = np.zeros(int(used.sum()), np.int64)
        sides[number[rule]] = where
        lefts.append(seq[sides])
        rights.append(seq[sides + 1])
        seq = seq.copy()
        seq[where] = free + number[rule].astype(np.uint32)
        keep, open_ = np.ones(len(seq), bool), np.zeros(len(seq) + 1, bool)
        keep[where + 1] = False
        open_[place + 1] = True  # what lost a place
        open_[where + 1] = open_[where] = open_[where + 2] = True
        # the pair after a new symbol begins at that symbol; the one before it, at the last kept symbol before it
        seq, fresh = seq[keep], np.zeros(len(seq), bool)
        fresh[where] = True
        fresh, open_ = fresh[keep], open_[1:][keep]
        open_ = open_[:-1] | fresh[:-1] | fresh[1:]
        free += len(sides)
    empty = np.zeros(0, np.uint32)
    return seq, np.concatenate([empty, *lefts]), np.concatenate([empty, *rights])


def expansion_lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(left), np.uint32)
    a, b = left.astype(np.int64) - first, right.astype(np.int64) - first
    lengths = out.tolist()
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        lengths[i] = (lengths[x] if x >= 0 else 1) + (lengths[y] if y >= 0 else 1)
    return np.array(lengths, np.uint32)


def encode_block(doc_ids: list, ids: list[bytes], *, vocabulary: int, least: int = 8) -> tuple[bytes, int, int]:
    """The block's bytes, its tokens and its symbols."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    first = max(vocabulary, int(tokens.max(initial=0)) + 1)
    if first >= 1 << 24:
        raise ValueError("ids must be below 2^24")
    seq, left, right = grammar(tokens, first, least)
    body = b"".join([
        HEAD.pack(b"RPG1", len(doc_ids), first, len(left), len(seq), len(tokens)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "u1").tobytes(),
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
        left.astype("<u4").tobytes(),
        right.astype("<u4").tobytes(),
        expansion_lengths(left, right, first).astype("<u4").tobytes(),
        np.ascontiguousarray(seq.astype("<u4").view("u1").reshape(-1, 4)[:, :3]).tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body)), len(tokens), len(seq)


class Block:
    """A block opened for reading; tokens(a, b) decodes a part of it."""

    def __init__(self, payload: bytes):
        body, (crc,) = memoryview(payload)[:-4], struct.unpack("<I", payload[-4:])
        magic, docs, self.first, rules, symbols, self.n_tokens = HEAD.unpack_from(body)
        if magic != b"RPG1" or crc != zlib.crc32(body):
            raise ValueError("not a whole RPG1 block")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        ids, is_set = take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [x if ok else None for x, ok in zip(ids.tolist(), is_set.tolist())]
        self.doc_ends = np.cumsum(take(docs, "<u4").astype(np.int64))
        left, right, lengths = take(rules, "<u4"), take(rules, "<u4"), take(rules, "<u4").astype(np.int64)
        wide = np.zeros((symbols, 4), "u1")
        wide[:, :3] = take(3 * symbols, "u1").reshape(-1, 3)
        self.seq = wide.view("<u4").ravel()
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.flat = np.zeros(int(self.offsets[-1]), "<u4")
        flat, offsets, first = self.flat, self.offsets.tolist(), self.first
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
            p = offsets[i]
            for s in (x, y):
                if s < first:
                    flat[p] = s
                    p += 1
                else:
                    q, r = offsets[s - first], offsets[s - first + 1]
                    flat[p : p + r - q] = flat[q:r]
                    p += r - q
        size = np.ones(symbols, np.int64)
        inner = self.seq >= first
        size[inner] = lengths[self.seq[inner].astype(np.int64) - first]
        self.ends = np.cumsum(size)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop, from the symbols that hold them alone."""
        if stop <= start:
            return np.zeros(0, "<u4")
        i, j = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop - 1, "right")) + 1
        seq, ends = self.seq[i:j], self.ends[i:j]
        base = int(self.ends[i - 1]) if i else 0
        sizes = np.diff(ends, prepend=base)
        inner = seq >= self.first
        if inner.any():
            source = np.where(inner, self.offsets[np.where(inner, seq.astype(np.int64) - self.first, 0)], 0)
            begin = ends - sizes - base
            out = self.flat[np.minimum(np.repeat(source - begin, sizes) + np.arange(int(ends[-1]) - base), len(self.flat) - 1)]
            out[begin[~inner]] = seq[~inner]
        else:
            out = seq.copy()
        return out[start - base : stop - base]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.doc_ends[i - 1]) if i else 0, int(self.doc_ends[i]))


def write_blocks(docs: DataFrame, tokenizer_path: str | None = None, *, end_id: int = 2, block_tokens: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the blocks into the shared folder and returns that table. Shards and blocks ascend with doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = shared_bpe(path)
        vocabulary = bpe.tokenizer.get_vocab_size(with_added_tokens=True)
        end, shard, block = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, size
            payload, tokens, symbols = encode_block(names, held, vocabulary=vocabulary)
            row = [shard, block, len(names), tokens, symbols, payload]
            names.clear(), held.clear()
            block, size = block + 1, 0
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist())):
                names.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= block_tokens:
                    yield flush()
        if names:
            yield flush()

    ordered = ids_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(run, BLOCK_SCHEMA), "token-blocks")


def read_digests(blocks: DataFrame) -> DataFrame:
    """Per document, from the blocks: the ids before it in all, its ids, and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                block = Block(payload)
                view = memoryview(block.tokens(0, block.n_tokens).tobytes())
                ends = block.doc_ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends)], pa.int64()), pa.array(crc, pa.int64())], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    sizes = blocks.select("shard", "block", F.col("n_tokens").alias("in_block"))
    by_shard = sizes.groupBy("shard").agg(F.sum("in_block").alias("in_shard"))  # one row per shard
    before = F.sum("in_shard").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    by_shard = by_shard.select("shard", F.coalesce(before, F.lit(0)).alias("before_shard"))
    inner = F.sum("in_block").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before_block", F.coalesce(inner, F.lit(0))).join(by_shard, "shard").select("shard", "block", (F.col("before_shard") + F.col("before_block")).alias("before"))
    read = blocks.select("shard", "block", "payload").mapInArrow(run, READ_SCHEMA)
    return read.join(offsets, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")
