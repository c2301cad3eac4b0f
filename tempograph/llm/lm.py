"""Language-model scores by a hierarchical Pitman-Yor model with Chinese-restaurant seating.

Restaurants: one for what follows each word, rare ones too, and one for the start of a document. All share the word restaurant
as their parent; its base gives a word as its letters, from restaurants for the letter after 3, 2, 1 and 0 letters,
each the parent of the longer contexts that end alike. In a sweep of the Gibbs sampler the customers of every dish are taken
out and seated anew given all other tables; dishes with many customers are seated in runs of a sixteenth of those already
seated. Discounts come from the numbers of dishes served once and twice; strengths are sampled after each sweep, on a grid,
from their likelihood given all restaurants' customers and tables. Predictive probabilities are averaged over the samples after
the first sweep.

Distributed form: a block (some documents of one partition) numbers its words and keeps its tokens as these numbers. Owners of
words (by a hash) count them and give them ids, small ones to frequent words. A block then sends each owner of contexts (by the
context's id) its cells (context, word, count); a context with more tokens than an owner should have is dealt out by words as
well. A cell with one customer has one table, so a sweep seats the other cells alone: owners of contexts send tables by word to the
owners of words, which seat the word restaurant and send back the probabilities of the words asked for. The driver gets sums, and
totals of the contexts dealt out by words (fewer than owners). Last, the owners answer each block's words and cells. What is sent
grows with the distinct cells of the blocks; the number of owners follows the tokens. The letters' cells are at most 65,536 x 257
by design.

Cases: a null or empty text is one end token; every row is scored, repeated ones too; a null doc_id is learned from; a very long
text is a block of its own; ties don't matter; an empty table gives no rows; without training rows only letters' base
probabilities remain; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import delete, ids_and_text, small_batches, stored, written

OTHER, START = 0, 1  # the contexts without a frequent word before, and at a document's start
LETTERS = 257  # bytes and the end of a word
LETTER_STRENGTH, LETTER_DISCOUNT = 5.0, 0.5
STRENGTHS = np.geomspace(0.1, 1e6, 141)  # the grid of strengths
NULL_ID = -(1 << 63)


def seat(customers: np.ndarray, new_weight: np.ndarray, discount: float, rng: np.random.Generator, each: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of each dish after its customers have sat down one by one. new_weight is that of a new table while the dish has
    none, and each what every table of the dish adds to it."""
    tables = (customers > 0).astype(np.int64)
    seated = tables.copy()
    active = np.flatnonzero(customers > 1)
    each = np.broadcast_to(each, customers.shape)
    while len(active):
        k = seated[active]
        step = np.minimum(customers[active] - k, np.maximum(1, k // 16))
        weight = new_weight[active] + each[active] * tables[active]
        chance = weight / (np.maximum(k - discount * tables[active], 1e-9) + weight)
        tables[active] += rng.binomial(step, chance)
        seated[active] += step
        active = active[seated[active] < customers[active]]
    return tables


def discount_of(once: int, twice: int) -> float:
    return float(np.clip((once + 1) / (once + 2 * twice + 3), 0.05, 0.95))


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def strength_logs(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The log likelihood of each strength of the grid, given each restaurant's customers and tables."""
    used = customers > 0
    (c, many_c), (t, many_t) = (np.unique(x[used].astype(float), return_counts=True) for x in (customers, tables))
    logs = []
    for strength in STRENGTHS.tolist():
        ratio = strength / discount
        opened = _log_gamma(ratio + t).astype(float) - math.lgamma(ratio + 1) + (t - 1) * math.log(discount)
        joined = _log_gamma(strength + c).astype(float) - math.lgamma(strength + 1)
        logs.append(float((opened * many_t).sum() - (joined * many_c).sum()))
    return np.array(logs)


def drawn_strength(logs: np.ndarray, rng: np.random.Generator) -> float:
    chance = np.exp(logs - max(logs))
    return float(rng.choice(STRENGTHS, p=chance / chance.sum()))


def sampled_strength(customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> float:
    """A strength from the grid, by its likelihood given each restaurant's customers and tables."""
    return drawn_strength(strength_logs(customers, tables, discount), rng) if (customers > 0).any() else 1.0


def contexts(words: np.ndarray, starts: np.ndarray, near: np.ndarray, far: np.ndarray, ends_sentence: np.ndarray, first_far: int) -> np.ndarray:
    """The context of each token. near, far: by word, its own context or OTHER, and its number among the very frequent or -1.

    The start of a document; a frequent word directly before; else the last very frequent word before in the document, and
    whether a sentence has just ended; else OTHER.
    """
    n, at = len(words), np.arange(len(words))
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(far[words] >= 0, at, -1))[:-1]])
    ended = np.concatenate([[False], ends_sentence[words[:-1]]])[:n]
    distant = np.where(last >= begin, first_far + 2 * far[words[np.maximum(last, 0)]] + ended, OTHER)
    direct = np.concatenate([[OTHER], near[words[:-1]]])[:n]
    out = np.where(direct != OTHER, direct, distant)
    out[starts] = START
    return out


# letters


def letter_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context after up to 3 letters, and the letter, at every place of every word, and where each word begins."""
    text = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    end = text == 32
    letter = np.where(end, LETTERS - 1, text)

    def back(k: int) -> np.ndarray:
        return np.concatenate([np.full(min(k, len(text)), 32), text[:-k]])[: len(text)]

    one = np.where(back(1) == 32, 0, back(1))
    two = np.where((one == 0) | (back(2) == 32), 0, back(2))
    three = np.where((two == 0) | (back(3) == 32), 0, back(3))
    starts = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1])
    return ((one * 32 + (two & 31)) * 8 + (three & 7)), letter, starts


class Letters:
    """A sample of the letters' restaurants: for each level the seated cells, their tables, and the restaurants' totals."""

    PARENT = (8, 32, 256, 1)  # how many contexts share a parent, from the longest level down

    def __init__(self, cells: np.ndarray, counts: np.ndarray, rng: np.random.Generator, sweeps: int):
        self.levels: list[tuple] = []
        for _ in range(sweeps):
            previous, levels = self.levels, []
            key, customers = cells, counts
            for depth, share in enumerate(self.PARENT):
                context, letter = key // LETTERS, key % LETTERS
                parent_key = context // share * LETTERS + letter
                if previous and depth + 1 < len(self.PARENT):
                    base = self.probability(parent_key, depth + 1, previous)
                else:
                    base = np.full(len(key), 1 / LETTERS)
                size = int(context.max(initial=0)) + 1
                opened = (previous[depth][4] if previous else np.bincount(context, minlength=size))[context]
                tables = seat(customers, (LETTER_STRENGTH + LETTER_DISCOUNT * opened) * base, LETTER_DISCOUNT, rng)
                levels.append((key, customers, tables, np.bincount(context, customers, size), np.bincount(context, tables, size)))
                up, where = np.unique(parent_key, return_inverse=True)
                key, customers = up, np.bincount(where, tables, len(up)).astype(np.int64)
            self.levels = levels

    def probability(self, keys: np.ndarray, depth: int = 0, levels: list | None = None) -> np.ndarray:
        levels = levels or self.levels
        if depth == len(self.PARENT):
            return np.full(len(keys), 1 / LETTERS)
        context, letter = keys // LETTERS, keys % LETTERS
        up = self.probability(context // self.PARENT[depth] * LETTERS + letter, depth + 1, levels)
        key, customers, tables, all_customers, all_tables = levels[depth]
        if not len(key):
            return up
        at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
        seen = key[at] == keys
        inside = context < len(all_customers)
        total = np.where(inside, all_customers[np.where(inside, context, 0)], 0)
        opened = np.where(inside, all_tables[np.where(inside, context, 0)], 0)
        own = np.where(seen, customers[at] - LETTER_DISCOUNT * tables[at], 0.0)
        return (own + (LETTER_STRENGTH + LETTER_DISCOUNT * opened) * up) / (LETTER_STRENGTH + total)

    def word_log(self, words: list[bytes]) -> np.ndarray:
        """The natural log of each word's base probability."""
        out = []
        for at in range(0, len(words), 50_000):
            context, letter, starts = letter_cells(words[at : at + 50_000])
            keys, where = np.unique(context * LETTERS + letter, return_inverse=True)
            out.append(np.add.reduceat(np.log(self.probability(keys))[where], starts))
        return np.concatenate(out) if out else np.zeros(0)


# words


def seated_cells(counts: np.ndarray, chance: np.ndarray, opened: np.ndarray, own: np.ndarray, total: dict, rng: np.random.Generator) -> np.ndarray:
    """Tables of each cell. chance: of its word; opened: all tables of its context, of which own are the cell's."""
    d = total["context_discount"]
    return seat(counts, (total["context_strength"] + d * np.maximum(opened - own, 0)) * chance, d, rng, d * chance)


def seated_words(customers: np.ndarray, prior: np.ndarray, total: dict, rng: np.random.Generator) -> np.ndarray:
    d = total["word_discount"]
    return seat(customers, (total["word_strength"] + d * total["word_tables"]) * prior, d, rng, d * prior)


def sampled(word: np.ndarray, context: np.ndarray, counts: np.ndarray, base: list[np.ndarray], totals: list[dict], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After each sweep, given the totals before it: tables of each cell, customers and tables of each word. All in one process."""
    n, chance, tables = len(base[0]), None, np.zeros(len(word))
    for sweep, total in enumerate(totals):
        rng = np.random.default_rng([seed, sweep])
        prior = base[min(sweep, len(base) - 1)]
        if chance is None:
            chance = np.bincount(word, counts, n) / max(1, total["tokens"])
        tables = seated_cells(counts, chance[word], np.asarray(total["context_tables"])[context], tables, total, rng)
        customers = np.bincount(word, tables, n).astype(np.int64)
        opened = seated_words(customers, prior, total, rng)
        yield tables, customers, opened
        chance = word_chance(prior, customers, opened, total | {"word_customers": max(1, total["word_customers"])})


def word_chance(prior: np.ndarray, customers, opened, total: dict) -> np.ndarray:
    weight = total["word_strength"] + total["word_discount"] * total["word_tables"]
    return (np.maximum(customers - total["word_discount"] * opened, 0) + weight * prior) / (total["word_strength"] + total["word_customers"])


def cell_chance(parent: np.ndarray, customers, tables, context: np.ndarray, total: dict) -> np.ndarray:
    d, strength = total["context_discount"], total["context_strength"]
    opened, seated = np.asarray(total["context_tables"])[context], np.asarray(total["context_tokens"])[context]
    return (np.maximum(customers - d * tables, 0) + (strength + d * opened) * parent) / (strength + seated)


BLOCK = "block long, size long, words binary, trained binary, doc_ids binary, lengths binary, held binary, tokens binary"
WORDS = "block long, owner int, words binary, numbers binary, trained binary"
TYPES = "owner int, n long, words binary, counts binary, sums array<double>"
IDS = "block long, owner int, numbers binary, ids binary, counts binary"
MESSAGE = "block long, owner int, contexts binary, cells binary, words binary, trained binary"
PART = "kind int, owner int, peer int, a binary, b binary, c binary, d binary, e binary, f binary, sums array<double>"
REPLY = "block long, kind int, owner int, a binary, b binary, c binary, d binary"
CELLS, ASKED, SWEPT = 0, 1, 2  # kinds of parts: what stays with an owner, what goes to another one, and what the first sweep leaves


def split_words(blob: bytes) -> list[bytes]:
    return blob.split(b" ")


def squeezed(values: np.ndarray, kind: str) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes(), 1)


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def part(kind: int, owner: int, peer: int = -1, *blobs: bytes, sums: list | None = None) -> tuple:
    return (kind, owner, peer, *blobs, *[None] * (6 - len(blobs)), sums)


def bound(f, *more):
    """f as a function of a group of each side alone, with its further arguments given."""
    return lambda left, right: f(left, right, *more)


def summed(tables: DataFrame) -> np.ndarray:
    """The sums of the arrays in the column sums, place by place."""
    rows = tables.where("sums is not null").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r["n"] for r in rows])


def ints(data: bytes) -> np.ndarray:
    return unsqueezed(data, "<u4").astype(np.int64)


def joined(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of an owner's messages: each one's contexts and its cells' keys; then all cells learned from, in order, and their counts."""
    asked_contexts, asked, counts = [], [], []
    for context, cells, word, trained in zip(*(group.column(c).to_pylist() for c in ("contexts", "cells", "words", "trained"))):
        asked_contexts.append(np.cumsum(ints(context)))
        asked.append(np.repeat(asked_contexts[-1], ints(cells)) << 32 | ints(word))
        counts.append(ints(trained))
    key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, counts))
    key, n = key[n > 0], n[n > 0]
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return asked_contexts, asked, key[first], np.add.reduceat(n, first) if len(n) else n


def by_owner(words: np.ndarray, owners: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of distinct ids: each owner of some, their places, and their numbers with that owner."""
    order = np.lexsort((words // owners, words % owners))
    cuts = np.flatnonzero(np.diff(words[order] % owners)) + 1
    return [(int(words[at[0]] % owners), at, words[at] // owners) for at in np.split(order, cuts) if len(at)]


class BlockCells:
    """The distinct cells of a block, in the order in which they are sent to their owners."""

    def __init__(self, every: np.ndarray, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray, documents: int, owners: int, owner_tokens: int):
        size = len(ids)
        self.by_id = np.argsort(ids)
        rank = np.empty(size, np.int64)
        rank[self.by_id] = np.arange(size)
        context = contexts(every, starts, rank + 2, np.full(size, -1), np.zeros(size, bool), size + 2) - START  # every word is a context
        self.token_keys = context * size + rank[every]
        self.size, self.ids, self.counts = size, np.append(-1, ids[self.by_id]), np.append(documents, counts[self.by_id])
        self.owners, self.owner_tokens = owners, owner_tokens

    def deal(self, distinct: np.ndarray) -> None:
        context, self.word = distinct // self.size, distinct % self.size
        self.context_id, self.word_id, self.seated = self.ids[context] + 1, self.ids[self.word + 1], self.counts[context]
        pieces = np.maximum(1, -(-self.seated // self.owner_tokens))
        owner = (self.context_id + self.word_id % pieces) % self.owners
        self.order = np.argsort(owner, kind="stable")
        owner = owner[self.order]
        context = self.context_id[self.order]
        self.heads = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (owner[1:] != owner[:-1])))  # the first cell of each context
        self.cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        self.owner = owner[self.cuts[:-1]]

    def messages(self, block: int, trained: np.ndarray) -> list[tuple]:
        context, word, trained = self.context_id[self.order], self.word_id[self.order], trained[self.order]
        runs, out = np.diff(np.append(self.heads, len(context))), []
        for o, a, b in zip(self.owner.tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            i, j = np.searchsorted(self.heads, [a, b])
            out.append((block, o, *(squeezed(x, "<u4") for x in (np.diff(context[self.heads[i:j]], prepend=0), runs[i:j], word[a:b], trained[a:b]))))
        return out


def scored(docs: DataFrame, *, sweeps: int = 3, samples: int = 2, block_tokens: int = 3_000_000, block_words: int = 400_000, owner_tokens: int = 4_000_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    small_batches(spark)

    def block_row(number: int, vocabulary: dict, ids: list, held: list[bool], parts: list[np.ndarray]) -> tuple:
        lengths = np.array([len(p) for p in parts], np.int64)
        every = np.concatenate(parts)
        trained = np.bincount(every[np.repeat(~np.array(held), lengths)], minlength=len(vocabulary))
        return number, len(every), b" ".join(vocabulary), squeezed(trained, "<u4"), np.array(ids, "<i8").tobytes(), lengths.astype("<u4").tobytes(), np.array(held, "u1").tobytes(), squeezed(every, "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def fresh() -> dict:
            out: dict = defaultdict()
            out.default_factory = out.__len__
            return out

        vocabulary, ids, held, parts, size = fresh(), [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.lower().split()  # bytes: A-Z alone, and split at space and 9 to 13
                words.append(b"")
                parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                ids.append(NULL_ID if doc_id is None else doc_id)
                held.append(doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2)
                size += len(words)
                if size >= block_tokens or len(vocabulary) >= block_words:
                    yield batch_of(BLOCK, [block_row(number, vocabulary, ids, held, parts)])
                    vocabulary, ids, held, parts, size, number = fresh(), [], [], [], 0, number + 1
        if parts:
            yield batch_of(BLOCK, [block_row(number, vocabulary, ids, held, parts)])

    blocks = stored(ids_and_text(docs, id_col, text_col).mapInArrow(read, BLOCK), "lm-blocks")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum("size")).first()[0] or 0) // owner_tokens))

    # words: their counts and ids

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, trained in zip(*(c.to_pylist() for c in batch.columns)):
                words, n = split_words(blob), unsqueezed(trained, "<u4")
                owner = np.fromiter((zlib.crc32(w) % owners for w in words), np.int64, len(words))
                order = np.argsort(owner, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                    yield batch_of(WORDS, [(block, int(owner[mine[0]]), b" ".join([words[i] for i in mine.tolist()]), squeezed(mine, "<u4"), squeezed(n[mine], "<u4"))])

    named, named_path = written(blocks.select("block", "words", "trained").mapInArrow(send_words, WORDS), "lm-words")

    def merge_words(group: pa.Table) -> pa.Table:
        owner, found = group.column("owner")[0].as_py(), defaultdict(int)
        for blob, trained in zip(*(group.column(c).to_pylist() for c in ("words", "trained"))):
            for w, n in zip(split_words(blob), unsqueezed(trained, "<u4").tolist()):
                found[w] += n
        words = sorted(found, key=lambda w: (-found[w], w))
        if len(words) * owners >= 1 << 31:
            raise ValueError("an id of a word and one of its context share 64 bits")
        n = np.array([found[w] for w in words], np.int64)
        sums = [float(n.sum()), float((n > 0).sum()), float(found.get(b"", 0))]
        return pa.Table.from_batches([batch_of(TYPES, [(owner, int((n > 0).sum()), b" ".join(words), squeezed(n, "<u8"), sums)])])

    types = stored(named.groupBy("owner").applyInArrow(merge_words, TYPES), "lm-types")
    sums = summed(types)
    n_tokens, vocabulary, documents = (int(x) for x in (sums if len(sums) else (0, 0, 0)))

    def identify(asked: pa.Table, own: pa.Table) -> pa.Table:
        words = {w: i for i, w in enumerate(split_words(own.column("words")[0].as_py()))}
        counts, owner, out = unsqueezed(own.column("counts")[0].as_py(), "<u8"), own.column("owner")[0].as_py(), []
        for block, blob, numbers in zip(*(asked.column(c).to_pylist() for c in ("block", "words", "numbers"))):
            mine = split_words(blob)
            at = np.fromiter(map(words.__getitem__, mine), np.int64, len(mine))
            out.append((block, owner, numbers, squeezed(at * owners + owner, "<u4"), squeezed(counts[at], "<u8")))
        return pa.Table.from_batches([batch_of(IDS, out)])

    ids = stored(named.select("block", "owner", "words", "numbers").groupBy("owner").cogroup(types.select("owner", "words", "counts").groupBy("owner")).applyInArrow(identify, IDS), "lm-ids")
    delete(spark, named_path)

    # contexts with more than owner_tokens tokens are dealt out by words too; the driver adds their totals up

    def list_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n = unsqueezed(counts, "<u8").astype(np.int64)
                at = np.flatnonzero(n > owner_tokens)
                yield pa.RecordBatch.from_arrays([pa.array(at * owners + owner + 1), pa.array(n[at])], names=["id", "n"])

    hot_rows = [(r["id"], r["n"]) for r in types.select("owner", "counts").mapInArrow(list_hot, "id long, n long").collect()]
    hot_rows = sorted(hot_rows + ([(0, documents)] if documents > owner_tokens else []))  # fewer than n_tokens / owner_tokens, and the start
    hot, hot_tokens = (np.array([r[i] for r in hot_rows], np.int64) for i in (0, 1))

    def block_cells(block: pa.Table, ids: np.ndarray, counts: np.ndarray) -> tuple[BlockCells, np.ndarray, np.ndarray]:
        lengths = np.frombuffer(block.column("lengths")[0].as_py(), "<u4").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        return BlockCells(ints(block.column("tokens")[0].as_py()), starts, ids, counts, documents, owners, owner_tokens), lengths, starts

    def put(replies: pa.Table, column: str, kind: str, numbers: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(sum(map(len, numbers)), np.dtype(kind))
        for at, data in zip(numbers, replies.column(column).to_pylist()):
            out[at] = unsqueezed(data, kind)
        return out.astype(np.int64)

    def send(block: pa.Table, replies: pa.Table) -> pa.Table:
        numbers = [ints(x) for x in replies.column("numbers").to_pylist()]
        cells, lengths, _ = block_cells(block, put(replies, "ids", "<u4", numbers), put(replies, "counts", "<u8", numbers))
        both = np.sort(cells.token_keys * 2 + np.repeat(np.frombuffer(block.column("held")[0].as_py(), "u1") == 0, lengths))
        ends = np.flatnonzero(np.append(both[1:] >> 1 != both[:-1] >> 1, True))
        trained = np.diff(np.cumsum(both & 1)[ends], prepend=0)
        cells.deal(both[ends] >> 1)
        return pa.Table.from_batches([batch_of(MESSAGE, cells.messages(block.column("block")[0].as_py(), trained))])

    bodies = blocks.select("block", "doc_ids", "lengths", "held", "tokens")
    messages = bodies.select("block", "lengths", "held", "tokens").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(send, MESSAGE)
    messages = stored(messages, "lm-cells")

    def merge(group: pa.Table) -> pa.Table:
        owner, (*_, key, n) = group.column("owner")[0].as_py(), joined(group)
        context, at, cells = np.unique(key >> 32, return_inverse=True, return_counts=True)
        word, single = key & 0xFFFFFFFF, n == 1
        alone = np.bincount(at, single, len(context)).astype(np.int64)
        customers = np.bincount(at, n, len(context)).astype(np.int64)
        sums = [float(single.sum()), float((n == 2).sum()), float(len(n)), *hot_sums(context, cells)]
        rows = [part(CELLS, owner, -1, *(squeezed(x, "<u4") for x in (context, alone, customers, cells - alone, word[~single], n[~single])), sums=sums)]
        for of, (w, many) in ((0, np.unique(word[single], return_counts=True)), (1, (np.unique(word[~single]), None))):
            for peer, places, ranks in by_owner(w, owners):
                rows.append(part(ASKED, peer, owner, *((b"", squeezed(ranks, "<u4")) if of else (squeezed(many[places], "<u4"), squeezed(ranks, "<u4")))))
        return pa.Table.from_batches([batch_of(PART, rows)])

    def hot_sums(context: np.ndarray, numbers: np.ndarray) -> list[float]:
        mine, at, here = np.intersect1d(hot, context, assume_unique=True, return_indices=True)
        out = np.zeros(len(hot))
        out[at] = numbers[here]
        return out.tolist()

    def whole(context: np.ndarray, numbers: np.ndarray, of_hot: np.ndarray) -> np.ndarray:
        """Numbers by context, with those of the contexts dealt out replaced by their totals."""
        mine, at, here = np.intersect1d(hot, context, assume_unique=True, return_indices=True)
        numbers = numbers.copy()
        numbers[here] = of_hot[at]
        return numbers

    parts = stored(messages.select("owner", "contexts", "cells", "words", "trained").groupBy("owner").applyInArrow(merge, PART), "lm-owners")
    kept, asked = parts.where(F.col("kind") == CELLS).drop("sums"), parts.where(F.col("kind") == ASKED).drop("sums")
    sums = summed(parts)
    once, twice, distinct = (int(x) for x in (sums[:3] if len(sums) else (0, 0, 0)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of all owners that the task reads
        for batch in batches:
            for known, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if known:
                    context, letter, _ = letter_cells(split_words(blob)[:known])
                    cells, counts = np.unique(context * LETTERS + letter, return_counts=True)
                    key, where = np.unique(np.concatenate([key, cells]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([n, counts]), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["cell", "n"])

    # each type is one customer of the letters; the cells are bounded by design
    spelled = types.select("n", "words").mapInArrow(spell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    cells, counts = spelled["cell"].to_numpy(np.int64), spelled["n"].to_numpy(np.int64)
    letters = [Letters(cells, counts, np.random.default_rng([seed, 99, s]), 2) for s in range(samples)]

    def prepare(asked: pa.Table, own: pa.Table) -> pa.Table:
        """An owner of words: how many cells of one customer each word has, its priors, and the first probabilities asked for."""
        owner, words, counts = (own.column(c)[0].as_py() for c in ("owner", "words", "counts"))
        words, counts = split_words(words), unsqueezed(counts, "<u8")
        alone, rows = np.zeros(len(words), np.int64), []
        for peer, many, ranks in zip(*(asked.column(c).to_pylist() for c in ("peer", "a", "b"))):
            if many:
                alone[ints(ranks)] += ints(many)
            else:
                rows.append(part(ASKED, peer, owner, squeezed(counts[ints(ranks)] / max(1, n_tokens), "<f4")))
        logs = np.concatenate([x.word_log(words) for x in letters])
        return pa.Table.from_batches([batch_of(PART, [part(CELLS, owner, -1, squeezed(alone, "<u4"), squeezed(logs, "<f4")), *rows])])

    prepared = stored(asked.groupBy("owner").cogroup(types.select("owner", "words", "counts").groupBy("owner")).applyInArrow(prepare, PART), "lm-priors")
    ready, chances = prepared.where(F.col("kind") == CELLS).drop("sums"), prepared.where(F.col("kind") == ASKED)

    def laid(rows: list[dict]) -> tuple[dict, dict[int, dict]]:
        return next((r for r in rows if r["kind"] == CELLS), {}), {r["kind"] - SWEPT: r for r in rows if r["kind"] >= SWEPT}

    def sweep_cells(own: pa.Table, replies: pa.Table, number: int, total: dict) -> pa.Table:
        row, before = laid(own.to_pylist())
        context, alone, customers, many, word, n = (ints(row[c]) for c in "abcdef")
        at = np.repeat(np.arange(len(context)), many)
        tables = ints(before[number - 1]["a"]) if number else np.zeros(len(n), np.int64)
        opened = whole(context, alone + (np.bincount(at, tables, len(context)).astype(np.int64) if number else many), total["hot_tables"])
        words, where = np.unique(word, return_inverse=True)
        chance, found = np.zeros(len(words)), {r["peer"]: r["a"] for r in replies.to_pylist()}
        dealt = by_owner(words, owners)
        for peer, places, _ in dealt:
            chance[places] = unsqueezed(found[peer], "<f4")
        tables = seated_cells(n, chance[where], opened[at], tables, total, np.random.default_rng([seed, 1, row["owner"], number]))
        opened = alone + np.bincount(at, tables, len(context)).astype(np.int64)
        own_contexts = ~np.isin(context, hot)
        logs = (np.round(strength_logs(customers[own_contexts], opened[own_contexts], total["context_discount"]) * 1024) / 1024).tolist()  # sums are exact in any order
        rows = [part(SWEPT + number, row["owner"], -1, squeezed(tables, "<u4"), sums=[*logs, *hot_sums(context, opened)])]
        by_word = np.bincount(where, tables, len(words)).astype(np.int64)
        rows += [part(ASKED, peer, row["owner"], squeezed(by_word[places], "<u4"), squeezed(ranks, "<u4")) for peer, places, ranks in dealt]
        return pa.Table.from_batches([batch_of(PART, rows)])

    def sweep_words(asked: pa.Table, own: pa.Table, number: int, total: dict) -> pa.Table:
        row, _ = laid(own.to_pylist())
        customers, logs = ints(row["a"]), unsqueezed(row["b"], "<f4").reshape(samples, -1)
        prior = np.exp(logs[min(number, samples - 1)].astype(float))
        asked = [(peer, ints(tables), ints(ranks)) for peer, tables, ranks in sorted(zip(*(asked.column(c).to_pylist() for c in ("peer", "a", "b"))))]
        for _, tables, ranks in asked:
            customers[ranks] += tables
        opened = seated_words(customers, prior, total, np.random.default_rng([seed, 2, row["owner"], number]))
        chance = word_chance(prior, customers, opened, total | {"word_customers": max(1, total["word_customers"])})
        sums = [float(x.sum()) for x in (customers, opened, customers == 1, customers == 2)]
        rows = [part(SWEPT + number, row["owner"], -1, squeezed(customers, "<u4"), squeezed(opened, "<u4"), sums=sums)]
        if number + 1 < sweeps:
            rows += [part(ASKED, peer, row["owner"], squeezed(chance[ranks], "<f4")) for peer, _, ranks in asked]
        return pa.Table.from_batches([batch_of(PART, rows)])

    total = {"word_customers": distinct, "word_tables": vocabulary, "context_discount": discount_of(once, twice), "word_discount": 0.6}
    total |= {"context_strength": 10.0, "word_strength": 100.0, "hot_tables": sums[3:]}
    totals, rng, cell_states, word_states = [], np.random.default_rng([seed, 7]), [], []
    for number in range(sweeps):
        left = kept.select("kind", "owner", *"abcdef")
        if number:
            left = left.unionByName(cell_states[-1])
        swept = stored(left.groupBy("owner").cogroup(chances.select("owner", "peer", "a").groupBy("owner")).applyInArrow(bound(sweep_cells, number, total), PART), f"lm-cells-{number}")
        cell_states.append(swept.where(F.col("kind") >= SWEPT).select("kind", "owner", *"abcdef"))
        sums = summed(swept)
        told = swept.where(F.col("kind") == ASKED).select("owner", "peer", "a", "b").groupBy("owner")
        worded = stored(told.cogroup(ready.select("kind", "owner", "a", "b").groupBy("owner")).applyInArrow(bound(sweep_words, number, total), PART), f"lm-words-{number}")
        word_states.append(worded.where(F.col("kind") >= SWEPT).select("kind", "owner", *"abcdef"))
        chances = worded.where(F.col("kind") == ASKED)
        got = summed(worded)
        customers, tables_, once, twice = (int(x) for x in (got if len(got) else (0, 0, 0, 0)))
        total = total | {"word_customers": customers, "word_tables": tables_, "word_discount": discount_of(once, twice), "hot_tables": sums[len(STRENGTHS) :]}
        if n_tokens:
            logs = sums[: len(STRENGTHS)] + strength_logs(hot_tokens, total["hot_tables"], total["context_discount"])
            total["context_strength"] = drawn_strength(logs, rng)
        total["word_strength"] = sampled_strength(np.array([customers]), np.array([tables_]), total["word_discount"], rng)
        totals.append(total)

    averaged = range(sweeps - samples, sweeps)

    def answer_words(asked: pa.Table, own: pa.Table) -> pa.Table:
        row, states = laid(own.to_pylist())
        logs, out = unsqueezed(row["b"], "<f4").reshape(samples, -1).astype(float), []
        chance = np.stack([np.log(np.maximum(word_chance(np.exp(logs[min(s, samples - 1)]), ints(states[s]["a"]), ints(states[s]["b"]), totals[s]), 1e-300)) for s in averaged])
        for block, numbers, ids, counts in zip(*(asked.column(c).to_pylist() for c in ("block", "numbers", "ids", "counts"))):
            out.append((block, 0, row["owner"], numbers, ids, counts, squeezed(chance[:, ints(ids) // owners].ravel(), "<f4")))
        return pa.Table.from_batches([batch_of(REPLY, out)])

    def answer_cells(asked: pa.Table, own: pa.Table) -> pa.Table:
        row, states = laid(own.to_pylist())
        asked_contexts, keys, key, n = joined(asked)
        context, alone, _, many = (ints(row[c]) for c in "abcd")
        at = np.repeat(np.arange(len(context)), many)
        tables, opened = [], []
        for s in averaged:
            found = ints(states[s]["a"])
            tables.append(np.append((n == 1).astype(np.int64), 0))
            tables[-1][:-1][n > 1] = found
            opened.append(np.append(whole(context, alone + np.bincount(at, found, len(context)).astype(np.int64), totals[s]["hot_tables"]), 0))
        n, out = np.append(n, 0), []
        for block, mine, cells in zip(asked.column("block").to_pylist(), asked_contexts, keys):
            place = place_in(key, cells)
            above = place_in(context, mine)
            here = np.concatenate([x[above] for x in opened])
            out.append((block, 1, row["owner"], squeezed(n[place], "<u4"), squeezed(np.concatenate([x[place] for x in tables]), "<u4"), squeezed(here, "<u4"), None))
        return pa.Table.from_batches([batch_of(REPLY, out)])

    def of_samples(states: list[DataFrame], first: DataFrame) -> DataFrame:
        for s in averaged:
            first = first.unionByName(states[s])
        return first.groupBy("owner")

    replies = ids.groupBy("owner").cogroup(of_samples(word_states, ready.select("kind", "owner", *"abcdef"))).applyInArrow(answer_words, REPLY)
    replies = replies.unionByName(messages.groupBy("owner").cogroup(of_samples(cell_states, kept.select("kind", "owner", *"abcdef"))).applyInArrow(answer_cells, REPLY))
    smoothing = math.log10(n_tokens + vocabulary + 1)
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(block: pa.Table, replies: pa.Table) -> pa.Table:
        of_words = replies.filter(pa.compute.equal(replies.column("kind"), 0))
        of_cells = sorted((r["owner"], r["a"], r["b"], r["c"]) for r in replies.filter(pa.compute.equal(replies.column("kind"), 1)).select(["owner", "a", "b", "c"]).to_pylist())
        numbers = [ints(x) for x in of_words.column("a").to_pylist()]
        count = put(of_words, "c", "<u8", numbers)
        cells, lengths, starts = block_cells(block, put(of_words, "b", "<u4", numbers), count)
        parent = np.zeros((samples, len(count)), "<f4")
        for at, data in zip(numbers, of_words.column("d").to_pylist()):
            parent[:, at] = unsqueezed(data, "<f4").reshape(samples, -1)
        distinct, where = np.unique(cells.token_keys, return_inverse=True)
        cells.deal(distinct)
        found = np.concatenate([ints(n) for _, n, _, _ in of_cells])
        seats = np.concatenate([ints(t).reshape(samples, -1) for _, _, t, _ in of_cells], axis=1)
        opened = np.concatenate([ints(t).reshape(samples, -1) for _, _, _, t in of_cells], axis=1)
        opened = np.repeat(opened, np.diff(np.append(cells.heads, len(distinct))), axis=1)
        word, seated = cells.by_id[cells.word[cells.order]], cells.seated[cells.order]
        chance, every = np.zeros(len(distinct)), slice(None)
        for i, s in enumerate(averaged):
            own = totals[s] | {"context_tables": opened[i], "context_tokens": seated}
            chance += cell_chance(np.exp(parent[i].astype(float))[word], found, seats[i], every, own) / samples
        logs = np.empty(len(distinct))
        logs[cells.order] = np.log10(np.maximum(chance, 1e-300))
        score, known = logs[where], count[ints(block.column("tokens")[0].as_py())]
        ids = np.frombuffer(block.column("doc_ids")[0].as_py(), "<i8")
        n = len(ids)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NULL_ID),
            "held_out": pa.array(np.frombuffer(block.column("held")[0].as_py(), "u1").astype(bool)),
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(n, n_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(known + 1.0) - smoothing, starts)),
            "score": pa.array(np.add.reduceat(score, starts)),
        })

    return bodies.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, result)


def place_in(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked key among the sorted keys; len(keys) for what isn't there."""
    place = np.searchsorted(keys, asked)
    return np.where(np.append(keys, -1)[place] == asked, place, len(keys))


def perplexity(scores: DataFrame) -> DataFrame:
    """By held_out: documents, tokens, and 10 to the mean negative log10 probability of a token, of the model and the base."""
    mean = [F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(n) for c, n in (("score", "perplexity"), ("base_score", "base_perplexity"))]
    return scores.groupBy("held_out").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), *mean)
