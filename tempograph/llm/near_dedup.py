"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact verification on full shingle sets.

1. Each text's set of word shingles (64-bit hashes) gets `bands` x `rows` minima; the low byte of each minimum is kept as its
   signature. Texts with equal sets become one representative (partial aggregation, so a huge group of copies is one row).
2. Representatives that share a band meet in a bucket; buckets with the same members are looked at once. A bucket of more
   than `block` members is split into blocks and each pair of blocks is a task of its own.
3. In a block, signatures are compared batch by batch. With m of n bytes equal, the match probability p has the posterior
   Beta(m + 1, n - m + 1); a pair goes as soon as P(p >= that of the threshold) falls below `miss`. What survives is only
   reported as a spanning forest, never as pairs, so a block gives fewer rows than it has members.
4. The survivors' components are tight clusters. Their full sets are gathered by cluster (again in pairs of blocks where a
   cluster is large), and links are verified exactly: rows of intersection sizes by posting lists, for as long as members
   with different components remain. Every pair that can change the result is evaluated.
5. Components of the verified links, by alternating large and small stars; nothing is collected on the driver.

A pair of exactly 0.8 shares none of the 30 bands of 5 with probability 7e-6, and is pruned wrongly with about `miss`.
Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer words than a
shingle has its word sequence as its one shingle; equal doc_ids are one node; a null doc_id is linked with nothing and kept;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, small_batches, stored, without

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[4]
    x ^= x >> np.uint64(33)
    x *= MIX[5]
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()  # bytes: A-Z alone, and split at space and 9 to 13
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total + h[k : n - width + 1 + k])
    return np.unique(total)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * a + b).min(axis=0), out=out)
    return out


def least_matches(threshold: float, miss: float, batches: list[int]) -> list[int]:
    """After n compared bytes, the fewest matches with P(p >= p0 | matches) >= miss, for each n of batches."""
    p0 = threshold + (1 - threshold) / 256
    out = []
    for n in batches:
        tail, m = 0.0, -1  # P(Beta(m + 1, n - m + 1) >= p0) = P(Binomial(n + 1, p0) <= m)
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)
        out.append(m)
    return out


class Forest:
    """Union-find; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)

    def labels(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def survivors(signatures: np.ndarray, block: np.ndarray, first: int, second: int, batch: int, least: list[int]) -> Forest:
    """The components of the pairs between the two blocks (or within the one) that no batch prunes."""
    n = len(signatures)
    forest, labels = Forest(n), np.arange(n)
    lefts = np.flatnonzero(block == first)
    for i in lefts.tolist():
        others = np.flatnonzero(labels != labels[i])
        others = others[(others > i) if first == second else (block[others] == second)]
        matches = np.zeros(len(others), np.int64)
        for k, needed in enumerate(least):
            if not len(others):
                break
            part = slice(k * batch, (k + 1) * batch)
            matches += (signatures[others, part] == signatures[i, part]).sum(axis=1)
            stay = matches >= needed
            others, matches = others[stay], matches[stay]
        if len(others):
            joined = np.unique(np.append(labels[others], labels[i]))
            for x in joined[1:].tolist():
                forest.join(int(joined[0]), x)
            labels[np.isin(labels, joined)] = joined[0]
    return forest


def exact_links(sets: list[np.ndarray], block: np.ndarray, first: int, second: int, percent: int) -> Forest:
    """The components of the pairs with 100 * intersection >= percent * union, verified on the sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    forest, labels = Forest(n), np.arange(n)
    spread = np.bincount(ids)[ids]
    central = np.argsort(-np.add.reduceat(spread, at[:-1]) / sizes, kind="stable")  # near what the others share, first
    done = np.zeros(n, bool)
    hub = int(central[0])
    for turn, i in enumerate(central.tolist()):
        if turn and labels[i] == labels[hub]:  # pairs inside the hub's component change nothing; the others' rows see the rest
            continue
        done[i] = True
        others = (labels != labels[i]) & ~done
        if first != second:
            others &= block == (second if block[i] == first else first)
        if not others.any():
            continue
        mine = ids[at[i] : at[i + 1]]
        hits = np.concatenate([posting[starts[s] : starts[s + 1]] for s in mine.tolist()])
        both = np.bincount(hits, minlength=n)
        linked = np.flatnonzero(others & (100 * both >= percent * (sizes + sizes[i] - both)))
        if len(linked):
            joined = np.unique(np.append(labels[linked], labels[i]))
            for x in joined[1:].tolist():
                forest.join(int(joined[0]), x)
            labels[np.isin(labels, joined)] = joined[0]
    return forest


def forest_edges(ids: np.ndarray, forest: Forest) -> pa.Table:
    labels = forest.labels()
    away = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.table({"u": pa.array(ids[away], pa.int64()), "v": pa.array(ids[labels[away]], pa.int64())})


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (its smallest node) for every node of edges (u, v), by alternating large and small stars."""
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    ordered, before = stored(ordered, f"{name}-edges"), None
    while True:
        both = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ordered = stored(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-stars")
        now = ordered.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = ordered.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def in_blocks(rows: DataFrame, group: str, node: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that it belongs to: columns first and second."""
    mine = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return rows.withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other")).drop("other", blocks)


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, batch: int = 30, miss: float = 1e-6, block: int = 2048, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    spark = docs.sparkSession
    small_batches(spark)
    hashes = bands * rows
    least = least_matches(percent / 100, miss, list(range(batch, hashes + 1, batch)))
    texts = ids_and_text(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(hashes)
        powers = mixed(np.arange(1, rows + 1, dtype=np.uint64))
        numbers = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1000))
        for part in batches:
            counts, keys, signatures, groups = [], [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                if not len(found):
                    keys.append(None), signatures.append(None), groups.append(None)
                    continue
                low = minima(found, a, b)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append(low.astype(np.uint8).tobytes())
                groups.append(mixed((low.reshape(bands, rows).astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64) ^ numbers).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(groups, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])

    signed = stored(texts.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    reps = stored(reps, "representatives")

    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("rep").cast("decimal(38,0)")
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(mark).alias("marks"), F.min("rep").alias("low")).where("members > 1")
    buckets = buckets.groupBy("members", "marks", "low").agg(F.min("bucket").alias("bucket"))
    buckets = buckets.select("bucket", F.ceil(F.col("members") / block).alias("blocks"))
    met = banded.join(buckets, "bucket").join(reps.select("rep", "signature"), "rep")

    def prune(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        return forest_edges(ids[order], survivors(signatures, group.column("mine").to_numpy()[order], first, second, batch, least))

    dealt = in_blocks(met, "bucket", "rep", "blocks")
    candidate_edges = dealt.groupBy("bucket", "first", "second").applyInArrow(prune, "u long, v long")
    clusters = stored(components(candidate_edges, "candidates"), "clusters")

    weights = clusters.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    sizes = weights.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") * 8 / block_bytes)).alias("blocks"))
    wanted = stored(clusters.join(sizes, "component"), "clusters-sized")
    involved = texts.join(wanted.hint("merge"), texts["doc_id"] == wanted["node"]).select("component", F.col("doc_id").alias("rep"), "blocks", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets = [shingles(t, size).tobytes() for t in part.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["component", "rep", "blocks", "found"])

    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        found = group.column("found").to_pylist()
        sets = [np.frombuffer(found[i], np.uint64) for i in order.tolist()]
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        return forest_edges(ids[order], exact_links(sets, group.column("mine").to_numpy()[order], first, second, percent))

    gathered = involved.mapInArrow(gather, "component long, rep long, blocks long, found binary")
    links = in_blocks(gathered, "component", "rep", "blocks").groupBy("component", "first", "second").applyInArrow(verify, "u long, v long")
    linked = components(links, "links")

    named = reps.select("set_key", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their columns."""
    return without(docs, near_duplicates(docs, **options).where("not kept"), "near-dropped")
