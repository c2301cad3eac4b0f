"""Quality scores by histogram gradient-boosted trees over document statistics.

One scan of the texts gives each document's statistics (lengths, kinds of characters, repeated words and lines, ...).
The trees are fitted on the driver from at most `most_rows` labelled rows, taken in the order of a hash of doc_id (the bound
is a parameter); statistics are cut into at most `bins` quantile bins, and splits are found in histograms of gradients and
Hessians of the log loss. The fitted trees are flattened into arrays and all documents are scored by vectorised traversal.

Cases: a null or empty text has zero statistics and gets a score; null labels are left out and repeated ones count as their
mean; without labels of both kinds the score is the smoothed share of label 1; an empty table gives no rows; every row gives
one row, repeated rows too; a very long text is one row of statistics, in linear time; rows of equal hash are taken by doc_id;
other columns are left out. The score of a text depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, small_batches, stored, without

STOP_WORDS = frozenset(w.encode() for w in "the of and to in a is that for it on with as was at by der die das und ist von zu mit ein eine le la les de des et en un une que el los las y por con del se".split())
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "newline", "beyond_ascii", "period", "comma", "exclamation",
    "question", "pipe", "angle", "brace", "hash", "slash", "other_marks", "distinct_words", "stop_words", "doubled_words", "repeated_lines",
    "repeated_line_bytes", "line_length", "longest_word", "short_lines", "byte_entropy", "distinct_letters", "ends_in_mark", "word_length_spread",
)
GROUPS = np.full(256, -1)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", range(128, 256), b".", b",", b"!", b"?", b"|", b"<>", b"{}[]", b"#", b"/\\")):
    GROUPS[list(_chars)] = _i
N_GROUPS = 16  # the last: other marks
GROUPS[GROUPS < 0] = N_GROUPS - 1


def statistics(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = (np.bincount(GROUPS, weights=counts, minlength=N_GROUPS) / n).tolist()
    words = text.lower().split()
    n_words = len(words)
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, n_words) if words else np.zeros(1)
    lines = text.split(b"\n")
    seen = set(lines)
    p = counts[counts > 0] / n
    twice = sum(map(eq, words, words[1:])) / max(1, n_words)
    return [
        np.log1p(n), np.log1p(n_words), float(lengths.mean()), *share,
        len(distinct) / max(1, n_words) ** 0.9, sum(map(STOP_WORDS.__contains__, words)) / max(1, n_words), twice, 1 - len(seen) / len(lines),
        1 - sum(map(len, seen)) / n if len(seen) < len(lines) else 0.0, np.log1p(n / len(lines)), np.log1p(float(lengths.max())), sum(len(x) < 20 for x in lines) / len(lines),
        float(-(p * np.log2(p)).sum()), float((counts[97:123] > 0).sum()), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), float(lengths.std()),
    ]


@dataclass
class Trees:
    """All trees in arrays; a leaf points to itself on both sides."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for at in range(0, len(x) if len(self.roots) else 0, 2000):
            part = x[at : at + 2000]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out[at : at + 2000] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Gradient boosting of the log loss with histogram splits, level by level."""
    positive = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(positive / (1 - positive)))
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, prior)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)  # x <= edges[b] iff bin <= b
    n_features = x.shape[1]
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    raw = np.full(len(y), prior)

    def new_node() -> int:
        i = len(feature)
        feature.append(0), cut.append(np.inf), left.append(i), right.append(i), value.append(0.0)
        return i

    flat = binned + np.arange(n_features) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(new_node())
        open_nodes = {roots[-1]: np.arange(len(y))}
        for level in range(depth + 1):
            following = {}
            for node, rows in open_nodes.items():
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                best, found = 1e-6, None
                if level < depth and len(rows) >= 2 * least:
                    where = flat[rows].ravel()
                    hist_g, hist_h, hist_n = (np.bincount(where, np.repeat(w, n_features), n_features * bins).reshape(n_features, bins) for w in (g[rows], h[rows], np.ones(len(rows))))
                    gl, hl, nl = (a.cumsum(axis=1)[:, :-1] for a in (hist_g, hist_h, hist_n))
                    gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    i = int(gain.argmax())
                    if gain.flat[i] > best:
                        found = divmod(i, bins - 1)
                if found is None:
                    value[node] = rate * sum_g / (sum_h + ridge)
                    raw[rows] += value[node]
                    continue
                f, b = found
                feature[node], cut[node] = f, edges[f][b]
                below = binned[rows, f] <= b
                left[node], right[node] = new_node(), new_node()
                following[left[node]], following[right[node]] = rows[below], rows[~below]
            open_nodes = following
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), depth, prior)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Held-out labels are never learned from."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "x"])

    measured = stored(ids_and_text(docs, id_col, text_col).mapInArrow(measure, "doc_id long, x binary"), "statistics")
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = stored(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    share = 2 * most_rows / max(1, known.count())
    if share < 1:  # the rows below come from this share of the hashes; the top-k then gets few more rows than it keeps
        low = known.where(F.col("h") < int(-(1 << 63) + share * (1 << 64)))
        found = measured.join(low, "doc_id")
        if found.limit(most_rows).count() < most_rows:  # labels of other documents
            found = measured.join(known, "doc_id")
    else:
        found = measured.join(known, "doc_id")
    sample = found.orderBy("h", "doc_id").limit(most_rows).select("x", "quality").toPandas()
    x = np.frombuffer(b"".join(map(bytes, sample["x"])), np.float64).reshape(-1, len(STATISTICS))
    trees = fit(x, sample["quality"].to_numpy(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(x))], names=["doc_id", "score"])

    out = measured.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    return without(docs, scored(docs, labels, **options).where("predicted = 0"), "rejected")
