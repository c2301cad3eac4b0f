"""Order-preserving packing: windows over the stream of documents, cut by dynamic programming.

Documents keep their input order. A window holds at most `window` ids; one shorter than that is padded to it, unless
its length is a power of two. A cut costs nothing at a document's end, a little at a sentence's end and more elsewhere.
Over the boundaries p_0 < p_1 < ... of a segment the least cost is

    cost[j] = penalty[j] + min over i of cost[i] + each + padding(p_j - p_i)

(`each`: a small cost of every window, against many short ones) and as padding is window - (p_j - p_i), the minimum of
cost[i] + p_i over the window that slides along is kept by a monotone queue, so each boundary is pushed and popped once.
Two windows with one cut inside a sentence between them are tried from the few starts where they can be best; exact powers of
two are looked up. Memory is bounded: a partition is packed in segments.

Cases: a null text counts as empty and still gives its end id; an empty table gives no rows; repeated rows are packed as
often as they occur; a null doc_id stays null; a text longer than a segment is a segment of its own; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempograph.llm.bpe import default_path, shared_bpe, uncollected
from tempograph.llm.common import ids_and_text, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, sentence: float, inside: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may be, from 0 to the last document's end, at most a window apart, and what each costs."""
    penalty = np.full(int(doc_ends[-1]) + 1, -1.0)
    penalty[sentence_ends] = sentence
    penalty[doc_ends] = penalty[0] = 0.0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.flatnonzero(np.diff(at) > window)
    if len(gaps):
        penalty[np.concatenate([np.arange(at[g] + window, at[g + 1], window) for g in gaps])] = inside
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def exact_pairs(at: np.ndarray, window: int, base: int) -> tuple[list[int], list[int]]:
    """Boundaries j and i, by j, whose distance is base and a power of two below the window."""
    number = np.full(int(at[-1]) + 2 * window + 1, -1, np.int32)  # of the boundary at a position, from -2 * window on
    number[at + 2 * window] = np.arange(len(at))
    found = np.stack([number[at + (2 * window - base - (1 << k))] for k in range(window.bit_length() - 1)], axis=1)
    js, which = np.nonzero(found >= 0)
    return [*js.tolist(), -1], found[js, which].tolist()


def cuts(at: np.ndarray, cost: np.ndarray, window: int, inside: float, each: float) -> list[int]:
    """The window ends of least total cost. Equal costs: the earliest start, one window before two.

    No boundary may cost more than a cut inside a sentence. Then two windows with such a cut between them can only be best
    from starts that no boundary in reach of j could be reached from, a stretch shorter than one gap between boundaries.
    """
    one_j, one_i = exact_pairs(at, window, 0)  # an exact power of two
    two_j, two_i = exact_pairs(at, window, window)  # after a full window
    p, q = at.tolist(), cost.tolist()
    n = len(p)
    best, key, back, double = [0.0] * n, [0.0] * n, [0] * n, bytearray(n)
    near, head = [0], 0  # the monotone queue of boundary numbers: their keys rise
    a = b = first = far = 0
    next_one, next_two = one_j[0], two_j[0]
    whole, second = window + each, inside + 2 * each
    both = 2 * whole + inside
    for j in range(1, n):
        x = p[j]
        low = x - window
        while p[near[head]] < low:
            head += 1
        i = near[head]
        value, two = key[i] + whole - x, 0
        while next_one == j:
            if best[one_i[a]] + each < value:
                i = one_i[a]
                value = best[i] + each
            a += 1
            next_one = one_j[a]
        while p[first] < low:  # the first boundary that one window reaches j from
            first += 1
        while p[far] < low - window:
            far += 1
        f, beyond = far, p[first] - window
        while p[f] < beyond:
            if key[f] + both - x < value:
                i, value, two = f, key[f] + both - x, 1
            f += 1
        while next_two == j:
            if best[two_i[b]] + second < value:
                i, two = two_i[b], 1
                value = best[i] + second
            b += 1
            next_two = two_j[b]
        value += q[j]
        best[j], back[j], double[j] = value, i, two
        key[j] = k = value + x
        while len(near) > head and key[near[-1]] > k:
            near.pop()
        near.append(j)
    ends, j = [], n - 1
    while j > 0:
        ends.append(p[j])
        if double[j]:
            ends.append(p[back[j]] + window)
        j = back[j]
    ends.reverse()
    return ends


def with_tail_split(ends: list[int], window: int, inside: float, each: float) -> list[int]:
    """The last window as a chain of powers of two, where that costs less than its padding."""
    start = ends[-2] if len(ends) > 1 else 0
    rest = ends[-1] - start
    if padding(rest, window) <= (inside + each) * (rest.bit_count() - 1):
        return ends
    out = ends[:-1]
    for k in range(rest.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            start += 1 << k
            out.append(start)
    return out


@uncollected
def pack_segment(doc_ids: list, ids: list[bytes], ends_sentence: np.ndarray, window: int, sentence: float, inside: float, each: float, sequence: int) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for whole documents, and the next free sequence number."""
    stream = b"".join(ids)
    tokens = np.frombuffer(stream, "<u4")
    doc_ends = np.cumsum([len(x) // 4 for x in ids])
    inner = np.flatnonzero(ends_sentence[np.minimum(tokens, len(ends_sentence) - 1)]) + 1
    at, cost = boundaries(doc_ends, inner, window, sentence, inside)
    ends = with_tail_split(cuts(at, cost, window, inside, each), window, inside, each)
    view, rows, doc, start = memoryview(stream), [], 0, 0
    firsts, lasts = [0, *doc_ends[:-1].tolist()], doc_ends.tolist()
    for end in ends:
        begin = start
        while start < end:
            stop = min(end, lasts[doc])
            rows.append((doc_ids[doc], start - firsts[doc], stop - start, zlib.crc32(view[4 * start : 4 * stop]), lasts[doc] - firsts[doc], sequence, start - begin))
            if stop == lasts[doc]:
                doc += 1
            start = stop
        sequence += 1
    return rows, sequence


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, window: int = 1024, end_id: int = 0, sentence_penalty: float = 2.0, inside_penalty: float = 8.0, window_cost: float = 32.0, segment_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    Partitions are packed on their own, without a shuffle; sequence_id is unique over all of them (the partition's
    number times 2^40 plus a running number) and offsets run gapless from 0. window must be a power of two.
    Every sentence's and every document's end is a boundary.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    if not 0 <= sentence_penalty <= inside_penalty:
        raise ValueError("a cut inside a sentence must cost as much as one at its end, at least")
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = shared_bpe(path)
        ends_sentence = bpe.sentence_ends()
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, size
            rows, sequence = pack_segment(names, held, ends_sentence, window, sentence_penalty, inside_penalty, window_cost, sequence)
            names.clear(), held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist())):
                names.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment_tokens:
                    yield flush()
        if names:
            yield flush()

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
