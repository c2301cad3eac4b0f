import random
import zlib

import numpy as np
import pytest

from tempograph.llm import bpe, packing


def least_cost(at, cost, window, inside, each):
    """The same objective by plain quadratic search."""
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            gap = int(at[j] - at[i])
            if gap <= window:
                best[j] = min(best[j], best[i] + each + packing.padding(gap, window) + cost[j])
            elif gap <= 2 * window:
                best[j] = min(best[j], best[i] + inside + 2 * each + packing.padding(gap - window, window) + cost[j])
    return best[-1]


def cost_of(ends, at, cost, window, inside, each):
    by = dict(zip(at.tolist(), cost.tolist()))
    return sum(each + packing.padding(e - s, window) + by.get(e, inside) for s, e in zip([0, *ends], ends))


@pytest.mark.parametrize("seed", range(40))
def test_cuts_cost_least(seed):
    r = random.Random(seed)
    window = r.choice([8, 16, 32])
    n = r.randint(1, 300)
    docs = np.array(sorted({*r.sample(range(1, n + 1), min(n, r.randint(1, 20))), n}))
    inner = np.array(sorted(r.sample(range(1, n + 1), min(n, r.randint(0, 40)))), int)
    at, cost = packing.boundaries(docs, inner, window, 1.0, 3.0)
    ends = packing.cuts(at, cost, window, 3.0, 1.5)
    assert ends[-1] == n and all(0 < b - a <= window for a, b in zip([0, *ends], ends))
    assert cost_of(ends, at, cost, window, 3.0, 1.5) == pytest.approx(least_cost(at, cost, window, 3.0, 1.5))


def test_chunked_ids_equal_the_library():
    b = bpe.ChunkedBPE(bpe.default_path())
    texts = ["", " ", "a b", "  a  b ", "x\n\ny  z", "tab\tand nbsp end", "it's 12,5 km. Über\r\nÉté  <|endoftext|> b<|endoftext|>", "ŝ 🙂 🙂  日本 語", " lead", "trail ", "a  b 　c", "'' 's don't", "Été, naïve. x; µ ª º ×÷ ÿ! Straße? a, a. a", "\x1c \x1c a \x85 b"]
    r = random.Random(1)
    texts += ["".join(r.choice("ab .,'\n\t  é1 s") for _ in range(r.randint(0, 60))) for _ in range(400)]
    want = [np.array(e.ids, "<u4").tobytes() for e in b.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert b.encode(texts) == want
    assert b.encode(texts) == want


def check(rows, texts, window=1024):
    b = bpe.ChunkedBPE(bpe.default_path())
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids = b.encode([t or ""])[0] + bytes(4)
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) // 4
            assert zlib.crc32(ids[4 * at : 4 * (at + p.length)]) == p.ids_crc32
            at += p.length
        assert at == len(ids) // 4
    pad = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        pad += packing.padding(at, window)
    return pad


def test_pack(spark):
    r = random.Random(3)
    texts = {i: " ".join(r.choice(["word", "of", "the.", "x\n", "été!"]) for _ in range(r.choice([0, 3, 50, 4000]))) for i in range(60)} | {60: None, 61: "", 62: "a" * 30000}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, start string, offset int")
    rows = packing.pack(df.coalesce(3)).collect()
    total = sum(p.length for p in rows)
    assert check(rows, texts) < 0.02 * total + 3 * 1024
    assert packing.pack(df.limit(0)).collect() == []


def test_small_segments(spark):
    texts = {i: "some words. " * (i % 7) for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(df, segment_tokens=100, window=64).collect(), texts, 64)


def test_every_sentence_end_is_a_boundary(monkeypatch):
    seen = []
    real = packing.boundaries
    monkeypatch.setattr(packing, "boundaries", lambda docs, inner, *rest: seen.append(inner.tolist()) or real(docs, inner, *rest))
    flags = np.array([False, False, True])  # id 2 ends a sentence
    ids = np.tile([1, 1, 2], 40).astype("<u4")
    packing.pack_segment([7], [ids.tobytes()], flags, 64, 2.0, 8.0, 32.0, sequence=0)
    assert seen == [list(range(3, 121, 3))]


def test_no_search_for_cycles_while_encoding():
    import gc

    from tempograph.llm.bpe import ChunkedBPE, default_path

    bpe, seen = ChunkedBPE(default_path()), []
    texts = [" ".join(f"w{i * 50 + j}x Größe{j}, {i}?" for j in range(50)) for i in range(300)]

    def count(phase, info):
        seen.append(phase)

    gc.callbacks.append(count)
    try:
        found = bpe.encode(texts)
        during = len(seen)
    finally:
        gc.callbacks.remove(count)
    assert during == 0 and gc.isenabled()
    assert found[::50] == [b"".join(x.to_bytes(4, "little") for x in bpe.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts[::50]]
