import random
import zlib

import numpy as np
import pytest

from tempograph.llm import bpe
from tempograph.llm import token_output as t


@pytest.mark.parametrize("seed", range(8))
def test_block_round_trip(seed):
    r = np.random.default_rng(seed)
    docs = [r.integers(0, r.choice([2, 30, 70_000]), r.choice([1, 5, 2000])).astype("<u4") for _ in range(20)]
    docs.append(np.zeros(3000, "<u4"))
    payload, tokens, symbols = t.encode_block(list(range(20)) + [None], [d.tobytes() for d in docs], vocabulary=100, least=3)
    block = t.Block(payload)
    assert tokens == sum(map(len, docs)) and symbols < tokens and block.doc_ids == [*range(20), None]
    every = np.concatenate(docs)
    assert (block.tokens(0, tokens) == every).all()
    for i, d in enumerate(docs):
        assert (block.document(i) == d).all()
    for _ in range(30):
        a, b = sorted(r.integers(0, tokens + 1, 2).tolist())
        assert (block.tokens(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        t.Block(payload[:-5] + b"x" + payload[-4:])


def test_rounds_end_when_no_pair_is_frequent():
    """Late rounds look at the ranked places alone; they end with the same rule: no pair occurs often."""
    r = np.random.default_rng(3)
    phrase = r.integers(0, 5000, (300, 12))
    ids = np.concatenate([phrase[r.integers(0, 300, 900)].ravel(), r.integers(5000, 60_000, 9000)]).astype("<u4")
    seq, left, right = t.grammar(ids, 60_000, 8)
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    pairs, count = np.unique((a << 24 | b)[t.alternate(a, b)], return_counts=True)
    assert len(left) and count.max() < 8
    payload, tokens, _ = t.encode_block([1], [ids.tobytes()], vocabulary=60_000)
    assert (t.Block(payload).tokens(0, tokens) == ids).all()


def test_written_and_read(spark):
    r = random.Random(5)
    texts = {i: " ".join(r.choice(["the", "of", "été", "zebra.", "x\n"]) for _ in range(r.choice([0, 1, 200, 3000]))) for i in r.sample(range(1000), 80)} | {2000: None, 2001: ""}
    df = spark.createDataFrame([(i, x, 0) for i, x in texts.items()], "doc_id long, text string, shard int").repartition(5)
    rows = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in t.read_digests(t.write_blocks(df, block_tokens=4000)).collect()}
    b, at, want = bpe.ChunkedBPE(bpe.default_path()), 0, {}
    for i in sorted(texts):
        ids = b.encode([texts[i] or ""])[0] + np.array([2], "<u4").tobytes()
        want[i] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert rows == want
    assert t.read_digests(t.write_blocks(df.limit(0))).collect() == []
