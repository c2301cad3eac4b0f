import random
import sys

import numpy as np

from tempograph.llm import bpe


def library(b, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in b.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_new_chunks_of_known_pieces_cost_no_call_each():
    """Chunks were plain-tested, looked up and remembered one by one; now their pieces are looked up all at once."""
    b = bpe.ChunkedBPE(bpe.default_path())
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    b.encode(["x " + " ".join(words) + " " + " ".join(f"a.{w}" for w in words)])
    text = "x " + " ".join(f"{v}.{w}" for v in words for w in words)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = b.encode([text])
    finally:
        sys.setprofile(None)
    assert calls < 1500  # for 3,600 new chunks
    assert found == library(b, [text])


def test_ids_of_odd_chunks_equal_the_library():
    """The contractions, new lines, special tokens, foreign letters and long pieces, while the table forgets and when it doesn't."""
    r = random.Random(2)
    parts = ["a", "Ab", "été", "ÿ", "7", "12", ".", ",", "'", "''", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'S", "'r", "'l", "'x", "\n", "\n\n", " ", " ", " ", "  ", "\t", "×", "÷", "µ", "ß", "\0", "\x7f", "<", "<|", "<|endoftext|>", "endoftext|>", "日本", "🙂", "’s", " ", " ", "\r\n", "-" * 31, "x" * 30, "é" * 16, "y" * 31, "z" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["", " ", "\n", "don't we'll they're 's it's't rock''s o'clock I'm you'd've x'", "a '", "a '\n", "a b'r"]
    for most in (20, 1_000_000):
        b = bpe.ChunkedBPE(bpe.default_path(), most)
        want = library(b, texts)
        assert [x for at in range(0, len(texts), 300) for x in b.encode(texts[at : at + 300])] == want
        assert b.encode(texts[::-1]) == want[::-1]


def test_piece_table_finds_what_was_added():
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"ab\0") for _ in range(r.choice([1, 7, 8, 9, 16, 24, 30, 31]))) for _ in range(9000)})
    data = np.frombuffer(b"".join(words) + b" " * 8 * bpe.LANES, np.uint8)
    sizes = np.array([len(w) for w in words])
    keys = bpe.keys_of(data, np.cumsum(sizes) - sizes, sizes)
    assert len(np.unique(keys, axis=0)) == len(words)
    table = bpe.PieceTable(len(words) // 2)
    table.slot = lambda keys: (keys[:, 0] & np.uint64(7)).astype(np.int64)  # few slots for all: found by their bytes alone
    some = np.arange(0, len(words), 9)
    n = 1 + some % 3
    assert (table.add(keys[some], np.repeat(some, n).astype(np.uint32), n) == np.arange(len(some))).all()
    entry = table.find(keys)
    assert (np.flatnonzero(entry >= 0) == some).all() and (table.of(entry[some]) == np.repeat(some, n)).all()
    del table.slot
    table = bpe.PieceTable(len(words) // 2)
    table.add(keys, np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64))
    table.find(keys[some])
    table.forget()  # all that wasn't met again
    entry = table.find(keys)
    assert (np.flatnonzero(entry >= 0) == some).all() and (table.of(entry[some]) == some).all()
