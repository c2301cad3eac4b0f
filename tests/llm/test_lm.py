import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tempograph.llm import lm


def test_seating_has_the_expected_tables():
    rng = np.random.default_rng(0)
    c = np.full(20_000, 10)
    t = lm.seat(c, np.full(len(c), 2.0), 0.0, rng)
    assert t.min() >= 1 and t.max() <= 10
    assert t.mean() == pytest.approx(sum(2 / (2 + k) for k in range(10)), rel=0.02)  # the Dirichlet process's expectation
    assert lm.seat(np.array([0, 1]), np.array([1.0, 1.0]), 0.5, rng).tolist() == [0, 1]


def test_letters_sum_to_one():
    words = [b"", b"the", b"then", b"\xc3\xa9t\xc3\xa9", b"a"]
    context, letter, starts = lm.letter_cells(words)
    assert len(starts) == len(words)
    cells, n = np.unique(context * lm.LETTERS + letter, return_counts=True)
    model = lm.Letters(cells, n, np.random.default_rng(0), 3)
    for c in {0, int(context[3]), 12345}:
        assert model.probability(c * lm.LETTERS + np.arange(lm.LETTERS)).sum() == pytest.approx(1)
    logs = model.word_log(words)
    one = lm.letter_cells([b"then"])
    assert logs[2] == pytest.approx(np.log(model.probability(one[0] * lm.LETTERS + one[1])).sum())


def test_contexts():
    words = np.array([1, 0, 2, 3, 0, 0, 1, 2])
    # word 1 has context 2 and is very frequent, word 3 has context 3 and ends a sentence, word 2 ends one too
    got = lm.contexts(words, np.array([0, 4]), np.array([0, 2, 0, 3]), np.array([-1, 0, -1, -1]), np.array([False, False, True, True]), 4)
    assert got.tolist() == [1, 2, 4, 5, 1, 0, 0, 2]


def test_integers_round_trip():
    for kind in ("<u2", "<u4", "<u8"):
        values = np.array([0, 1, 65_535, 7, 300])
        assert lm.unsqueezed(lm.squeezed(values, kind), kind).tolist() == values.tolist()
        assert len(lm.unsqueezed(lm.squeezed(values[:0], kind), kind)) == 0


def test_strengths_follow_the_restaurants():
    rng = np.random.default_rng(0)
    few, many = (lm.sampled_strength(np.full(200, 100), np.full(200, t), 0.5, rng) for t in (8, 60))
    assert few < many and lm.sampled_strength(np.zeros(3), np.zeros(3), 0.5, rng) == 1.0


def test_probabilities_of_a_context_sum_to_one():
    """Over all words of the letters' support, here a closed vocabulary that the prior sums to one on."""
    prior = np.array([0.4, 0.3, 0.2, 0.1])
    word, context, counts = np.array([0, 0, 1, 3]), np.array([0, 1, 1, 0]), np.array([5, 2, 9, 1])
    total = {"tokens": 17, "context_tokens": [6, 11], "context_tables": [2, 2], "word_customers": 4, "word_tables": 3, "context_discount": 0.5, "word_discount": 0.6, "context_strength": 10.0, "word_strength": 100.0}
    *_, (tables, customers, opened) = lm.sampled(word, context, counts, [prior], [total, total], 3)
    total = total | {"context_tables": np.bincount(context, tables, 2), "word_customers": customers.sum(), "word_tables": opened.sum()}
    parent = lm.word_chance(prior, customers, opened, total)
    assert parent.sum() == pytest.approx(1)
    for u in (0, 1):
        own = [(context == u) & (word == w) for w in range(4)]
        chance = lm.cell_chance(parent, np.array([counts[x].sum() for x in own]), np.array([tables[x].sum() for x in own]), np.full(4, u), total)
        assert chance.sum() == pytest.approx(1)


def rows_of(n):
    r = random.Random(0)
    english, german = "the of and house tree water stone. light".split(), "der die und haus baum wasser stein. licht".split()
    rows = [(i, " ".join(r.choice(r.choice([english, german]) if i % 9 == 0 else (english if i % 2 else german)) for _ in range(60))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Unseen ÉTÉ wordies the\t\x0bof"), (n + 3, "x" * 70_000)]


def test_base_and_score(spark):
    rows = rows_of(200)
    df = spark.createDataFrame([(i, t, 0, "w") for i, t in rows], "doc_id long, text string, block int, words string").repartition(4)
    got = {x.doc_id: x for x in lm.scored(df, block_tokens=1500).collect()}
    tokens = {i: [bytes(w) for w in (t or "").encode().lower().split()] + [b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total = sum(counts.values())
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
        assert -1e9 < x.score < 0
    plain = [i for i in got if held[i] and i < 200]
    assert sum(got[i].score for i in plain) > sum(got[i].base_score for i in plain)
    again = {x.doc_id: x.score for x in lm.scored(df, block_tokens=1500).collect()}
    assert again == {i: x.score for i, x in got.items()}
    assert {x.held_out for x in lm.perplexity(lm.scored(df)).collect()} == {True, False}
    assert lm.scored(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (4, "c " * 9000)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=1000).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in (None, 1, 4)}
    assert sorted((x.doc_id or 0, x.held_out, x.n_tokens) for x in got) == [(0, False, 3), (1, held[1], 3), (1, held[1], 3), (4, held[4], 9001)]
    assert len({x.score for x in got if x.n_tokens == 3}) == 1


def test_word_order_matters(spark):
    rows = [(i, "red apple green pear " * 12) for i in range(60)]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    after = next(i for i in range(held + 1, 300) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows += [(held, "red apple green pear red apple"), (after, "apple red pear green apple red")]
    got = {x.doc_id: x for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held].score > got[after].score + 3 and got[held].base_score == pytest.approx(got[after].base_score)


def test_only_held_out(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.scored(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in got] == [(True, 3, 0, 0)]


def test_rare_words_have_restaurants(spark):
    """Words far below 1/1000 of the tokens, each always followed by a word of its own."""
    pairs = [(f"left{i}", f"right{i * 7 % 1500}") for i in range(1500)]
    texts = [" ".join(w for p in pairs[i % 30 :: 30] for w in p) for i in range(90)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    learned = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(learned[i], t) for i, t in enumerate(texts)]
    rows += [(held[0], " ".join(w for p in pairs[:50] for w in p)), (held[1], " ".join(w for i in range(50) for w in (pairs[i][0], pairs[i + 1][1])))]
    got = {x.doc_id: x for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]].score > got[held[1]].score + 50 and got[held[0]].base_score == pytest.approx(got[held[1]].base_score, abs=1e-6)


def test_contexts_dealt_out_by_words(spark):
    """Contexts with more tokens than an owner should have: their totals, the start's too, are those of one restaurant."""
    df = spark.createDataFrame(rows_of(200), "doc_id long, text string").repartition(4)
    one, dealt = ({x.doc_id: x.score for x in lm.scored(df, owner_tokens=n).collect()} for n in (4_000_000, 150))
    assert one.keys() == dealt.keys() and sum(dealt.values()) == pytest.approx(sum(one.values()), rel=0.01)


def test_chances_of_the_next_word_sum_to_one(spark):
    """Single-word texts: what follows the start, over the words learned, leaves only what unseen words would get."""
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    words = [f"w{i}" for i in range(12)]
    rows = [(i, words[n % 12]) for n, i in enumerate(learned)]
    texts = {words[n % 12]: i for n, i in enumerate(learned)}
    for owner_tokens in (4_000_000, 20):
        got = {x.doc_id: x.score for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), owner_tokens=owner_tokens).collect()}
        assert 0.8 < sum(10 ** got[i] for i in texts.values()) < 1
