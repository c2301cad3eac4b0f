"""Repeated rows, null and equal ids, empty and very long texts, and clashing column names, for operators whose own tests lack them."""

import hashlib
import zlib
from base64 import b32encode
from collections import Counter

import pytest

from tempograph.llm import decontamination, line_dedup, packing, quality, token_output, warc
from tempograph.llm.bpe import default_path

LONG = "one two three. " * 20_000
ROWS = [(1, "A b c. D e f"), (1, "A b c. D e f"), (None, "x y z"), (2, None), (3, ""), (4, LONG), (5, "A b c. D e f"), (-7, "\n\n")]


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id long, text string, start int, n_tokens string, keys int, block int, score string, h long, pos int"
    return spark.createDataFrame([(i, t, 0, "x", 1, 2, "y", 3, 4) for i, t in ROWS], columns).repartition(3)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    return {t: tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in ROWS}


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_packing(docs, ids):
    rows = packing.pack(docs, segment_tokens=1000).collect()
    whole = [x for x in rows if x.doc_id == 1]
    assert len(whole) == 2 and all((x.start, x.length, x.ids_crc32) == (0, len(ids[ROWS[0][1]]) + 1, crc([*ids[ROWS[0][1]], 0])) for x in whole)
    for i in (4, None, 2, 3):
        pieces, at = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.start), 0
        of_text = [*ids[dict(ROWS)[i]], 0]
        for x in pieces:
            assert x.start == at and x.ids_crc32 == crc(of_text[at : at + x.length]) and x.doc_tokens == len(of_text)
            at += x.length
        assert at == len(of_text)
    filled = Counter()
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == filled[x.sequence_id]
        filled[x.sequence_id] += x.length
    assert max(filled.values()) <= 1024


@pytest.mark.parametrize("block_tokens", [5, 500_000])
def test_token_output(docs, ids, block_tokens):
    got = token_output.read_digests(token_output.write_blocks(docs, block_tokens=block_tokens)).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter((i, len(ids[t]) + 1, crc([*ids[t], 2])) for i, t in ROWS)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert [x.doc_id for x in sorted(got, key=lambda x: x.start)] == [None, -7, 1, 1, 2, 3, 4, 5]


def test_line_dedup(spark):
    line, long = "the very same line", "y" * 200_000
    rows = [(1, f"{line}\nshort"), (1, f"{line.upper()} \nshort"), (2, f"{line}\n{long}\n{line}"), (3, long), (None, "short"), (4, None)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h string, pos int").repartition(3)
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in line_dedup.digests(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 2, 0, sha(rows[0][1])), (1, 2, 0, sha(rows[1][1])), (2, 3, 2, sha(long)), (3, 1, 1, sha("")), (None, 1, 0, sha("short")), (4, 1, 0, sha(""))]
    assert got == Counter(want)


def test_warc(spark):
    long = "z" * 300_000
    rows = [(1, "<p>a</p>"), (1, "<p>a</p>"), (None, "<p>b</p>"), (2, long), (3, long), (4, None), (5, "")]
    df = spark.createDataFrame([(i, f"http://x/{i}", t, "r", 9) for i, t in rows], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(3)
    got = [x for x in warc.read_archives(warc.write_archives(df), with_payload=False).collect()]
    digest = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest) for x in got) == Counter((i, len(t or ""), digest(t)) for i, t in rows)
    kinds = {x.page_id: (x.record_type, x.refers_to) for x in got if x.page_id in (2, 3, 4, 5)}
    assert kinds == {2: ("response", None), 3: ("revisit", 2), 4: ("response", None), 5: ("revisit", 4)}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in ROWS) and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id in (1, 5)}) == 1


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "A b c. D e f", 0), (1, "A b c. D e f", 1), (2, "two three. one two three. one two", 2), (None, "x y z", 3)], "item_id long, text string, doc_id int")
    got = decontamination.contaminated_documents(docs, bench)
    assert {x.doc_id: x.item_ids for x in got.collect()} == {1: [1], 5: [1], 4: [2]}
    assert Counter(x.doc_id for x in decontamination.decontaminated(docs, bench).collect()) == Counter([None, 2, 3, -7])
