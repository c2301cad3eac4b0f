import base64
import gzip
import hashlib
import io
import random
import zipfile

import pytest

from tempograph.llm import warc as w


def test_zip_index_reads_what_zipfile_writes(tmp_path):
    for force in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            with z.open(zipfile.ZipInfo("a/ä.bin"), "w", force_zip64=force) as f:
                f.write(b"0123456789" * 100)
            z.writestr("b.txt", b"hello")
            z.comment = b"PK\x05\x06 a comment with a false end"
        (tmp_path / "x.zip").write_bytes(out.getvalue())
        for source in (w.Bytes(out.getvalue()), w.File(str(tmp_path / "x.zip"))):
            i = w.ZipIndex(source)
            assert i.read("a/ä.bin", 995, 5) == b"56789" and i.read("b.txt", 0, 5) == b"hello"
            with pytest.raises(ValueError):
                i.read("b.txt", 3, 4)
    with pytest.raises(ValueError):
        w.ZipIndex(w.Bytes(b"nothing"))


def test_zip64_directory():
    small = w.archive([(1, w.record(1, "http://a/", b"x", None, False))])
    end = small.rfind(b"PK\x05\x06")
    entries, size, start = (int.from_bytes(small[end + a : end + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + entries.to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    big = small[:end] + record + locator + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    assert [r[:5] for r in w.records_of(w.Bytes(big))] == [r[:5] for r in w.records_of(w.Bytes(small))]


def test_pages(spark, tmp_path):
    rows = [(5, "http://x/é y", "Ünï"), (3, None, "same"), (9, "u", "same"), (4, "u", "same"), (7, "u", None), (8, "u", ""), (11, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    archives = w.write_archives(df, archive_bytes=100)
    read = {x.page_id: x for x in w.read_archives(archives).collect()}
    assert len(read) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        x = read[i]
        assert (x.payload_bytes, x.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert x.payload == (payload if first == i else None)
    assert {x.record_type for x in w.read_archives(w.write_archives(df, min_bytes=5)).collect()} == {"response"}
    assert w.read_archives(w.write_archives(df.limit(0))).collect() == []
    paths = [a.path for a in archives.collect()]
    assert len(paths) > 2 and all(zipfile.ZipFile(p.partition(":")[2].replace("//", "/")).testzip() is None for p in paths)
    assert w.read_files(spark, paths[0].rpartition("/")[0], with_payload=False).count() == len(rows)


def test_damage_is_noticed():
    whole = w.record(1, None, b"payload", None, False)
    assert w.parse(whole)[2] == 7
    with pytest.raises(ValueError):
        w.parse(whole.replace(b"payload", b"Payload"))
    data = bytearray(w.archive([(1, whole)]))
    z = w.ZipIndex(w.Bytes(bytes(data)))
    data[z.start_of(w.DATA) + z.members[w.DATA].size - 6] ^= 1  # in the gzip member's checksum
    with pytest.raises(OSError):
        list(w.records_of(w.Bytes(bytes(data))))


def test_only_ranges_are_read(tmp_path):
    data = [w.record(i, None, random.Random(i).randbytes(300_000), None, False) for i in range(40)]
    (tmp_path / "a.zip").write_bytes(w.archive(list(enumerate(data))))
    source = w.File(str(tmp_path / "a.zip"))
    z = w.ZipIndex(source)
    start = z.start_of(w.DATA)
    third = z.read(w.INDEX, 0, z.members[w.INDEX].size).decode().splitlines()[3].split()
    assert w.parse(gzip.decompress(source.read(start + int(third[-2]), int(third[-1]))))[0] == 3
    assert source.bytes_read < 500_000 < 12_000_000 < source.size
    assert [r[0] for r in w.records_of(w.File(f"file://{tmp_path}/a.zip"))] == list(range(40))


def test_keys_that_are_null_or_equal(spark):
    rows = [(None, "u", "same"), (2, "u", "same"), (2, "u", "same"), (5, "u", "x" * 3_000_000), (6, "u", "x" * 3_000_000), (None, "u", "alone")]
    got = w.read_archives(w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")), with_payload=False).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (0, 4, "revisit", 2), (0, 5, "response", 0), (2, 4, "response", 0), (2, 4, "response", 0), (5, 3_000_000, "response", 0), (6, 3_000_000, "revisit", 5),
    ]
