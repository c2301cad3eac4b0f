"""WARC records in ZIP-packaged archives, read by ranges and never extracted.

An archive is a ZIP file with two stored members: archive/data.warc.gz, the records one after another, each a gzip member of
its own, and indexes/index.cdx, one line "record-id offset length" per record. Tasks write archives as files into the shared folder, each
under a name of its own, and the table of the paths names those of the attempts that succeeded. The reader opens a file where
it lies, finds the end-of-central-directory record (and through its locator the ZIP64 one), parses the central directory with
its ZIP64 extra fields, turns a member into an absolute range by its local header, and reads records by the index, neighbours
in one range of at most span bytes (a longer record is a range of its own). It needs a source with size and read(offset, n);
no file is read or extracted whole.

Payloads are equal when their SHA-1 and length are. Of records with equal payloads (of min_bytes at least) the one with the
smallest page_id is the response; the others are revisit records that refer to it and carry no payload.

Cases: a very long payload is a record of its own length, held once in memory; a null html counts as empty; a null url has no
target header; rows with equal page_id and payload are all alike, responses or revisits; a null page_id never comes before another; an empty table makes no archives; other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import new_path, opened, qualified, small_batches, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class Bytes:
    """A source over bytes in memory."""

    def __init__(self, content: bytes):
        self.content, self.size = memoryview(content), len(content)

    def read(self, offset: int, n: int) -> bytes:
        return bytes(self.content[offset : offset + n])


class File:
    """A source over a file in any store that Arrow opens, by ranges; counts the bytes that it has read."""

    def __init__(self, path: str):
        system, at = opened(path)
        self.handle = system.open_input_file(at)
        self.size, self.bytes_read = self.handle.size(), 0

    def read(self, offset: int, n: int) -> bytes:
        data = self.handle.read_at(n, offset)
        self.bytes_read += len(data)
        return data

    def close(self) -> None:
        self.handle.close()


@dataclass
class Member:
    name: str
    method: int
    compressed: int
    size: int
    header_at: int


def zip64_values(extra: bytes, wanted: list[int]) -> list[int]:
    """wanted, with each value that is all ones taken from the ZIP64 extra field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            found = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [found.pop(0) if x == 0xFFFFFFFF and found else x for x in wanted]
        at += 4 + n
    return wanted


class ZipIndex:
    """The members of a ZIP file, by its central directory."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - 22 - 65535)
        tail = source.read(tail_at, source.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a whole ZIP file")
        entries, size, start = struct.unpack_from("<HII", tail, end + 10)
        if tail_at + end >= 20:
            locator = source.read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                record = source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator points nowhere")
                entries, size, start = struct.unpack_from("<QQQ", record, 32)
        directory, at = source.read(start, size), 0
        self.members: dict[str, Member] = {}
        for _ in range(entries):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            compressed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            (header_at,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, compressed, header_at = zip64_values(extra, [full, compressed, header_at])
            self.members[name] = Member(name, method, compressed, full, header_at)
            at += 46 + n_name + n_extra + n_comment

    def start_of(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        header = self.source.read(member.header_at, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))

    def read(self, name: str, offset: int, n: int) -> bytes:
        if not 0 <= offset <= offset + n <= self.members[name].size:
            raise ValueError("a range outside the member")
        return self.source.read(self.start_of(name) + offset, n)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}


def parse(data: bytes) -> tuple:
    """A row of RECORD_SCHEMA. The payload's digest is compared with the header's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = headers(lines[1:])
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(headers(http.split(b"\r\n")[1:])["content-length"])
    wanted = fields["warc-payload-digest"].partition(":")[2]
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest(payload) != wanted):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), length, wanted, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None, None if revisit else payload


def archive(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP file of the records; sizes stand in ZIP64 fields, whatever they are."""
    out, index, at = io.BytesIO(), [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as f:
            for page_id, data in records:
                packed = gzip.compress(data, 1, mtime=0)
                index.append(f"{record_id(page_id)} {at} {len(packed)}\n")
                at += f.write(packed)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
    return out.getvalue()


def records_of(source, span: int = 1_000_000) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA, in the order of the index."""
    z = ZipIndex(source)
    start, size = z.start_of(DATA), z.members[DATA].size
    lines = [line.rsplit(" ", 2)[1:] for line in z.read(INDEX, 0, z.members[INDEX].size).decode().splitlines()]
    ranges = [(int(offset), int(n)) for offset, n in lines]
    if any(offset < 0 or n < 0 or offset + n > size for offset, n in ranges):
        raise ValueError("the index points outside the member")
    at = 0
    while at < len(ranges):
        begin = ranges[at][0]
        stop, end = at + 1, sum(ranges[at])
        while stop < len(ranges) and ranges[stop][0] == end and end + ranges[stop][1] - begin <= span:
            end, stop = end + ranges[stop][1], stop + 1
        data = memoryview(source.read(start + begin, end - begin))
        for offset, n in ranges[at:stop]:
            yield parse(gzip.decompress(data[offset - begin : offset - begin + n]))
        at = stop


def write_archives(pages: DataFrame, *, archive_bytes: int = 8_000_000, min_bytes: int = 0) -> DataFrame:
    """Writes archives as files into the shared folder and returns their table: path, records, bytes."""
    spark = pages.sparkSession
    folder = qualified(spark, new_path(spark, "warc"))
    small_batches(spark, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha", F.octet_length("html").alias("bytes"))
    firsts = keys.groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = keys.join(firsts, ["sha", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = stored(revisits.select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "first").distinct(), "revisits")
    planned = rows.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left")
    planned = planned.select("page_id", "url", "html", "first", F.col("of_sha").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[tuple[int | None, bytes]] = []
        size, numbers = 0, itertools.count()

        def flush() -> pa.RecordBatch:
            nonlocal size
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{next(numbers):04d}.zip"
            content = archive(held)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(content)
            out = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(content)], pa.int64())], names=["path", "records", "bytes"])
            held.clear()
            size = 0
            return out

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4)))):
                held.append((page_id, record(page_id, url, html, first, revisit)))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return stored(planned.mapInArrow(run, ARCHIVE_SCHEMA), "warc-archives")


def read_archives(archives: DataFrame, *, with_payload: bool = True, rows: int = 500) -> DataFrame:
    """A row per record of the archives that the column path names."""
    fields = [x.split() for x in RECORD_SCHEMA.split(", ")][: None if with_payload else -1]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            source = File(path)
            found = records_of(source)
            while held := list(itertools.islice(found, rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])
            source.close()

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, ", ".join(" ".join(x) for x in fields))


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of the ZIP files in a folder; Spark lists them, their bytes are only read by ranges."""
    return read_archives(spark.read.format("binaryFile").load(path).select("path"), **options)
