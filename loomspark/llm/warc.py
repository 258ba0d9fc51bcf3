"""WARC archives: a writer and a splittable reader.

Writer: a gzip member per record, an archive per partition. Payloads are grouped by SHA-256: the smallest page_id of equal
payloads of at least ``min_revisit`` bytes is a response, the others are revisits that name it. Which payloads are met again is decided
on digests alone, and payloads are dealt by (digest, salt), so that copies of one page spread over tasks. Archives go to the
shared folder; a task writes under its attempt's own name and renames at the end, so repeated attempts are safe.

Reader: archives are cut into byte ranges without regard to records. A task looks for gzip magic in its range, validates a
candidate by decoding the member's head (a WARC version line must come out), and owns the records that start in its range, reading
past the end where the last one goes on. Payloads are decoded in parts and hashed as they come.

No record goes missing without a word. A member whose head is valid but whose rest is not (cut off, failing its checksum, of another length
than it says, header fields missing) gives a row with path, offset and ``error``. So does a place where a record must begin, the start of an archive and
the end of each record, and none does; a task checks that place behind its last record too, so damage at the border of two ranges is seen.
``archived`` raises on such rows.

Paths are opened through pyarrow's file systems (file, hdfs, s3, gs). Defined results: a null html is an empty payload. All rows
with the smallest page_id of a payload are responses (repeated rows too); null page_ids come after all others. A null url is
written as an empty one; characters that would break a header are percent-encoded. Page ids stand in header fields of their own; records of other
writers (warcinfo, request, urn:uuid) have null page_ids and are returned too. The payload of an HTTP message is what follows its head, as it is stored;
of any other record it is the whole block. Empty tables give no records. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import shared_path, utf8

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20
#: Longest header of a record.
HEAD = 1 << 20
SALTS = 32
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, path string, offset long, error string"
_TYPES = {"long": pa.int64(), "string": pa.string()}
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")


class NotARecord(Exception):
    """No record begins at a candidate."""


class Damaged(Exception):
    """A record begins, but it can't be read to its end."""


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record_bytes(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes, date: str = DATE, record_id: str | None = None) -> bytes:
    """One record as a gzip member. A revisit has no payload of its own; size and digest are of the full one."""
    uri = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id or uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    html = utf8("html")
    first = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.length(html).alias("n")).where(F.col("n") >= min_revisit)
    first = first.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    p = p.join(first, ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return p.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write an archive per partition and return rows (path, size); the rows are few, one a partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        ctx = TaskContext.get()
        name = f"{base}/part-{ctx.partitionId():06d}.warc.gz"
        own = f"{name}.{ctx.taskAttemptId()}"
        size = n = 0
        with fs.open_output_stream(own, compression=None) as out:
            for b in batches:
                for page_id, url, payload, digest, kind, refers_to in zip(*b.columns, strict=True):
                    data, n = payload.as_py(), n + 1
                    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{n}").urn
                    member = record_bytes(page_id.as_py(), url.as_py(), kind.as_py(), refers_to.as_py(), digest.as_py(), len(data), data, record_id=record_id)
                    out.write(member)
                    size += len(member)
        fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "size"])

    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    return records.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(write, "path string, size long")


class Window:
    """A file read forward from ``at``, a part at a time."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.start, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        part = self.file.read(READ)
        self.data += part
        return bool(part)

    def drop(self, upto: int) -> None:
        self.data = self.data[upto - self.start :]
        self.start = upto


def _member(w: Window, at: int) -> Iterator[bytes]:
    """The decoded parts of the member at ``at``; leaves w at its end. zlib.error where none begins there."""
    unpack, pos = zlib.decompressobj(31), at - w.start
    while not unpack.eof:
        if pos >= len(w.data):
            w.drop(w.start + len(w.data))
            pos = 0
            if not w.more():
                raise zlib.error("cut off")
        part = unpack.decompress(w.data[pos : pos + READ])
        pos = min(pos + READ, len(w.data))
        yield part
    w.drop(w.start + pos - len(unpack.unused_data))


def _version(parts: Iterator[bytes]) -> bytes:
    """The decoded bytes up to the version line's end at least; NotARecord where there is none."""
    data = b""
    try:
        while not _VERSION.match(data):
            data += next(parts)
            if not data.startswith(b"WARC/"[: len(data)]) or len(data) > 16 and not _VERSION.match(data):
                raise NotARecord("no version line")
    except (zlib.error, StopIteration) as e:
        raise NotARecord(str(e) or "cut off") from e
    return data


def read_record(parts: Iterator[bytes]) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id) from the decoded parts of a member."""
    data = _version(parts)
    try:
        return _fields_and_payload(data, parts)
    except (zlib.error, StopIteration, KeyError, ValueError) as e:
        raise Damaged(f"a field is missing: {e}" if isinstance(e, KeyError) else str(e) or "cut off") from e


def _fields_and_payload(data: bytes, parts: Iterator[bytes]) -> tuple:
    while b"\r\n\r\n" not in data:
        if len(data) > HEAD:
            raise ValueError("the header doesn't end")
        data += next(parts)
    head, _, data = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    kind, left = fields["warc-type"], int(fields["content-length"])
    http = b""
    if fields.get("content-type", "").lower().startswith("application/http"):
        while b"\r\n\r\n" not in data and len(data) < left:
            data += next(parts)
        if b"\r\n\r\n" in data[:left]:
            http, _, data = data.partition(b"\r\n\r\n")
            left -= len(http) + 4
    size, digest = 0, hashlib.sha256()
    while True:
        part = data[: left - size]
        size += len(part)
        digest.update(part)
        rest = data[len(part) :]
        data = next(parts, None)
        if data is None:
            break
        data = rest + data if rest else data
        if len(rest) > 4:
            break
    if size != left:
        raise ValueError(f"{left - size} bytes are missing")
    if rest != b"\r\n\r\n":
        raise ValueError("the record's end isn't where its length says")
    number = lambda name: int(fields[name]) if name in fields else None
    hexed = digest.hexdigest()
    if kind == "revisit":
        full = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
        size, hexed = int(full[1]) if full else size, fields.get("warc-payload-digest", hexed).removeprefix("sha256:")
    return number("warc-page-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to-page-id"), size, hexed, fields["warc-record-id"]


def records_in(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple]:
    """Rows of RECORDS: the records of ``path`` that start in [start, end), and what is wrong there."""
    with fs.open_input_file(path) as file:
        w, at = Window(file, start), start
        due = start if start == 0 else -1  # where a record must begin, as far as known
        wrong = lambda where, why: (None,) * 7 + (path, where, why)

        def ahead(n: int) -> bytes:
            while len(w.data) - (at - w.start) < n and w.more():
                pass
            return w.data[at - w.start : at - w.start + n]

        while at < end:
            if due == at and (seen := ahead(3)) != MAGIC:
                if not seen:
                    return
                yield wrong(at, "no record begins here")
                due = -1
            i = w.data.find(MAGIC, at - w.start)
            if i < 0:
                # The last two bytes may begin the magic.
                keep = max(at, w.start + len(w.data) - len(MAGIC) + 1)
                w.drop(min(keep, w.start + len(w.data)))
                at = w.start
                if not w.more():
                    return
                continue
            at = w.start + i
            if at >= end:
                return
            kept_start, kept = w.start, w.data
            try:
                row = read_record(_member(w, at))
            except (NotARecord, Damaged) as e:
                file.seek(kept_start + len(kept))
                w.start, w.data = kept_start, kept
                if isinstance(e, Damaged) or due == at:
                    yield wrong(at, str(e))
                at, due = at + 1, -1
                continue
            yield (*row, path, at, None)
            at = due = w.start
        if due == at and ahead(1):  # a record of the next range: its own task can't tell a damaged head from chance bytes
            try:
                if ahead(3) != MAGIC:
                    raise NotARecord("no record begins here")
                _version(_member(w, at))
            except NotARecord as e:
                yield wrong(at, str(e))


def read_archives(files: DataFrame, folder: str, split: int = 4 << 20) -> DataFrame:
    """files: (path, size). Rows of RECORDS of all archives, read in ranges of ``split`` bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        names, types = zip(*[(n, _TYPES[t]) for n, t in map(str.split, RECORDS.split(", "))], strict=True)
        for b in batches:
            for path, start, end in zip(*b.columns, strict=True):
                rows: list[tuple] = []
                for row in records_in(fs, path.as_py(), start.as_py(), end.as_py()):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"), "size")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    total = files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    return ranges.repartition(max(1, math.ceil(total)), "path", "start").mapInArrow(read, RECORDS)


def whole(records: DataFrame) -> DataFrame:
    """The records; a damaged one is an error."""
    why = F.concat(F.col("path"), F.lit(" at byte "), F.col("offset").cast("string"), F.lit(": "), F.col("error"))
    return records.where(F.when(F.col("error").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.lit(True))).drop("error")


def archived(pages: DataFrame, min_revisit: int = 100, split: int = 4 << 20) -> DataFrame:
    """Write every page to archives and read them back: rows of RECORDS without error."""
    spark: SparkSession = pages.sparkSession
    folder = shared_path(spark, "warc")
    files = write_archives(with_revisits(pages, min_revisit), folder).collect()  # a row a partition
    return whole(read_archives(spark.createDataFrame(files, "path string, size long"), folder, split))
