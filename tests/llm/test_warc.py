import gzip
import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest

from loomspark.llm import warc as w


def test_any_split_finds_every_record_once(tmp_path):
    r = random.Random(4)
    payloads = [r.randbytes(r.randint(0, 3000)) + (w.MAGIC if i % 5 == 0 else b"") + gzip.compress(b"inner" * i) for i in range(60)]
    data = b"".join(w.record_bytes(i, "http://x/ é\n", "response", None, hashlib.sha256(x).hexdigest(), len(x), x) for i, x in enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == 60
    fs = pafs.LocalFileSystem()
    for split in (7, 500, 4096, 10**9):
        got = [x for s in range(0, len(data), split) for x in w.records_in(fs, str(tmp_path / "a.warc.gz"), s, min(len(data), s + split))] if split > 100 or len(data) < 10**5 else None
        if got is not None:
            assert [(x[0], x[4], x[5]) for x in got] == [(i, len(x), hashlib.sha256(x).hexdigest()) for i, x in enumerate(payloads)]


def everything(path, data, split):
    path.write_bytes(data)
    fs = pafs.LocalFileSystem()
    return [x for s in range(0, len(data), split) for x in w.records_in(fs, str(path), s, min(len(data), s + split))]


def member(i, payload=b"<p>some page</p>" * 20):
    return w.record_bytes(i, f"http://x/{i}", "response", None, hashlib.sha256(payload).hexdigest(), len(payload), payload)


@pytest.mark.parametrize("split", [150, 1000, 10**6])
def test_damage_is_told(tmp_path, split):
    parts = [member(i) for i in range(5)]
    starts = [sum(map(len, parts[:i])) for i in range(6)]
    data = b"".join(parts)
    assert [(x[0], x[8], x[9]) for x in everything(tmp_path / "a", data, split)] == [(i, starts[i], None) for i in range(5)]
    for cut in (1, 10, len(parts[4]) - 1):
        got = everything(tmp_path / "a", data[:-cut], split)
        assert [x[0] for x in got if not x[9]] == [0, 1, 2, 3] and [x[8] for x in got if x[9]] == [starts[4]]
    for at in (*range(0, 11), 40, len(parts[2]) // 2, len(parts[2]) - 2):
        if at in (4, 5, 6, 7, 8, 9):
            continue  # the member's time, flags and system: not part of the record
        flipped = bytearray(data)
        flipped[starts[2] + at] ^= 0x55
        got = everything(tmp_path / "a", bytes(flipped), split)
        assert [x[0] for x in got if not x[9]] == [0, 1, 3, 4], at
        assert [x for x in got if x[9] and x[8] == starts[2]]
    got = everything(tmp_path / "a", data + b"left over", split)
    assert [x[0] for x in got if not x[9]] == [0, 1, 2, 3, 4] and [x[8] for x in got if x[9]] == [starts[5]]
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 9\r\n\r\nfive5\r\n\r\n")
    none = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nfive5\r\n\r\n")
    got = everything(tmp_path / "a", parts[0] + short + none + parts[1], split)
    assert [x[0] for x in got if not x[9]] == [0, 1] and [x[8] for x in got if x[9]] == [len(parts[0]), len(parts[0] + short)]


def test_foreign_archives(tmp_path):
    record = lambda head, block: gzip.compress(b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    info = record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\n", b"software: x\r\n")
    page = record(b"warc-type: response\r\nWARC-Record-ID:<urn:uuid:2>\r\nWARC-Target-URI: http://y/\r\nContent-Type: application/http;\r\n msgtype=response\r\n", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody")
    again = record(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http\r\n", b"HTTP/1.1 304 Not Modified\r\nContent-Length: 77\r\n\r\n")
    empty = record(b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:4>\r\n", b"")
    got = everything(tmp_path / "a", info + page + again + empty, 64)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    assert [x[:7] for x in got] == [
        (None, None, "warcinfo", None, 13, digest(b"software: x\r\n"), "<urn:uuid:1>"),
        (None, "http://y/", "response", None, 4, digest(b"body"), "<urn:uuid:2>"),
        (None, None, "revisit", None, 77, "sha1:ABC", "<urn:uuid:3>"),
        (None, None, "metadata", None, 0, digest(b""), "<urn:uuid:4>"),
    ]
    assert not any(x[9] for x in got)


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(member(1) + member(2)[:-10])
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(member(1) + member(2)) - 10)], "path string, size long")
    rows = w.read_archives(files, str(tmp_path))
    assert sorted((r.page_id or 0, r.error is not None) for r in rows.collect()) == [(0, True), (1, False)]
    with pytest.raises(Exception, match="at byte"):
        w.whole(rows).select("page_id").collect()


def test_pages(spark):
    long, short = "<p>" + "x" * 200, "tiny"
    rows = [(5, "http://a/", long), (3, "http://b/", long), (3, "http://b/", long), (None, None, long), (8, "u", short), (7, "u", short), (1, "u", None), (2, "u", "é" * 500_000)]
    df = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in w.archived(df, split=1000).collect()), key=str)
    want = []
    for a, _, c in rows:
        data = (c or "").encode()
        again = c == long and a != 3
        want.append((a or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    assert w.archived(df.where("false")).count() == 0
