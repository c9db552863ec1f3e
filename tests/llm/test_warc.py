"""WARC archives: round trips, revisits, damage, and the query's SQL."""

import gzip
import hashlib
import io
import os
import random
import zlib

import pytest
from compare import SF, check, connect

from tallyboard.llm import warc
from tallyboard.llm.queries import ORACLE_SQL, QUERIES

PAGE = "<p>" + "x" * 200
ROWS = [(1, "http://a", PAGE), (5, "http://b", PAGE), (None, None, PAGE), (5, "http://b", PAGE), (2, "http://c\r\nWARC-Type: metadata", "short"), (3, "d", "short"), (4, None, None), (6, "", ""), (7, "ü", "é日本" * 50), (None, "n", "nobody's " * 40), (None, "n", "nobody's " * 40), (8, "long", "".join(random.Random(1).choices("abcdefgh <>\n", k=3_000_000)))]
SCHEMA = "page_id long, url string, html string, payload_digest string, first_id long, many int, bytes int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], SCHEMA)


def wanted(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(ids) if ids and len(body) >= 100 else i
        kind = "response" if first == i else "revisit"
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), kind, None if kind == "response" else first, True))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=str)


@pytest.mark.parametrize("file_bytes", [1, 1 << 20, 1 << 30])
@pytest.mark.parametrize("groups", [0, 100])
def test_round_trip(spark, tmp_path, monkeypatch, file_bytes, groups):
    monkeypatch.setattr(warc, "SENT_GROUPS", groups)
    files = warc.write_archives(frame(spark, ROWS), f"file://{tmp_path}/w", file_bytes=file_bytes)
    total = files.agg({"records": "sum"}).first()[0]
    assert total == len(ROWS) and (file_bytes > 1 or files.count() == len(ROWS))
    back = warc.read_archives(files, keep=True)
    assert found(back) == wanted(ROWS)
    kept = {(r.page_id, bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()}
    assert kept >= {(1, PAGE), (4, ""), (7, "é日本" * 50), (8, ROWS[-1][2])}
    content = spark.read.format("binaryFile").load(f"file://{tmp_path}/w/*.warc.gz").select("content")
    assert found(warc.read_archives(content)) == wanted(ROWS)


def test_members(spark, tmp_path):
    """Each record is a gzip member of its own, and any gzip reader sees them one after the other."""
    files = warc.write_archives(frame(spark, ROWS).coalesce(1), f"file://{tmp_path}/w")
    path = files.first().file.removeprefix("file://")
    data, members = open(path, "rb").read(), 0
    assert os.path.getsize(path) == files.first().bytes
    while data:
        z = zlib.decompressobj(31)
        assert z.decompress(data).startswith(b"WARC/1.1\r\n")
        data, members = z.unused_data, members + 1
    text = gzip.open(path).read()
    assert members == len(ROWS) + 1 and text.count(b"\r\nWARC-Type: response") + text.count(b"\r\nWARC-Type: revisit") + text.count(b"WARC/1.1\r\nWARC-Type: re") >= len(ROWS)
    assert b"\r\nWARC-Type: metadata" not in text


def test_no_rows(spark, tmp_path):
    files = warc.write_archives(frame(spark, []), f"file://{tmp_path}/w")
    assert files.count() == 0 and warc.read_archives(files).count() == 0


def archive(pages):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    starts = []
    for i, body in pages:
        starts.append(w.bytes)
        w.page(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)
    return out.getvalue(), starts


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_reader_takes_any_pieces(step):
    pages = [(k, bytes([65 + k]) * (k * 1000)) for k in range(5)]
    data, _ = archive(pages)
    back = list(warc.records(io.BytesIO(data).read if step == 1 << 20 else lambda n, b=io.BytesIO(data): b.read(step), keep=True))
    assert [(r["page_id"], r["payload"]) for r in back] == pages and all(r["intact"] for r in back)


def test_damage():
    """A broken member is told and skipped; a changed payload is told by its digest; a file that ends early too."""
    pages = [(k, os.urandom(3000)) for k in range(4)]
    data, starts = archive(pages)
    broken = bytearray(data)
    broken[starts[1] + 600 : starts[1] + 640] = bytes(40)
    back = list(warc.records(io.BytesIO(bytes(broken)).read))
    assert [r.get("page_id") for r in back if r["intact"]] == [0, 2, 3] and sum(not r["intact"] for r in back) == 1
    back = list(warc.records(io.BytesIO(data[:-100]).read))
    assert [r.get("page_id") for r in back] == [0, 1, 2, None] and not back[-1]["intact"]
    members = []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        members.append(zlib.decompress(data[a:b], 31))
    other = members[2].replace(pages[2][1], pages[2][1][:-1] + bytes([pages[2][1][-1] ^ 1]))
    short = members[1].replace(b"Content-Length: 3", b"Content-Length: 2", 1)
    made = b"".join(gzip.compress(m) for m in (members[0], other, short, members[3]))
    back = list(warc.records(io.BytesIO(made).read))
    assert [(r.get("page_id"), r["intact"]) for r in back] == [(0, True), (2, False), (1, False), (3, True)]


def test_query(spark):
    check(QUERIES["op11_warc"](spark, SF), connect(SF), ORACLE_SQL["op11_warc"])
