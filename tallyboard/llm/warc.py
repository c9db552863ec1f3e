r"""WARC archives: pages written as records, one gzip member each, and a sequential reader.

The writer gives every record with a payload that an earlier page of the table has too (at least `LEAST_REVISIT` bytes) as a revisit
of that page's response, without the payload. The reader takes a file in blocks of `BLOCK` bytes: a member is inflated piece by piece,
the content length frames the record's block, and digests of block and payload are summed while the pieces go by, so a file may
be of any size and memory holds one piece (and the payload, where it is asked for).

A task writes files of its own, named after its attempt; the table of files that it returns is what counts, so files of attempts
that were lost are never read."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, shared_folder, shuffle_width

#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Bytes that are read, inflated and summed at a time.
BLOCK = 1 << 20
#: Longest header of a record or of its HTTP message.
HEAD_BYTES = 1 << 20
#: A file is closed beyond so many bytes.
FILE_BYTES = 1 << 30
#: Groups of equal payloads that are sent to all tasks (some 100 bytes each); more are joined.
SENT_GROUPS = 200_000
#: The date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"

IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, records long, bytes long"
RECORDS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, problem string, payload binary"


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (never null), payload_digest and refers_to: the smallest page_id of the equal payloads, for other pages than that.

    Rows that have the smallest page_id more than once are responses each; a null page_id is larger than any other, and a group of
    nothing else is all responses. Only digests and ids are gathered; the groups of several pages are sent out up to `SENT_GROUPS`
    and joined beyond."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    groups = own.where(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("many")).where("many > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id")
    few = groups.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS
    both = own.join(F.broadcast(groups) if few else groups, "payload_digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select("page_id", "url", "html", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"))


def record_id(digest: str, page_id: int | None, kind: str) -> str:
    """The same for the same page, payload and kind, so that a revisit can name its response without having met it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind}:{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def _line(text: str) -> str:
    """White space and control characters as in URLs, so that nothing breaks out of a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


class ArchiveWriter:
    """One WARC file: a warcinfo record, then a gzip member for each record."""

    def __init__(self, out, date: str = DATE):
        self.out, self.date, self.bytes, self.records = out, date, 0, 0
        info = b"software: tallyboard\r\nformat: WARC File Format 1.1\r\n"
        self._member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, info, b"")

    def _member(self, fields: dict[str, str | None], head: bytes, payload: bytes) -> None:
        digest = hashlib.sha256(head)
        digest.update(payload)
        fields = fields | {"WARC-Block-Digest": f"sha256:{digest.hexdigest()}", "Content-Length": str(len(head) + len(payload))}
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        start = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
        self._put(z.compress(start.encode() + head))
        view = memoryview(payload)
        for at in range(0, len(payload), BLOCK):
            self._put(z.compress(view[at : at + BLOCK]))
        self._put(z.compress(b"\r\n\r\n") + z.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def page(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        kind = "response" if refers_to is None else "revisit"
        fields = {
            "WARC-Type": kind, "WARC-Record-ID": record_id(digest, page_id, kind), "WARC-Date": self.date, "WARC-Target-URI": _line(url) if url else f"urn:page:{page_id}",
            "Page-ID": None if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response",
        }
        if refers_to is not None:
            fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(digest, refers_to, "response"), "Refers-To-Page-ID": str(refers_to)}
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        self._member(fields, head, payload if refers_to is None else b"")
        self.records += 1


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) into WARC files below `folder`; returns the table of files (file, records, bytes).

    A null html is an empty payload, a null url becomes ``urn:page:<page_id>``; repeated rows are written each time, with one record id;
    very long texts go out in pieces; other columns are ignored; without rows there are no files. The table of files is stored in
    the folder too (``files``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        task, number, archive, done = TaskContext.get(), 0, None, []

        def close() -> None:
            archive.out.close()
            done.append((name, archive.records, archive.bytes))

        for batch in chunks(batches, "html"):
            ids, urls, pages_, digests, refers = (batch.column(k) for k in range(5))
            for i, url, page, digest, first in zip(ids.to_pylist(), urls.to_pylist(), pages_, digests.to_pylist(), refers.to_pylist()):
                if archive is None:
                    store.create_dir(root, recursive=True)
                    name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc.gz"
                    archive, number = ArchiveWriter(store.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), date), number + 1
                archive.page(i, url, page.as_buffer().to_pybytes(), digest, first)
                if archive.bytes >= file_bytes:
                    close()
                    archive = None
        if archive:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])

    import pyarrow.fs  # noqa: F401  pa.fs

    rows = planned(pages, least).select("page_id", "url", "html", "payload_digest", "refers_to")
    rows.mapInArrow(write, FILES).write.parquet(f"{folder}/files")
    return pages.sparkSession.read.schema(FILES).parquet(f"{folder}/files")


class Damaged(ValueError):
    """What is wrong with a record."""


class Members:
    """The inflated bytes of one gzip member after the other, from a function that reads the next bytes of a file."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.raw, self.z, self.held = read, b"", None, b""

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        self.raw = self.raw or self.read(BLOCK)
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """The next inflated bytes of the member, none at its end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.z.eof:
            self.raw = self.raw or self.read(BLOCK)
            if not self.raw:
                raise Damaged("the file ends within a member")
            try:
                out = self.z.decompress(self.raw, BLOCK)
            except zlib.error as e:
                raise Damaged(str(e)) from None
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def skip(self) -> None:
        """Behind damage: goes to the next place that begins a member whose text begins as a record does."""
        seen = self.raw[1:]
        while True:
            at = seen.find(b"\x1f\x8b\x08")
            if at < 0:
                more = self.read(BLOCK)
                if not more:
                    self.raw = b""
                    return
                seen = seen[-2:] + more
                continue
            if len(seen) - at < 4096:
                seen += self.read(BLOCK)
            try:
                if zlib.decompressobj(31).decompress(seen[at : at + 4096], 8).startswith(b"WARC/"):
                    self.raw = seen[at:]
                    return
            except zlib.error:
                pass
            seen = seen[at + 1 :]


def _head(members: Members, what: str, first: bytes = b"") -> tuple[bytes, bytes]:
    """(header, what was read behind it)."""
    got = first
    while (at := got.find(b"\r\n\r\n")) < 0:
        piece = members.more()
        if not piece or len(got) > HEAD_BYTES:
            raise Damaged(f"no end of the {what} header")
        got += piece
    return got[:at], got[at + 4 :]


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _record(members: Members, keep: bool) -> dict | None:
    """The record of the member at hand, or None for one that holds no page."""
    head, rest = _head(members, "record")
    if not head.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    fields = _fields(head)
    length = _number(fields.get("content-length"))
    if length is None or length < 0:
        raise Damaged("no content length")
    block, payload, kept, http, size = hashlib.sha256(), hashlib.sha256(), [], b"", 0
    in_http = fields.get("content-type", "").startswith("application/http")
    left, told = length, None
    while left:
        piece = rest or members.more()
        if not piece:
            raise Damaged("the block is shorter than its content length")
        piece, rest = piece[:left], piece[left:]
        left -= len(piece)
        block.update(piece)
        if in_http:
            http += piece
            if (at := http.find(b"\r\n\r\n")) < 0:
                if len(http) > HEAD_BYTES:
                    raise Damaged("no end of the HTTP header")
                continue
            told, piece, in_http = _number(_fields(http[:at]).get("content-length")), http[at + 4 :], False
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    end = rest
    while len(end) <= 4 and (piece := members.more()):
        end += piece
    kind, problem = fields.get("warc-type"), None
    if end != b"\r\n\r\n":
        problem = "the record doesn't end with its block"
    if kind not in ("response", "revisit"):
        if problem:
            raise Damaged(problem)
        return None
    given = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields.get("warc-block-digest", f"sha256:{block.hexdigest()}") != f"sha256:{block.hexdigest()}":
        problem = "the block has another digest"
    if kind == "response" and given and given != payload.hexdigest():
        problem = "the payload has another digest"
    return {
        "page_id": _number(fields.get("page-id")), "target_uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _number(fields.get("refers-to-page-id")), "payload_bytes": size if kind == "response" else told,
        "payload_digest": payload.hexdigest() if kind == "response" else given, "intact": problem is None, "problem": problem, "payload": b"".join(kept) if keep and kind == "response" else None,
    }


def records(read: Callable[[int], bytes], keep: bool = False) -> Iterator[dict]:
    """The page records of a file in order; `read` gives its next bytes. A member that can't be read gives a row with only `problem`,
    and reading goes on at the next member."""
    members = Members(read)
    while members.begin():
        try:
            record = _record(members, keep)
            if not members.z.eof and members.more():
                raise Damaged("several records in a member")
        except Damaged as e:
            record = {"intact": False, "problem": str(e)}
            if members.z.eof:
                members.held = b""
            else:
                members.skip()
        if record:
            yield record


def read_archives(files: DataFrame, keep: bool = False) -> DataFrame:
    """The page records of all WARC files: page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, intact, problem,
    payload (null unless asked for by `keep`, and for revisits).

    `files` names them (`file`, a URI or path that tasks can open), or holds them (`content`, as Spark's binaryFile source gives it,
    for stores that only Spark reaches). Files are dealt evenly and each is read in sequence by one task."""

    fields = [x.split()[0] for x in RECORDS.split(", ")]
    types = dict(zip(fields, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], types[f]) for f in fields], names=fields)

    held = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs  # noqa: F401  pa.fs

        rows, size = [], 0
        for some in batches:
            for x in some.column(0):
                if held:
                    source = io.BytesIO(x.as_py())
                else:
                    store, path = pa.fs.FileSystem.from_uri(x.as_py())
                    source = store.open_input_stream(path, compression=None)
                with source:
                    for record in records(source.read, keep):
                        rows.append(record)
                        size += len(record.get("payload") or b"") + 200
                        if size > BLOCK:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    one = files.select("content" if held else "file")
    return one.repartition(shuffle_width(files.sparkSession)).mapInArrow(run, RECORDS)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
