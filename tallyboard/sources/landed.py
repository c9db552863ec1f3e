"""Folders of landed payloads as a Spark data source, for batch reads and as a stream.

Crawlers land files below ``<path>/vendor=<vendor>/``: one JSON object a line, with company, company_location, board, kind, fetched_at (ISO)
and body. A file must appear whole (written elsewhere and moved), and later files have later times of change.

A read has partitions of about `partitionBytes`. The option `vendors` (names with commas between) chooses folders, `since` (ISO) skips files
that changed before it. These are options and not filters that Spark pushes down: Spark 4.1 keeps one reader for all uses of a
frame, so two filters of one frame (as in a union over vendors) would both get the files of the first. A stream's offset is the (time of change, name) of the last file that it has taken, so nothing is listed
but what is there, and state is two values however many files landed."""

from __future__ import annotations

import datetime
import io
import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

if TYPE_CHECKING:
    import pyarrow as pa

FORMAT = "landed_payloads"
SCHEMA = "vendor string, company string, company_location string, board string, kind string, fetched_at timestamp, body string, file string"
#: Bytes of files that one task reads.
PARTITION_BYTES = 64 << 20
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Bytes of rows that a task holds before it hands them to Spark.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True, order=True)
class _File:
    changed: int
    path: str
    size: int = 0
    vendor: str = ""


def _listed(path: str, vendors: set[str] | None = None) -> list[_File]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    out = []
    for folder in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        key, _, vendor = folder.base_name.partition("=")
        if key != "vendor" or vendors is not None and vendor not in vendors:
            continue
        for x in store.get_file_info(fs.FileSelector(folder.path, recursive=True)):
            if x.is_file and not x.base_name.startswith((".", "_")):
                out.append(_File(x.mtime_ns, x.path, x.size, vendor))
    return sorted(out)


def _time(text: object) -> datetime.datetime | None:
    try:
        at = datetime.datetime.fromisoformat(str(text))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=datetime.UTC)


def _rows(path: str, files: Iterable[_File]) -> Iterator[tuple]:
    """The rows of some files, line by line. A line that isn't a JSON object gives no row; missing fields are null."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(path)
    for f in files:
        with store.open_input_stream(f.path) as raw, io.BufferedReader(raw) as lines:
            for line in lines:
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict):
                    text = [None if row.get(k) is None else str(row[k]) for k in ("company", "company_location", "board", "kind")]
                    body = row.get("body")
                    yield f.vendor, *text, _time(row.get("fetched_at")), body if body is None or isinstance(body, str) else json.dumps(body), f.path


def _read(path: str, files: Iterable[_File]) -> Iterator[pa.RecordBatch]:
    """The rows of some files, in batches of about `BATCH_BYTES`: Spark would gather rows by number, however long they are."""
    import pyarrow as pa

    types = [pa.timestamp("us", "UTC") if n == "fetched_at" else pa.string() for n in NAMES]
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)

    for row in _rows(path, files):
        rows.append(row)
        # characters of more than one byte take up to four in memory
        held += 500 + sum(sys.getsizeof(x) for x in row if isinstance(x, str))
        if held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _dealt(files: list[_File], size: int) -> list[InputPartition]:
    out, own, held = [], [], 0
    for f in files:
        if own and held + f.size > size:
            out.append(InputPartition(own))
            own, held = [], 0
        own.append(f)
        held += f.size
    return [*out, InputPartition(own)] if own else out


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.vendors = set(options["vendors"].split(",")) if "vendors" in options else None
        self.since = int(_time(options["since"]).timestamp()) * 10**9 if "since" in options else None

    def partitions(self) -> list[InputPartition]:
        # what a crawler fetched is never in a file that changed before
        return _dealt([f for f in _listed(self.path, self.vendors) if self.since is None or f.changed >= self.since], self.size)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.value if partition else [])


class LandedStreamReader(DataSourceStreamReader):
    """A batch takes all files that have landed since the last one: Spark doesn't tell a reader where a stream stands when it asks for the next offset."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The same files for the same offsets, as long as they stay where they landed."""
        first, last = ((x["changed"], x["path"]) for x in (start, end))
        return _dealt([f for f in _listed(self.path) if first < (f.changed, f.path) <= last], self.size)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.value if partition else [])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LandedPayloads(DataSource):
    """Options: path, partitionBytes, and for batch reads vendors and since."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("landed_payloads")`` and ``spark.readStream`` of it known to a session."""
    spark.dataSource.register(LandedPayloads)
