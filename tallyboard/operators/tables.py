"""Tables in hash buckets of a key, so that a merge rewrites only the buckets that its rows fall into.

Files are never changed. A merge writes the new content of the touched buckets to a folder of its own, and then a new list of which
folder holds which bucket; the newest list whose writer has marked it as done is the table. A merge that dies leaves the old list
current, and readers of an older list keep their files until `vacuum`."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
LIST = "bucket int, folder string, buckets int, batch long, schema string"


class BucketedTable:
    """A table below `path`, in buckets by hash of `keys`. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _found(self, pattern: str) -> list[str]:
        files, path = self._hadoop(pattern)
        return sorted(x.getPath().getParent().toString() for x in files.globStatus(path) or [])

    def lists(self) -> list[str]:
        """Folders of the whole lists, oldest first."""
        return self._found(f"{self.path}/list-*/_SUCCESS")

    def exists(self) -> bool:
        return bool(self.lists())

    def _state(self) -> list:
        """The current list: a row for each bucket that has been written, and one (bucket null) with what holds for all."""
        return self.spark.read.schema(LIST).parquet(self.lists()[-1]).collect()

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(buckets)).cast("int")

    def _publish(self, folders: dict[int, str], buckets: int, batch: int, schema: str) -> None:
        rows = [(None, None, buckets, batch, schema), *[(b, f, None, None, None) for b, f in sorted(folders.items())]]
        name = f"{self.path}/list-{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, LIST).coalesce(1).write.parquet(name)

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Writes rows by bucket into a new folder; the buckets that have rows, with their folders."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        by_bucket = rows.withColumn("_bucket", self.bucket(buckets)).repartition("_bucket")
        by_bucket.write.partitionBy("_bucket").parquet(folder)
        files, path = self._hadoop(f"{folder}/_bucket=*")
        return {int(x.getPath().getName().partition("=")[2]): x.getPath().toString() for x in files.globStatus(path) or []}

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> None:
        """Makes `rows` (unique keys) the table. As many buckets as make one of them a few hundred MB."""
        self._publish(self._write(rows, buckets), buckets, -1, rows.schema.json())

    def _head(self, state: list):
        return next(r for r in state if r.bucket is None)

    def _read(self, state: list, touched: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._head(state).schema))
        folders = [r.folder for r in state if r.bucket is not None and (touched is None or r.bucket in touched)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as it is now, and stays for this reader."""
        return self._read(self._state())

    def has(self, batch: int | None) -> bool:
        """Whether the batch was merged before."""
        return batch is not None and batch <= self._head(self._state()).batch

    def touched(self, changes: DataFrame) -> DataFrame:
        """The stored rows of the buckets that `changes` fall into."""
        state = self._state()
        buckets = {r[0] for r in changes.select(self.bucket(self._head(state).buckets).alias("b")).distinct().collect()}
        return self._read(state, buckets)

    def merge(self, changes: DataFrame, rebuild: Callable[[DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """rebuild(stored rows of the buckets that `changes` fall into) becomes these buckets; returns them.

        `changes` must have the keys. A batch number that isn't above the last one's is a batch that was merged before: nothing is done."""
        state = self._state()
        head = self._head(state)
        if batch is not None and batch <= head.batch:
            return []
        touched = sorted(r[0] for r in changes.select(self.bucket(head.buckets).alias("b")).distinct().collect())
        folders = {r.bucket: r.folder for r in state if r.bucket is not None}
        if touched:
            for b in touched:
                folders.pop(b, None)
            folders |= self._write(rebuild(self._read(state, set(touched))), head.buckets)
        if touched or batch is not None:
            self._publish(folders, head.buckets, head.batch if batch is None else batch, head.schema)
        return touched

    def vacuum(self, keep: int = 3) -> None:
        """Deletes all but the `keep` newest lists, and the bucket folders that none of these name."""
        lists = self.lists()
        used = {r.folder for name in lists[-keep:] for r in self.spark.read.schema(LIST).parquet(name).collect()}
        files, _ = self._hadoop(self.path)
        held = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data-*/_bucket=*")) or []
        gone = [*lists[:-keep], *[x.getPath().toString() for x in held if x.getPath().toString() not in used]]
        for x in gone:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(x), True)
