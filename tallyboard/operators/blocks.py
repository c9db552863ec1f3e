"""Small sides of joins: how large they are, and broadcasts in blocks of bounded size; and where steps leave what the next ones read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that are sent to every task at once.
SENT_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of all rows, as JSON."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def over_blocks(small: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """The union of run(block) over blocks of `small`, by hash of `key`, of about `limit` bytes each (`SENT_BYTES`). Usually one."""
    blocks = max(1, -(-size_of(small) // (limit or SENT_BYTES)))
    if blocks == 1:
        return run(small)
    out = None
    for b in range(blocks):
        part = run(small.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b))
        out = part if out is None else out.unionByName(part)
    return out


def _shared(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return shared.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder, or a temporary one in a local session without it."""
    return f"{_shared(spark)}/query-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept by checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
