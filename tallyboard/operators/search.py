r"""Searches over stored tables by what was prepared once: a 3-gram index for keywords, and files in order for deep pages.

The keyword index has, for each file of a stored job table, the rows (by their number in the file) that hold each 3-gram of bytes of their
lower-case text. It is made where the file's rows are read, without a shuffle, and lies sorted by gram, so a search reads the
lists of its grams only. Terms intersect these lists per file; only files with rows left are read, and only their rows are tested."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.operators.filters import keyword_match

GRAM = 3
LISTS = "gram int, file string, n int, rows binary"
#: Bytes of text whose grams are sorted at a time.
CHUNK_BYTES = 2 << 20


def grams_of(term: str) -> list[int]:
    """The 3-grams of a term's bytes, as numbers."""
    data = term.lower().encode()
    return sorted({int.from_bytes(data[k : k + GRAM], "big") for k in range(len(data) - GRAM + 1)})


def _lists(texts: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, how many rows each has, the rows behind each other) of some texts."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    ends = ends - ends[0]
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))[: len(gram)]
    inside = np.arange(len(gram)) + GRAM <= ends[row + 1]
    both = np.unique(gram[inside] << np.uint64(32) | row[inside].astype(np.uint64))
    gram, row = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.diff(np.append(first, len(gram))), places[row]


def index_keywords(spark: SparkSession, jobs_path: str, index_path: str) -> None:
    """Writes the index of the stored jobs (title, company, description, skills) below `index_path`."""
    text = F.lower(F.concat_ws("\n", "title", "company", "description", F.array_join(F.coalesce("skills", F.array().cast("array<string>")), "\n")))
    rows = spark.read.parquet(jobs_path).select(text.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, sizes = batch.column(1).to_pylist(), np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(0).cast(pa.binary())])
            at = 0
            while at < len(files):
                # rows of one file, about CHUNK_BYTES of them
                to = at + 1
                size = sizes[at]
                while to < len(files) and files[to] == files[at] and size + sizes[to] <= CHUNK_BYTES:
                    size += sizes[to]
                    to += 1
                gram, n, places = _lists(batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at).to_numpy())
                ends = np.concatenate(([0], np.cumsum(n))).astype("<i4") * 4
                values = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(places.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array([files[at]] * len(gram)), pa.array(n, pa.int32()), values], names=["gram", "file", "n", "rows"])
                at = to

    rows.mapInArrow(run, LISTS).sortWithinPartitions("gram").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(index_path)


def candidates(spark: SparkSession, index_path: str, q: str) -> DataFrame | None:
    """(file, row) of the rows that hold all 3-grams of the terms; None if no term is that long."""
    wanted = sorted({g for term in (q or "").split() for g in grams_of(term)})
    if not wanted:
        return None
    lists = spark.read.schema(LISTS).parquet(index_path).where(F.col("gram").isin(wanted))

    def intersect(key, group):
        # a gram may have several lists of one file; a row stands in one of them
        left: np.ndarray | None = None
        by_gram: dict[int, list[np.ndarray]] = {}
        for gram, rows in zip(group.column("gram").to_pylist(), group.column("rows")):
            by_gram.setdefault(gram, []).append(np.frombuffer(rows.as_buffer(), "<u4"))
        if len(by_gram) == len(wanted):
            for own in sorted((np.concatenate(x) for x in by_gram.values()), key=len):
                left = own if left is None else np.intersect1d(left, own)
        left = np.zeros(0, "<u4") if left is None else left
        return pa.table({"file": pa.array([key[0].as_py()] * len(left), pa.string()), "row": pa.array(left.astype(np.int64))})

    return lists.groupBy("file").applyInArrow(intersect, "file string, row long")


def indexed_keyword_filter(spark: SparkSession, jobs_path: str, index_path: str, q: str) -> DataFrame:
    """What `keyword_filter` gives of the stored jobs, from the files that the index names. Terms of fewer than three bytes read all files.

    The index must be of these files; those that were added later aren't searched. The names of the files that have candidates pass through the driver."""
    found = candidates(spark, index_path, q)
    if found is None:
        return spark.read.parquet(jobs_path).where(keyword_match(q))
    files = [r.file for r in found.select("file").distinct().collect()]
    schema = spark.read.parquet(jobs_path).schema
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    kept = at.join(found.select(F.col("file").alias("_file"), F.col("row").alias("_row")), ["_file", "_row"], "left_semi")
    return kept.where(keyword_match(q)).select(*schema.names)


def write_in_order(df: DataFrame, path: str, files: int, date: str = "posted_date", tie: str = "job_id") -> None:
    """Stores rows newest first (null dates last), ties by `tie`, in files that follow one another."""
    order = [F.col(date).desc_nulls_last(), F.col(tie)]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def page_index(spark: SparkSession, path: str, date: str = "posted_date", tie: str = "job_id") -> DataFrame:
    """(file, n, before, first): rows of each file and before it, and its first row's key; one small row for each file. Keep it with the table."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.struct(F.col(date).alias("date"), F.col(tie).alias("tie")).alias("key"))
    each = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "row").alias("first"))
    order = W.orderBy(F.col("first.date").desc_nulls_last(), "first.tie")
    return each.select("file", "n", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), "first")


def seek_page(spark: SparkSession, path: str, index: DataFrame, skip: int = 0, limit: int = 100, date: str = "posted_date", tie: str = "job_id") -> DataFrame:
    """Rows `skip` to `skip + limit` of the order, read by their numbers from the one or two files that hold them."""
    own = index.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).select("file", "before").collect()
    schema = spark.read.parquet(path).schema
    out = None
    for r in own:
        rows = spark.read.schema(schema).parquet(r.file)
        some = rows.where(F.col("_metadata.row_index").between(skip - r.before, skip + limit - r.before - 1))
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out.orderBy(F.col(date).desc_nulls_last(), tie)


def page_after(spark: SparkSession, path: str, index: DataFrame, last: tuple | None, limit: int = 100, date: str = "posted_date", tie: str = "job_id") -> DataFrame:
    """The `limit` rows behind the row with the key `last` (date, tie), or the first ones: from the file that holds the key and those it takes from there."""
    files = index.orderBy("before").collect()
    begins = lambda key: (key.date is None, -key.date.timestamp() if key.date is not None else 0, key.tie)
    key = None if last is None else (last[0] is None, -last[0].timestamp() if last[0] is not None else 0, last[1])
    at = max((k for k, r in enumerate(files) if key is not None and begins(r.first) <= key), default=0)
    own, held = [], -files[at].n if files and key is not None else 0
    for r in files[at:]:
        own.append(r.file)
        held += r.n
        if held >= limit:
            break
    schema = spark.read.parquet(path).schema
    if not own:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*own)
    if last is not None:
        day, name = F.lit(last[0]), F.col(tie) > F.lit(last[1])
        rows = rows.where(F.col(date).isNull() & name) if last[0] is None else rows.where((F.col(date) < day) | ((F.col(date) == day) & name) | F.col(date).isNull())
    return rows.orderBy(F.col(date).desc_nulls_last(), tie).limit(limit)
