"""Sharding along a Hilbert curve over quantised metadata.

Every dimension is cut at quantiles of all rows: a value's cell is the share of rows below it, so whole strings and numbers
are compared, never prefixes or samples. Cells become one curve index, rows are ordered by it and the order is cut into runs
whose row counts differ by one at most. Neighbours on the curve agree in most dimensions, so each shard's min/max statistics
are narrow in all of them.

The order is never sorted in one place. The curve has at most 2**(bits * dimensions) cells. A cell that holds many rows is
split by a hash into sub-buckets, of `SUB_ROWS` rows or a 2**20th part of all rows, whichever is more; so the table of their
offsets has about 2**20 rows and one for each cell at most, whatever the input, and may be broadcast. Rows then move once,
in runs of whole sub-buckets that lie next to each other on the curve, and are numbered there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, filled, hashed, shuffle_width, unused

SHARDS = 40
BITS = 4
#: Rows of a sub-bucket, about, and the number of sub-buckets at which they begin to grow instead.
SUB_ROWS, SUBS = 256, 1 << 20
#: Bits of all dimensions together; the curve's cells are counted in the driver.
MOST_BITS = 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of the points (n x d, each coordinate below 2**bits) on the d-dimensional Hilbert curve."""
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> bit) & 1)
    return out


def cell_starts(rows: DataFrame, dimensions: list[str], bits: int) -> list[list[tuple[object, int]]]:
    """For each dimension the (smallest value, cell) of every cell that occurs, ascending; null is below all.

    A value with k of n rows below it lies in cell k * 2**bits DIV n. Distinct values are counted by a shuffle and added up
    in ranges, so no task sees all of them; 2**bits rows a dimension reach the driver."""
    kinds = dict(rows.select(*dimensions).dtypes)
    text = lambda c: F.col(c) if kinds[c] == "string" else F.lit(None).cast("string")
    number = lambda c: F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("d"), text(c).alias("s"), number(c).alias("x")) for i, c in enumerate(dimensions)])).alias("v"))
    values = cut(each.select("v.*").groupBy("d", "s", "x").agg(F.count(F.lit(1)).alias("n")))
    # what a run without a checkpoint would deal out anew must stay as it is numbered
    ranged = cut(values.repartitionByRange(shuffle_width(rows.sparkSession), "d", "s", "x").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("d", "part").agg(F.sum("n").alias("of_part"))
    totals = totals.select("d", "part", (F.sum("of_part").over(W.partitionBy("d").orderBy("part")) - F.col("of_part")).alias("before"), F.sum("of_part").over(W.partitionBy("d")).alias("total"))
    own = W.partitionBy("d", "part").orderBy("s", "x")
    # one row for each dimension and partition
    below = ranged.join(F.broadcast(totals), ["d", "part"]).withColumn("below", F.col("before") + F.sum("n").over(own) - F.col("n"))
    first = below.groupBy("d", F.expr(f"below * {2**bits} DIV total").alias("cell")).agg(F.min(F.struct("s", "x")).alias("v")).collect()
    return [sorted(((r.v.s if kinds[c] == "string" else r.v.x, r.cell) for r in first if r.d == i), key=lambda x: x[1]) for i, c in enumerate(dimensions)]


def cell(value: Column, starts: list[tuple[object, int]]) -> Column:
    """The cell whose start is the last one not above the value."""
    out = None
    for start, number in reversed([x for x in starts if x[1] > 0]):
        out = F.when(value >= F.lit(start), number) if out is None else out.when(value >= F.lit(start), number)
    return F.lit(0) if out is None else out.otherwise(0)


def assign(rows: DataFrame, dimensions: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS, sub_rows: int = SUB_ROWS) -> DataFrame:
    """`rows` with shard (0 to shards - 1), slot (gapless from 0) and curve: counts of shards are at most one apart.

    `dimensions` and `tie` name columns; `tie` orders the rows of a cell, and rows that agree in all of it are interchangeable.
    Columns named shard, slot or curve are replaced."""
    if bits * len(dimensions) > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits for all dimensions together")
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "curve")
    code, at, subs, sub, offset, run, place = unused(rows, "_code", "_at", "_subs", "_sub", "_offset", "_run", "_place")
    number = F.lit(0)
    for c, starts in zip(dimensions, cell_starts(rows, dimensions, bits)):
        number = F.shiftleft(number, bits) + cell(F.col(c), starts)
    coded = rows.withColumn(code, number)
    # one row for each cell of the curve
    found = np.array(coded.groupBy(code).count().collect(), np.int64).reshape(-1, 2)
    n, points = int(found[:, 1].sum()), np.stack([found[:, 0] >> (bits * k) & (2**bits - 1) for k in range(len(dimensions) - 1, -1, -1)], axis=1)
    curve = hilbert_index(points, bits)
    order = np.argsort(curve)
    found, curve = found[order], curve[order]
    size = max(sub_rows, n // SUBS)
    table = [(int(c), int(k), int(a), int(-(-m // size))) for (c, m), k, a in zip(found, curve, np.cumsum(found[:, 1]) - found[:, 1])]
    cells = spark.createDataFrame(table, f"{code} int, curve long, {at} long, {subs} int")
    split = coded.join(F.broadcast(cells), code).withColumn(sub, (hashed(F.concat_ws("|", *[F.col(c).cast("string") for c in tie])) % F.col(subs)).cast("int"))
    if any(x[3] > 1 for x in table):
        counts = split.where(F.col(subs) > 1).groupBy(code, sub).agg(F.count(F.lit(1)).alias("n"), F.first(at).alias("a"))
        offsets = counts.select(code, sub, (F.col("a") + F.sum("n").over(W.partitionBy(code).orderBy(sub)) - F.col("n")).alias(offset))
        split = split.join(F.broadcast(offsets), [code, sub], "left").withColumn(offset, F.coalesce(offset, at))
    else:
        split = split.withColumn(offset, F.col(at))
    moved = split.drop(code, at, subs, sub).withColumn(run, F.expr(f"{offset} DIV {size}")).repartition(run)
    placed = moved.withColumn(place, F.col(offset) + F.row_number().over(W.partitionBy(run, offset).orderBy(*tie)) - 1)
    placed = placed.withColumn("shard", F.expr(f"CAST({place} * {shards} DIV {max(1, n)} AS INT)"))
    placed = placed.withColumn("slot", F.expr(f"{place} - (CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}"))
    return placed.select(*rows.columns, "shard", "slot", "curve")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32, and the metadata dimensions of `documents`; missing columns count as null."""
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(filled()) + 16).cast("long").alias("size"), F.crc32(F.encode(filled(), "UTF-8")).alias("text_crc32"), has("lang").alias("lang"), has("source").alias("source"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, sub_rows: int = SUB_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), curve for every row of `docs`.

    Null texts have size 16 and CRC 0; null ids, sources and languages sort first; equal texts, very long ones and repeated
    rows are placed like any other; other columns are ignored whatever they are called; no rows give none."""
    placed = assign(measured(docs), ["source", "lang", "size"], ["doc_id", "text_crc32", "size"], shards, sub_rows=sub_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def with_shards(docs: DataFrame, shards: int = SHARDS, sub_rows: int = SUB_ROWS) -> DataFrame:
    """All columns of `docs` with shard, slot and curve; input columns of these names are replaced, all others stay as they are.

    Nulls, ties and repeated rows are placed as `shard_documents` places them. Whole rows are shuffled once."""
    docs = docs.drop("shard", "slot", "curve")
    names = unused(docs, "_source", "_lang", "_size", "_id", "_crc")
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    own = [has("source"), has("lang"), (F.octet_length(filled()) + 16).cast("long"), F.col("doc_id").cast("long"), F.crc32(F.encode(filled(), "UTF-8"))]
    placed = assign(docs.withColumns(dict(zip(names, own))), names[:3], [names[3], names[4], names[2]], shards, sub_rows=sub_rows)
    return placed.drop(*names)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Writes `with_shards` as Parquet below `folder`, a folder a shard. A file holds runs of the curve, so readers that filter by
    source, language or size skip most files by their statistics."""
    with_shards(docs, shards).write.partitionBy("shard").parquet(folder)
