"""The most similar vectors of each query by cosine, a partition at a time.

Products of matrices tell which pairs can be among the best; only these are computed in the order of the vectors' dimensions, so that
similarities don't depend on how rows are dealt. A task holds the queries, the best rows so far of each, and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and queries of a block of products, and pairs that are computed in order at once.
ROWS, QUERIES, PAIRS = 2048, 1024, 1 << 20
#: Half of the last decimal that is kept, and what a product of matrices may be off.
HALF, SLACK = 0.5e-6, 1e-9
#: Keys by which similarities are compared: NaN first, null last, then places that are still free.
NAN, INF, NULL, FREE = np.inf, 1e300, -1e301, -np.inf


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, half up, as Spark's round."""
    scaled = np.abs(x) * 1e6
    whole = np.floor(scaled)
    out = np.copysign((whole + (scaled - whole >= 0.5)) / 1e6, x) + 0.0
    for k in np.flatnonzero((np.abs(scaled - whole - 0.5) < 1e-4) | (scaled > 2.0**40)):
        if np.isfinite(x[k]):
            out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
        else:
            out[k] = x[k]
    return out


class Vectors:
    """Vectors of one length without nulls, and their positions. `flat`: of length zero; `open`: with infinite values or NaN;
    `plain`: those whose products can be relied on; `wild`: the rest, too long or too short."""

    def __init__(self, at: np.ndarray, rows: np.ndarray):
        self.at, self.rows = at, rows
        with np.errstate(all="ignore"):
            norms = np.zeros(len(rows))
            for x in rows.T:
                norms += x * x
            self.norms = np.sqrt(norms)
            self.open = ~np.isfinite(rows).all(axis=1)
            self.flat = ~self.open & (self.norms == 0)
            self.plain = ~self.open & (self.norms > 1e-100) & (self.norms < 1e100)
            self.wild = ~self.open & ~self.flat & ~self.plain
            self.units = np.divide(rows, self.norms[:, None], out=np.zeros_like(rows), where=self.plain[:, None])
        self.columns = np.ascontiguousarray(rows.T)

    def some(self, which: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        for name in ("at", "rows", "norms", "open", "flat", "plain", "wild", "units"):
            setattr(out, name, getattr(self, name)[which])
        out.columns = self.columns[:, which]
        return out


def by_length(column: pa.Array) -> dict[int, Vectors]:
    """The vectors without nulls of a list column, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, whole = column.flatten(), column.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        whole[pc.list_parent_indices(column).to_numpy()[values.is_null().to_numpy(zero_copy_only=False)]] = False
    flat, starts = values.to_numpy(zero_copy_only=False).astype(float), np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == n))
        out[n] = Vectors(at, flat[starts[at][:, None] + np.arange(n)])
    return out


def similarities(x: Vectors, q: Vectors, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys of the pairs (row of x, row of q), summed up dimension by dimension."""
    out = np.zeros(len(r))
    with np.errstate(all="ignore"):
        for a in range(0, len(r), PAIRS):
            rows, own = r[a : a + PAIRS], c[a : a + PAIRS]
            dot = np.zeros(len(rows))
            for xs, qs in zip(x.columns, q.columns):
                dot += xs[rows] * qs[own]
            length = x.norms[rows] * q.norms[own]
            s = rounded(dot / length)
            out[a : a + PAIRS] = np.where(length == 0, NULL, np.where(np.isnan(s), NAN, np.clip(s, -INF, INF)))
    return out


class Best:
    """The best `k` rows so far of each query: keys, and places in `ids`, which stand in the order of rows."""

    def __init__(self, queries: int, k: int, ids: pa.Array):
        self.k, self.ids = k, ids
        self.keys, self.places = np.full((queries, k), FREE), np.full((queries, k), -1, np.int64)

    def add(self, q: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
        if not len(q):
            return
        own = np.unique(q)
        each = np.concatenate((np.repeat(own, self.k), q))
        places = np.concatenate((self.places[own].ravel(), places))
        keys = np.concatenate((self.keys[own].ravel(), keys))
        order = np.lexsort((places, -keys, each))
        first = np.searchsorted(each[order], own)
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.keys[own], self.places[own] = keys[kept].reshape(-1, self.k), places[kept].reshape(-1, self.k)

    def same(self, q: np.ndarray, places: np.ndarray, key: float) -> None:
        """Rows that have one key for all of these queries."""
        q, places = q[self.keys[q, -1] <= key], np.sort(places)[: self.k]
        self.add(np.repeat(q, len(places)), np.tile(places, len(q)), np.full(len(q) * len(places), key))

    def append(self, ids: pa.Array, ordered: bool) -> np.ndarray:
        """Takes the ids of new rows, without those that are no longer needed; the places of the new ones. `ordered`: they come by id."""
        live = np.unique(self.places[self.places >= 0])
        self.ids = pa.concat_arrays([self.ids.take(pa.array(live)), ids])
        places = np.arange(len(self.ids))
        if not ordered:
            order = pc.sort_indices(self.ids, null_placement="at_start")
            self.ids, places[order.to_numpy()] = self.ids.take(order), places.copy()
        self.places = np.where(self.places >= 0, places[np.searchsorted(live, self.places)], -1)
        return places[len(live) :]

    def batches(self, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        step = max(1, 10_000 // self.k)
        for a in range(0, len(self.keys), step):
            q, at = np.nonzero(self.places[a : a + step] >= 0)
            if not len(q):
                continue
            keys = self.keys[q + a, at]
            value = np.where(keys == NAN, np.nan, np.where(np.abs(keys) == INF, np.copysign(np.inf, keys), keys))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + a)), self.ids.take(pa.array(self.places[q + a, at])), pa.array(value, mask=keys == NULL)], names=names)


def search(best: Best, queries: dict[int, Vectors], asking: np.ndarray, column: pa.Array, places: np.ndarray, ordered: bool) -> None:
    """Adds rows (vectors, and their places in `best.ids`) for the queries that are `asking`. `ordered`: rows so far stand before these."""
    groups = by_length(column)
    whole = np.zeros(len(asking), bool)
    for n, q in queries.items():
        if not asking[q.at].all():
            q = q.some(np.flatnonzero(asking[q.at]))
        whole[q.at] = True
        x = groups.get(n)
        if x is None:
            best.same(q.at, places, NULL)
            continue
        at = places[x.at]
        # nulls, and vectors of another length
        best.same(q.at, np.delete(places, x.at) if len(x.at) < len(column) else places[:0], NULL)
        best.same(q.at[q.open], at, NAN)
        best.same(q.at[~q.open], at[x.open], NAN)
        best.same(q.at[q.flat], at[x.flat | x.plain], NULL)
        best.same(q.at[q.plain], at[x.flat], NULL)
        for rows, own in ((x.wild, ~q.open), (x.plain | x.flat, q.wild)):
            r, c = np.flatnonzero(rows), np.flatnonzero(own)
            for b in range(0, len(r), step := max(1, PAIRS // max(1, len(c)))):
                pairs = np.repeat(r[b : b + step], len(c)), np.tile(c, len(r[b : b + step]))
                best.add(q.at[pairs[1]], at[pairs[0]], similarities(x, q, *pairs))
        _products(best, x if x.plain.all() else x.some(np.flatnonzero(x.plain)), q if q.plain.all() else q.some(np.flatnonzero(q.plain)), places, ordered and not x.wild.any())
    without = asking & ~whole
    best.same(np.flatnonzero(without), places, NULL)


def _products(best: Best, x: Vectors, q: Vectors, places: np.ndarray, ordered: bool) -> None:
    k, at = best.k, places[x.at]
    # the first blocks are small, as all of their rows may be among the best so far
    a, size = 0, 128
    while a < len(x.at):
        for c in range(0, len(q.at), QUERIES):
            own = q.at[c : c + QUERIES]
            products = x.units[a : a + size] @ q.units[c : c + QUERIES].T
            last = best.keys[own, -1]
            # what has the same similarity as the last one so far, and a later place, is not among the best
            low = last + (HALF if ordered else -HALF) - SLACK
            hit = products >= low
            if np.count_nonzero(hit) > 4 * k * len(own) and len(products) > k:
                low = np.maximum(low, np.partition(products, -k, axis=0)[-k] - 2 * HALF - 2 * SLACK)
                hit = products >= low
            r, n = np.nonzero(hit)
            if len(r):
                best.add(own[n], at[a + r], similarities(x, q, a + r, c + n))
        a, size = a + size, min(ROWS, 2 * size)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k vectors (vec_id, embedding) most similar to each of the queries (query_id, embedding),
    which are sent to every task; ties by id. With a column `list` of the vectors and `lists` (bits) of the queries, a query meets
    the vectors of its lists only."""
    spark, listed = vectors.sparkSession, "list" in vectors.columns
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    asked = queries.select("query_id", doubles, *(["lists"] if listed else [])).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(asked)
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        ids, own = flat(table["query_id"]), by_length(flat(table["embedding"]))
        best, everyone = None, np.ones(len(ids), bool)
        bits = None
        if listed and len(ids):
            bits = np.unpackbits(np.frombuffer(b"".join(table["lists"].to_pylist()), np.uint8).reshape(len(ids), -1), axis=1).astype(bool)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            if best is None:
                best = Best(len(ids), k, batch.column(0).slice(0, 0))
            places = best.append(batch.column(0), not listed)
            if not listed:
                search(best, own, everyone, batch.column(1), places, True)
                continue
            of = batch.column(2).to_numpy(zero_copy_only=False)
            for n in np.unique(of):
                at = np.flatnonzero(of == n)
                search(best, own, bits[:, n], batch.column(1).take(pa.array(at)), places[at], False)
        if best is not None:
            yield from best.batches(ids, ["query_id", "vec_id", "similarity"])

    if k < 1:
        vectors = vectors.limit(0)
    rows = vectors.select("vec_id", doubles, *(["list"] if listed else []))
    # the rows of a list come one after the other, as they are stored
    rows = rows if listed else rows.sortWithinPartitions("vec_id")
    names = {"query_id": queries.schema["query_id"].dataType, "vec_id": vectors.schema["vec_id"].dataType}
    found = rows.mapInArrow(run, ", ".join([*(f"{n} {t.simpleString()}" for n, t in names.items()), "similarity double"]))
    by = W.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
