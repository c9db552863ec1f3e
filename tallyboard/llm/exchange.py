"""Packed exchanges: which keys do several documents share, and gathering values per document.

Rows of the shuffles are arrays of some thousand keys, not single keys, so a shuffle of 10**8 keys has some thousand rows;
numpy works on them inside the tasks. Everything is spread by hashes over the session's number of shuffle partitions.

Every chunk has a packet for nearly every partition. Up to `ONE_HOP` partitions the packets are rows of one shuffle. Beyond, they go
in two hops: first in bundles to groups of partitions, as many as a group has members, then from there to the partition; so the
rows of a chunk grow with the square root of the partitions, not with their number.

A key that many documents share never gathers in one place: inside a chunk (some MB of text) a key held by more than
`cap` documents is answered on the spot, and only one record of it travels to inform the other chunks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import FINER, chunks, key_order, mix, packed_order, shuffle_width

#: Keys have 58 bits; the 6 bits above hold a key's capped document count, so that values sort by (count, key).
KEY_BITS = 58
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
#: Counts of the marker values that operators pass along with the keys.
MARK = 63

ASK = "p int, keys binary, at binary, ids binary, told binary, own_ids binary, own_counts binary, own_vals binary"
PACKED = "p int, ids binary, counts binary, vals binary"


#: Partitions to which packets are dealt in one hop.
ONE_HOP = 4096


def _listed(batch: pa.RecordBatch, key: str, numbers: np.ndarray, order: np.ndarray) -> pa.RecordBatch:
    """One row for each number, with all rows of that number as arrays; `order` sorts them."""
    numbers = numbers[order]
    first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(numbers)), pa.int32())
    sorted_rows = batch.take(pa.array(order))
    columns = [pa.ListArray.from_arrays(ends, c) for c in sorted_rows.columns]
    return pa.RecordBatch.from_arrays([pa.array(numbers[first], pa.int32()), *columns], names=[key, *batch.schema.names])


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that `_listed` put into arrays."""
    names = batch.schema.names[1:]
    return pa.RecordBatch.from_arrays([batch.column(i + 1).flatten() for i in range(len(names))], names=names)


def dealt(packets: DataFrame, parts: int, per: int = 1, combine: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> tuple[DataFrame, Callable]:
    """`packets` (p, binary columns) in partition p DIV `per`, and what turns a task's batches into batches of packets again.

    combine(packets of one p) may merge them on the way: after the first hop a task holds those of many chunks, so what all
    chunks share reaches its partition about sqrt(parts) times, however many chunks there are."""
    if parts <= ONE_HOP:
        return packets.repartitionById(parts, F.expr(f"CAST(p DIV {per} AS INT)")), lambda batches: batches
    names = packets.columns
    width = math.isqrt(parts - 1) + 1
    groups = -(-parts // width)
    # the places of a group: all partitions are used by the first hop too
    places = max(1, parts // groups)
    lists = ", ".join(["p array<int>", *[f"{n} array<binary>" for n in names[1:]]])

    def bundle(batches):
        for batch in batches:
            if batch.num_rows:
                group = batch.column(0).to_numpy() // per // width
                place = zlib.crc32(b"".join(x.as_py()[:64] for x in batch.column(1)[:8] if x.is_valid)) % places
                yield _listed(batch, "target", group * places + place, np.argsort(group, kind="stable"))

    def regroup(batches):
        for batch in batches:
            rows = _flat(batch)
            if combine and rows.num_rows:
                number = rows.column(0).to_numpy()
                rows = pa.Table.from_batches([combine(rows.take(pa.array(np.flatnonzero(number == p)))) for p in np.unique(number)]).combine_chunks().to_batches()[0]
            target = rows.column(0).to_numpy() // per
            yield _listed(rows, "target", target, np.argsort(target, kind="stable"))

    first = packets.mapInArrow(bundle, f"target int, {lists}")
    second = first.repartitionById(parts, first["target"]).mapInArrow(regroup, f"target int, {lists}")
    return second.repartitionById(parts, second["target"]), lambda batches: map(_flat, batches)


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes, all first bytes before all second ones: sorted keys then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def joined(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def by_id(ids: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, counts, vals sorted inside each id, each once)."""
    if not len(ids):
        return ids, np.zeros(0, np.uint32), vals
    order = np.lexsort((vals, ids))
    ids, vals = ids[order], vals[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (vals[1:] != vals[:-1])))
    ids, vals = ids[new], vals[new]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], np.diff(np.concatenate((first, [len(ids)]))).astype(np.uint32), vals


def packed(ids: np.ndarray, counts: np.ndarray, vals: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each partition (by id) that gets something. ids are distinct; counts say how many vals each has."""
    p = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(p, kind="stable")
    starts = np.cumsum(counts, dtype=np.int64) - counts
    ids, counts, p = ids[order], counts[order], p[order]
    moved = np.repeat(starts[order] - (np.cumsum(counts, dtype=np.int64) - counts), counts) + np.arange(len(vals))
    vals = vals[moved]
    cuts = np.searchsorted(p, np.arange(parts + 1))
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    rows = [(i, planes(ids[a:b]), planes(counts[a:b]), planes(vals[ends[a] : ends[b]])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["p", "ids", "counts", "vals"])


def gathered(packets: DataFrame, parts: int, finish: Callable, schema: str) -> DataFrame:
    """Brings all values of an id together; finish(ids, counts, vals) makes the record batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vals = [], []
        for batch in batches:
            for i, n, v in zip(*(batch.column(k) for k in ("ids", "counts", "vals"))):
                ids.append(np.repeat(unplanes(i.as_py(), "i8"), unplanes(n.as_py(), "u4")))
                vals.append(unplanes(v.as_py(), "u8"))
        if ids:
            yield finish(*by_id(joined(ids, "i8"), joined(vals, "u8")))

    there, opened = dealt(packets, parts)
    return there.mapInArrow(lambda batches: run(opened(batches)), schema)


def ask_rows(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, cap: int, parts: int, mark_ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """The records of a chunk. owner: row of `ids` that each key is from; marks: values that only travel along."""
    keys = keys & KEY_MASK
    order = key_order(keys, KEY_BITS)
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    pairs = np.sort(((np.cumsum(new) - 1).astype(np.uint64) << np.uint64(24)) | owner[order].astype(np.uint64))
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
    group, own = (pairs >> np.uint64(24)).astype(np.int64), (pairs & np.uint64(0xFFFFFF)).astype(np.int64)
    each = k[new]
    many = np.bincount(group, minlength=len(each)) > cap
    cut_keys = np.searchsorted(((each >> np.uint64(34)) * np.uint64(parts)) >> np.uint64(24), np.arange(parts + 1))
    cut_pairs = np.searchsorted(group, cut_keys)
    extra = np.array_split(np.arange(len(marks)), parts) if len(marks) else [np.zeros(0, np.int64)] * parts
    rows = []
    for p in range(parts):
        a, b = cut_pairs[p], cut_pairs[p + 1]
        g, o = group[a:b], own[a:b]
        answered = many[g]
        who, at = np.unique(o[~answered], return_inverse=True)
        told = each[cut_keys[p] : cut_keys[p + 1]][many[cut_keys[p] : cut_keys[p + 1]]]
        vals = np.concatenate((each[g[answered]] | (np.uint64(cap + 1) << np.uint64(KEY_BITS)), marks[extra[p]]))
        own_ids, own_counts, own_vals = by_id(np.concatenate((ids[o[answered]], mark_ids[extra[p]])), vals)
        if len(at) or len(told) or len(own_vals):
            rows.append((p, planes(each[g[~answered]]), planes(at.astype(np.uint32)), planes(ids[who]), planes(told), planes(own_ids), planes(own_counts), planes(own_vals)))
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["p", "keys", "at", "ids", "told", "own_ids", "own_counts", "own_vals"])


def merge_told(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The packets of one partition, with each key that chunks have answered told once."""
    told = np.unique(joined([unplanes(t.as_py(), "u8") for t in batch.column("told")], "u8"))
    once = pa.array([planes(told)] + [b""] * (batch.num_rows - 1), pa.binary())
    return batch.set_column(batch.schema.names.index("told"), "told", once)


def answer_rows(batches: Iterator[pa.RecordBatch], cap: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Values count << 58 | key for each document that holds a key which two documents or more hold; counts stop at cap + 1."""
    keys, ids, told, own_ids, own_vals = [], [], [], [], []
    for batch in batches:
        for k, at, i, t, oi, oc, ov in zip(*(batch.column(n) for n in ("keys", "at", "ids", "told", "own_ids", "own_counts", "own_vals"))):
            keys.append(unplanes(k.as_py(), "u8"))
            ids.append(unplanes(i.as_py(), "i8")[unplanes(at.as_py(), "u4")])
            told.append(unplanes(t.as_py(), "u8"))
            own_ids.append(np.repeat(unplanes(oi.as_py(), "i8"), unplanes(oc.as_py(), "u4")))
            own_vals.append(unplanes(ov.as_py(), "u8"))
    if not keys:
        return
    k, i = joined(keys, "u8"), joined(ids, "i8")
    del keys, ids
    order = key_order(k, KEY_BITS)
    k, i = k[order], i[order]
    del order
    told_keys = np.unique(joined(told, "u8"))
    found = np.minimum(np.searchsorted(told_keys, k), max(0, len(told_keys) - 1))
    hot = told_keys[found] == k if len(told_keys) else np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    live = hot | np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(k) else hot
    k, i, hot = k[live], i[live], hot[live]
    # one id may have asked from several chunks
    rank = np.cumsum(np.concatenate(([False], k[1:] != k[:-1])))
    who, dense = np.unique(i, return_inverse=True)
    order = packed_order((rank, int(len(k)).bit_length()), (dense, int(len(who)).bit_length()))
    k, i, hot = k[order], i[order], hot[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]))) if len(k) else np.zeros(0, bool)
    k, i, hot = k[new], i[new], hot[new]
    group = np.cumsum(np.concatenate(([True], k[1:] != k[:-1]))) - 1 if len(k) else np.zeros(0, np.int64)
    count = np.where(hot, cap + 1, np.minimum(np.bincount(group), cap + 1)[group]) if len(k) else np.zeros(0, np.int64)
    shared = count >= 2
    vals = (count[shared].astype(np.uint64) << np.uint64(KEY_BITS)) | k[shared]
    yield packed(*by_id(np.concatenate((i[shared], joined(own_ids, "i8"))), np.concatenate((vals, joined(own_vals, "u8")))), parts)


def shared_keys(docs: DataFrame, records: Callable, cap: int, finish: Callable, schema: str) -> DataFrame:
    """Which keys of a document do other documents hold too?

    records(chunk of `docs`) gives (keys, owner, ids, mark_ids, marks); finish gets each id's sorted values."""
    by_doc = shuffle_width(docs.sparkSession)
    by_key = FINER * by_doc

    def asks(batches):
        for chunk in chunks(batches):
            keys, owner, ids, mark_ids, marks = records(chunk)
            yield ask_rows(keys, owner, ids, cap, by_key, mark_ids, marks)

    asked = docs.mapInArrow(asks, ASK)
    there, opened = dealt(asked, by_key, combine=merge_told)
    answered = there.mapInArrow(lambda b: answer_rows(opened(b), cap, by_doc), PACKED)
    return gathered(answered, by_doc, finish, schema)
