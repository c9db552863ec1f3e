"""Repeated windows across documents, by content-defined segments.

A window is W consecutive tokens (words or bytes). Every window is named by the smallest hash among its grams of G tokens;
a maximal run of windows with one name is a segment, and segments of equal name meet in one shard. Equal windows have
equal names, so no match is lost, and a window's shard depends on its content alone: work grows with the input, not with
documents times shards. Texts are stored in chunks of some MB, and a chunk asks for all of its texts at once:

1. which names do other documents hold? A sorted list of short names goes out, one bit for each comes back;
2. of the segments with such names, by a hash of their content: which are copies of one in a smaller doc_id (they go whole),
   and which are the first of their content while other contents have the same name? Two bits for each content come back;
3. only the latter go to the shards. A shard's index finds the windows that also start in a document with a smaller doc_id;
   spans go back to the texts.

A text of any length is worked on in tiles, so memory is bounded by the tile and the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import FINER, NO_ID, chunks, cut, filled, mix, packed_rows, shuffle_width
from tallyboard.llm.exchange import KEY_BITS, KEY_MASK, PACKED, by_id, dealt, gathered, joined, packed, planes, unplanes

TILE = 1 << 19
#: Bytes of text in a chunk, whose names and segments are packed together; longer packets compress better.
SEND_BYTES = 4 << 20
#: Bits of the place of a row in its chunk, and of a chunk's number in its task.
ROW_BITS, CHUNK_BITS = 24, 19
#: Indexes that one task builds one after the other. Few segments reach them, so one for each task packs those more closely.
SHARDS_A_TASK = 1
#: Bits of a name that count, of `KEY_BITS`; two names that agree in them are sent in vain, no more. Fewer travel more cheaply.
NAME_BITS = 48
#: Bits of a name by which chunks ask for it, of which the upper 24 tell its partition, and bits of the hash of a content.
ASK_BITS, TAG_BITS = 40, 48
#: Odd, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
ASKED = "p int, chunk binary, names binary, held binary"
TAGGED = "p int, chunk binary, names binary, tags binary, ids binary"
ANSWERS = "chunk long, p int, bits binary"
SEGMENTS = "p int, data binary, sizes binary, starts binary, ids binary, keys binary, own_keys binary, own_vals binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if step < w else x


def runs(lengths: np.ndarray, window: int, gram: int, grams: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts of the given token counts, one behind the other: (first window, last window, name, text).

    grams(a, b) gives the gram hashes that start at tokens a to b - 1."""
    return tagged_runs(lengths, window, gram, grams, tags=False)[:4]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tagged_runs(lengths: np.ndarray, window: int, gram: int, grams: Callable[[int, int], np.ndarray], tags: bool = True) -> tuple[np.ndarray, ...]:
    """`runs`, and a hash of each segment's content: the sum of its gram hashes, each times a power of `STEP` by its place."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    found = []
    for a in range(0, n - window + 1, TILE):
        b = min(a + TILE, n - window + 1)
        each = grams(a, b + window - gram)
        name = sliding_min(each, window - gram + 1)
        # windows that would leave their text
        lo, hi = np.searchsorted(ends, a, "right"), min(len(ends), np.searchsorted(ends, b + window, "left") + 1)
        shift = np.zeros(b - a + 1, np.int32)
        stop = np.clip(ends[lo:hi] - a, 0, b - a)
        begin = np.clip(np.maximum(ends[lo:hi] - window + 1, ends[lo:hi] - lengths[lo:hi]) - a, 0, b - a)
        np.add.at(shift, begin, 1)
        np.add.at(shift, stop, -1)
        valid = np.cumsum(shift[:-1]) == 0
        change = np.concatenate(([True], (name[1:] != name[:-1]) | (valid[1:] != valid[:-1])))
        first = np.flatnonzero(change)
        last = np.concatenate((first[1:], [b - a])) - 1
        keep = valid[first]
        first, last, tag = first[keep], last[keep], np.zeros(0, np.uint64)
        if tags:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * _powers(STEP, len(each)), dtype=np.uint64)))
            tag = mix((total[last + window - gram + 1] - total[first]) * _powers(BACK, b - a)[first]) >> np.uint64(64 - TAG_BITS)
        found.append((first + a, last + a, name[first], tag))
    first, last, name, tag = (joined([f[i] for f in found], d) for i, d in ((0, "i8"), (1, "i8"), (2, "u8"), (3, "u8")))
    return first, last, name & KEY_MASK >> np.uint64(KEY_BITS - NAME_BITS) << np.uint64(KEY_BITS - NAME_BITS), np.searchsorted(ends, first, "right"), tag


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of data[start:start + size]."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return packed_rows(data[at], ends)


def _packet(p: int, segs: pa.Array, starts, ids, keys, own_keys, own_vals) -> tuple:
    sizes = pc.binary_length(segs).to_numpy(zero_copy_only=False).astype(np.int32)
    data = zstandard.ZstdCompressor(level=3).compress(b"".join(segs.to_pylist()))
    return p, data, planes(sizes), planes(starts.astype(np.int64)), planes(ids), planes(keys), planes(own_keys), planes(own_vals)


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["p", "data", "sizes", "starts", "ids", "keys", "own_keys", "own_vals"])


def _opened(rows: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segments, starts, ids, keys, own_keys, own_vals) of packets."""
    segs, rest, unpacker = [], [[] for _ in range(5)], zstandard.ZstdDecompressor()
    for row in rows:
        for data, sizes, *others in zip(*(row.column(n) for n in ("data", "sizes", "starts", "ids", "keys", "own_keys", "own_vals"))):
            segs.append(packed_rows(np.frombuffer(unpacker.decompress(data.as_py()), np.uint8), np.cumsum(unplanes(sizes.as_py(), "i4"), dtype=np.int64)))
            for into, x, kind in zip(rest, others, ("i8", "i8", "i8", "i8", "u8")):
                into.append(unplanes(x.as_py(), kind))
    return pa.concat_arrays(segs), *[joined(x, kind) for x, kind in zip(rest, ("i8", "i8", "i8", "i8", "u8"))]


def _first_copies(segs: pa.Array, ids: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Segments by content, the smallest id that holds each content, and which segments are from that one."""
    coded = segs.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    return coded, least, ids == least[code]


def _spans(starts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return (starts.astype(np.uint64) << np.uint64(32)) | (starts + tokens).astype(np.uint64)


def _send(segs: pa.Array, names, ids, keys, starts, counts, parts: int) -> pa.RecordBatch:
    """Segments of a chunk by shard, copies once. counts: tokens of each segment.

    Copies that are answered here only pass through, so they are dealt evenly, wherever their segment goes."""
    _, _, goes = _first_copies(segs, ids)
    shard = np.where(goes, (names >> np.uint64(34)) * np.uint64(parts) >> np.uint64(24), mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    rows, order = [], np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(parts + 1))
    for p in np.unique(shard).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        out, rest = own[goes[own]], own[~goes[own]]
        rows.append(_packet(p, segs.take(pa.array(out)), starts[out], ids[out], keys[out], keys[rest], _spans(starts[rest], counts[rest])))
    return _packets(rows)


def _merge_copies(batch: pa.RecordBatch, length: Callable[[pa.Array], np.ndarray]) -> pa.RecordBatch:
    """The packets of one shard as one: of equal segments those of the smallest id stay, the others are answered."""
    segs, starts, ids, keys, own_keys, own_vals = _opened([batch])
    _, _, goes = _first_copies(segs, ids)
    out, rest = np.flatnonzero(goes), np.flatnonzero(~goes)
    spans = _spans(starts[rest], length(segs.take(pa.array(rest))))
    return _packets([_packet(batch.column(0)[0].as_py(), segs.take(pa.array(out)), starts[out], ids[out], keys[out], np.concatenate((own_keys, keys[rest])), np.concatenate((own_vals, spans)))])


def _index_shard(batches: Iterator[pa.RecordBatch], window: int, repeated: Callable, parts: int) -> Iterator[pa.RecordBatch]:
    """Answers a task's shards: spans start << 32 | stop of repeated tokens, packed by row key."""
    shards: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        numbers = batch.column(0).to_pylist()
        for i, p in enumerate(numbers):
            shards.setdefault(p, []).append(batch.slice(i, 1))
    while shards:
        yield _index(shards.pop(min(shards)), window, repeated, parts)


def _index(rows: list[pa.RecordBatch], window: int, repeated: Callable, parts: int) -> pa.RecordBatch:
    segs, starts, ids, keys, own_keys, own_vals = _opened(rows)
    coded, least, first = _first_copies(segs, ids)
    del segs
    code = coded.indices.to_numpy(zero_copy_only=False)
    # spans in each distinct segment, and its number of tokens
    which, a, b, tokens = repeated(coded.dictionary, least)
    whole, part = np.flatnonzero(~first), np.flatnonzero(first)
    # each span for every place of its segment in the smallest document
    by_code = np.argsort(code[part], kind="stable")
    part = part[by_code]
    lo, hi = np.searchsorted(code[part], which, "left"), np.searchsorted(code[part], which, "right")
    n = hi - lo
    at = part[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.int64)
    spans = np.concatenate((_spans(starts[whole], tokens[code[whole]]), _spans(starts[at] + np.repeat(a, n), np.repeat(b - a, n)), own_vals))
    return packed(*by_id(np.concatenate((keys[whole], keys[at], own_keys)), spans), parts)


def merged(starts: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans inside each group; spans are sorted by (group, start)."""
    if not len(starts):
        return starts, ends, groups
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(ends + groups * far) - groups * far
    new = np.concatenate(([True], (groups[1:] != groups[:-1]) | (starts[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return starts[first], reach[last], groups[first]


def _spans_batch(keys: np.ndarray, counts: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    groups = np.repeat(np.arange(len(keys)), counts)
    a, b, g = merged((vals >> np.uint64(32)).astype(np.int64), (vals & np.uint64(0xFFFFFFFF)).astype(np.int64), groups)
    spans = np.stack((a, b), axis=1).astype(np.int32).ravel()
    return pa.RecordBatch.from_arrays([pa.array(keys), packed_rows(spans, 2 * np.cumsum(np.bincount(g, minlength=len(keys))))], names=["row_key", "spans"])


def _short(names: np.ndarray) -> np.ndarray:
    """`ASK_BITS` of each name. They only tell which segments to look at; one that is looked at in vain changes nothing."""
    return (names & KEY_MASK) >> np.uint64(KEY_BITS - ASK_BITS)


def thin(x: np.ndarray) -> bytes:
    """`planes` of uint64 without the upper bytes that all of them lack, and how many bytes are left."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T[:width].tobytes()


def unthin(data: bytes) -> np.ndarray:
    found = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, : data[0]] = found.T
    return out.view(np.uint64).ravel()


def _cuts(names: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition begins in sorted short names, and where the last one ends."""
    return np.searchsorted(((names >> np.uint64(ASK_BITS - 24)) * np.uint64(parts)) >> np.uint64(24), np.arange(parts + 1))


def _names_packet(names: np.ndarray) -> bytes:
    """Sorted short names as the first one and what each is above the one before."""
    return int(names[0]).to_bytes(8, "little") + thin(np.diff(names, prepend=names[:1]))


def _named(data: bytes) -> np.ndarray:
    return np.cumsum(unthin(data[8:]), dtype=np.uint64) + np.uint64(int.from_bytes(data[:8], "little"))


def _bits(found: pa.ListScalar, counts: np.ndarray, planes: int) -> np.ndarray:
    """The answers of all partitions in order: counts[p] flags, `planes` times for each partition, as (planes, all flags)."""
    sizes = (counts + 7) // 8
    if not found.is_valid:
        assert not counts.sum()
        return np.zeros((planes, 0), bool)
    parts = found.values.field(0).to_numpy()
    order = np.argsort(parts)
    assert np.array_equal(parts[order], np.flatnonzero(counts))
    data = np.frombuffer(b"".join(found.values.field(1).take(pa.array(order)).to_pylist()), np.uint8)
    flags = np.unpackbits(data, bitorder="little")
    begin = 8 * planes * (np.cumsum(sizes) - sizes)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    stride = np.repeat(8 * sizes, counts)
    return np.stack([flags[at + k * stride] for k in range(planes)]).astype(bool)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns.values()], names=list(columns))


def _told(batches: Iterator[pa.RecordBatch], judge: Callable) -> Iterator[pa.RecordBatch]:
    """judge(packets of a task) gives rows of flags, whose parts go back to the chunks that asked."""
    packets = [batch for batch in batches if batch.num_rows]
    if not packets:
        return
    rows = pa.Table.from_batches(packets).combine_chunks().to_batches()[0]
    names = [_named(x.as_py()) for x in rows.column("names")]
    ends = np.cumsum([len(x) for x in names])
    flags = judge(rows, joined(names, "u8"), np.repeat(np.arange(len(names)), [len(x) for x in names]))
    bits = [b"".join(np.packbits(f[a:b], bitorder="little").tobytes() for f in flags) for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
    yield _rows({"chunk": ([int.from_bytes(x.as_py(), "little") for x in rows.column("chunk")], pa.int64()), "p": (rows.column("p").to_pylist(), pa.int32()), "bits": (bits, pa.binary())})


def _shared(rows: pa.RecordBatch, names: np.ndarray, packet: np.ndarray) -> list[np.ndarray]:
    """Names that several chunks hold, or several documents of one."""
    held = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(n), bitorder="little") for x, n in zip(rows.column("held"), np.bincount(packet))]).astype(bool)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    group = np.cumsum(new) - 1
    out = np.empty(len(names), bool)
    out[order] = ((np.bincount(group) > 1) | (np.bincount(group, weights=held[order]) > 0))[group]
    return [out]


def _judged(rows: pa.RecordBatch, names: np.ndarray, packet: np.ndarray) -> list[np.ndarray]:
    """Contents that a smaller id holds, and those that are first while their name has other contents of another id."""
    tags = joined([unthin(x.as_py()) for x in rows.column("tags")], "u8")
    ids = joined([unthin(x.as_py()[8:]) + np.uint64(int.from_bytes(x.as_py()[:8], "little")) for x in rows.column("ids")], "u8").view(np.int64)
    order = np.lexsort((ids, tags, names))
    name, tag, own = names[order], tags[order], ids[order]
    other = np.concatenate(([True], name[1:] != name[:-1]))
    new = other | np.concatenate(([True], tag[1:] != tag[:-1]))
    first = np.flatnonzero(other)
    group, least = np.cumsum(other) - 1, own[new][np.cumsum(new) - 1]
    many = (np.add.reduceat(new.astype(np.int64), first) > 1) & (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first))
    whole, sent = np.empty(len(order), bool), np.empty(len(order), bool)
    whole[order] = own > least
    sent[order] = (own == least) & many[group]
    return [whole, sent]


class Chunk:
    """The texts of a chunk, their segments, and what the answers say about them."""

    def __init__(self, number: int, rows: bytes, window: int, gram: int, tokens: Callable, parts: int):
        self.number, self.window, self.parts = number, window, parts
        self.rows = pa.ipc.open_stream(rows).read_next_batch()
        self.ids = pc.fill_null(self.rows.column(0), NO_ID).to_numpy(zero_copy_only=False)
        self.lengths, grams, self.slicer = tokens(self.rows.column(1))
        self.first, self.last, self.name, self.own, self.tag = tagged_runs(self.lengths, window, gram, grams)
        self.short, self.which = np.unique(_short(self.name), return_inverse=True)

    def _packets(self, names: np.ndarray, more: Callable[[int, int], tuple], titles: list[str]) -> pa.RecordBatch:
        cuts = _cuts(names, self.parts)
        found = [(p, self.number.to_bytes(8, "little"), _names_packet(names[cuts[p] : cuts[p + 1]]), *more(cuts[p], cuts[p + 1])) for p in np.flatnonzero(np.diff(cuts)).tolist()]
        columns = list(zip(*found)) if found else [[]] * (3 + len(titles))
        return _rows({n: (list(x), pa.int32() if n == "p" else pa.binary()) for n, x in zip(["p", "chunk", "names", *titles], columns)})

    def ask(self) -> pa.RecordBatch:
        """Its names, and which of them several of its documents hold."""
        own = self.ids[self.own]
        low, high = np.full(len(self.short), np.iinfo(np.int64).max), np.full(len(self.short), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, own)
        np.maximum.at(high, self.which, own)
        return self._packets(self.short, lambda a, b: (np.packbits(low[a:b] < high[a:b], bitorder="little").tobytes(),), ["held"])

    def keep_shared(self, bits: pa.ListScalar) -> None:
        """Keeps segments whose names other documents hold; tells their contents apart, each with its smallest id here."""
        shared = _bits(bits, np.diff(_cuts(self.short, self.parts)), 1)[0][self.which]
        self.first, self.last, self.name, self.own, self.tag = (x[shared] for x in (self.first, self.last, self.name, self.own, self.tag))
        own, short = self.ids[self.own], _short(self.name)
        order = np.lexsort((own, self.tag, short))
        new = np.concatenate(([True], (short[order][1:] != short[order][:-1]) | (self.tag[order][1:] != self.tag[order][:-1]))) if len(order) else np.zeros(0, bool)
        self.content = np.empty(len(order), np.int64)
        self.content[order] = np.cumsum(new) - 1
        head = order[new]
        self.short, self.tags, self.least = short[head], self.tag[head], own[head]

    def ask_contents(self) -> pa.RecordBatch:
        def more(a, b):
            base = self.least[a:b].min()
            return thin(self.tags[a:b]), int(base).to_bytes(8, "little", signed=True) + thin((self.least[a:b] - base).view(np.uint64))

        return self._packets(self.short, more, ["tags", "ids"])

    def judge(self, codes: pa.ListScalar) -> None:
        """Which segments are removed whole, and which are the first of their content and to be compared with others."""
        whole, sent = _bits(codes, np.diff(_cuts(self.short, self.parts)), 2)
        here = self.ids[self.own] == self.least[self.content]
        self.whole, self.sent = whole[self.content] | ~here, sent[self.content] & here

    def send(self, shards: int) -> pa.RecordBatch:
        first, last, own = (x[self.sent] for x in (self.first, self.last, self.own))
        keys = (np.int64(self.number) << ROW_BITS) | own
        return _send(self.slicer(first, last + self.window), self.name[self.sent], self.ids[own], keys, first - (np.cumsum(self.lengths) - self.lengths)[own], last - first + self.window, shards)

    def removed(self, spans: pa.ListScalar) -> pa.RecordBatch:
        """doc_id, text, spans: of whole segments and of what the shards found."""
        own = self.own[self.whole]
        begin = self.first[self.whole] - (np.cumsum(self.lengths) - self.lengths)[own]
        end = begin + (self.last - self.first)[self.whole] + self.window
        if spans.is_valid:
            row, pairs = spans.values.field(0).to_numpy() & ((1 << ROW_BITS) - 1), [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in spans.values.field(1)]
            own = np.concatenate((own, np.repeat(row, [len(x) for x in pairs])))
            begin, end = (np.concatenate((x, *(y[:, k] for y in pairs))) for k, x in enumerate((begin, end)))
        order = np.lexsort((begin, own))
        a, b, g = merged(begin[order], end[order], own[order])
        counts = np.bincount(g, minlength=self.rows.num_rows)
        found = packed_rows(np.stack((a, b), axis=1).astype(np.int32).ravel(), 2 * np.cumsum(counts))
        return pa.RecordBatch.from_arrays([self.rows.column(0), self.rows.column(1), found], names=["doc_id", "text", "spans"])


def _stored(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as chunks with numbers, in the shared folder: each step finds the same rows in a chunk again."""

    def pack(batches):
        number = TaskContext.get().partitionId() << CHUNK_BITS
        for part in chunks(batches, limit=SEND_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_batch(part)
            yield _rows({"chunk": ([number], pa.int64()), "rows": ([sink.getvalue().to_pybytes()], pa.binary())})
            number += 1

    return cut(docs.mapInArrow(pack, "chunk long, rows binary"))


def with_repeated_spans(docs: DataFrame, window: int, gram: int, tokens: Callable, repeated: Callable, length: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(doc_id, text, spans) for every row: spans are int32 pairs of tokens, sorted, disjoint.

    tokens(texts) gives (token counts, grams function, slicer); slicer(start, stop) makes a binary array of those tokens.
    repeated(distinct segments, smallest doc_ids) gives (segment, first token, end token, token counts); length(segments) their tokens."""
    parts = shuffle_width(docs.sparkSession)
    by_key = parts * FINER

    def each(step, *known):
        """step(chunk) for each chunk, once it knows the answers of the columns `known`."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk = Chunk(batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), window, gram, tokens, by_key)
                    for k, learn in enumerate((Chunk.keep_shared, Chunk.judge)[: len(known)]):
                        learn(chunk, batch.column(2 + k)[i])
                    yield step(chunk, batch, i)

        return run

    def answers(packets, judge, name):
        there, opened = dealt(packets, by_key)
        told = there.mapInArrow(lambda batches: _told(opened(batches), judge), ANSWERS)
        return told.groupBy("chunk").agg(F.collect_list(F.struct("p", "bits")).alias(name)).hint("shuffle_hash")

    # all joins read the chunks by one shuffle: the same columns, dealt by the same key
    stored = _stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text")))
    shared = stored.join(answers(stored.mapInArrow(each(lambda c, *_: c.ask()), ASKED), _shared, "shared"), "chunk", "left")
    codes = answers(shared.mapInArrow(each(lambda c, *_: c.ask_contents(), "shared"), TAGGED), _judged, "codes")
    judged = shared.join(codes, "chunk", "left")
    segments = judged.mapInArrow(each(lambda c, *_: c.send(by_key * SHARDS_A_TASK), "shared", "codes"), SEGMENTS)
    there, opened = dealt(segments, by_key, SHARDS_A_TASK, lambda batch: _merge_copies(batch, length))
    found = there.mapInArrow(lambda b: _index_shard(opened(b), window, repeated, parts), PACKED)
    spans = gathered(found, parts, _spans_batch, "row_key long, spans binary")
    spans = spans.groupBy(F.shiftright("row_key", ROW_BITS).alias("chunk")).agg(F.collect_list(F.struct("row_key", "spans")).alias("found")).hint("shuffle_hash")
    whole = each(lambda c, batch, i: c.removed(batch.column(4)[i]), "shared", "codes")
    return judged.join(spans, "chunk", "left").mapInArrow(whole, "doc_id long, text string, spans binary")
