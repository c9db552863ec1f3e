"""Benchmark decontamination by a distributed positional inverted index.

`store_index` writes the index once: each row is a block of documents (some MB of text) with the postings of all its terms,
term -> ascending positions, delta-coded and compressed. It is partitioned by document, so a very common term never gathers
in one place. Every search reads the stored index, not the texts. The test terms meet it in blocks of items whose size is
checked before they are sent out; a test set beyond the bound is dealt with in as many blocks as it needs. In a block of
documents a window is answered from its rarest term outwards: the offset-adjusted list of the rarest term is intersected
with the lists of the others, next rarest first; proximity matches take each list's places within the gap.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import ALNUM, Words, chunks, filled, shared_folder, translated, where_text
from tallyboard.llm.exchange import planes, unplanes

WINDOW = 10
#: Bytes of test texts that are sent out at once.
ITEM_BLOCK_BYTES = 8 << 20

INDEX = "doc_ids array<long>, row_keys array<long>, n_words array<long>, terms binary, sizes binary, gaps binary"
MATCHES = "doc_id long, item_id string, kind string, start int, stop int"
COUNTS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
REPORT = "row_key long, doc_id long, n_words long, hits binary, items array<string>"


class TestTerms:
    """Windows of test items over a small term dictionary: `window` consecutive words, or a shorter item as a whole."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        words = Words(translated(pa.array([t for _, t in items], pa.string()), ALNUM))
        #: sorted hashes; a term's number is its place
        self.terms, codes = np.unique(words.hashes(), return_inverse=True)
        codes = codes.astype(np.int32)
        self.names = [i for i, _ in items]
        at, seen = 0, {}
        for item, n in enumerate(words.counts):
            own = codes[at : at + n]
            at += n
            if not n:
                continue
            for i in range(max(1, n - window + 1)):
                seen.setdefault(own[i : i + window].tobytes(), set()).add(item)
        self.owners = [sorted(x) for x in seen.values()]
        self.lengths = np.array([len(k) // 4 for k in seen], np.int64)
        self.grid = np.full((len(seen), window), -1, np.int64)
        for row, k in enumerate(seen):
            own = np.frombuffer(k, np.int32)
            self.grid[row, : len(own)] = own


class Postings:
    """The lists of all terms in one block of documents; positions count through the block."""

    def __init__(self, texts: pa.Array):
        words = Words(translated(texts, ALNUM))
        self.counts = words.counts
        hashes = words.hashes()
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        self.terms, self.sizes, self.places = hashes[first], np.diff(np.append(first, len(hashes))), order

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """terms, list sizes and gaps: each list's first place and the distances that follow."""
        gaps = np.diff(self.places, prepend=0)
        starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        gaps[starts] = self.places[starts]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return squeeze(planes(self.terms)), squeeze(planes(self.sizes.astype(np.uint32))), squeeze(planes(gaps.astype(np.uint32)))

    @classmethod
    def unpacked(cls, counts: np.ndarray, terms: bytes, sizes: bytes, gaps: bytes) -> Postings:
        out, loose = cls.__new__(cls), zstandard.ZstdDecompressor().decompress
        out.counts, out.terms, out.sizes = counts, unplanes(loose(terms), "u8"), unplanes(loose(sizes), "u4").astype(np.int64)
        total = np.cumsum(unplanes(loose(gaps), "u4"), dtype=np.int64)
        starts = np.cumsum(out.sizes) - out.sizes
        out.places = total - np.repeat(np.where(starts > 0, total[starts - 1], 0), out.sizes) if len(total) else total
        return out


class BlockIndex:
    """The lists of the test terms in one block of documents, as sorted keys: term * n + position."""

    def __init__(self, lists: Postings, tests: TestTerms):
        self.counts, self.ends = lists.counts, np.cumsum(lists.counts)
        self.n = max(1, int(self.ends[-1])) if len(self.ends) else 1
        known = np.minimum(np.searchsorted(lists.terms, tests.terms), max(0, len(lists.terms) - 1))
        here = np.flatnonzero(lists.terms[known] == tests.terms) if len(lists.terms) else np.zeros(0, np.int64)
        known = known[here]
        self.sizes = np.zeros(len(tests.terms), np.int64)
        self.sizes[here] = lists.sizes[known]
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = (np.cumsum(lists.sizes) - lists.sizes)[known]
        n = lists.sizes[known]
        places = lists.places[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        self.keys = np.repeat(here, n) * self.n + places

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def _by_rarity(self, tests: TestTerms) -> tuple[np.ndarray, np.ndarray]:
        """Windows of which every term has a list, and the order of each one's terms, rarest first."""
        if not len(tests.grid) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
        size = np.where(tests.grid >= 0, self.sizes[np.maximum(tests.grid, 0)], np.iinfo(np.int64).max)
        return np.flatnonzero(size.min(axis=1) > 0), np.argsort(size, axis=1, kind="stable")

    def _list(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `term` each place is from, and the places of all their lists."""
        n = self.sizes[term]
        which = np.repeat(np.arange(len(term)), n)
        at = np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return which, self.keys[at] - term[which] * self.n

    def phrases(self, tests: TestTerms) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions where they stand word for word, inside one document."""
        live, by_rarity = self._by_rarity(tests)
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, place = self._list(tests.grid[live, by_rarity[live, 0]])
        window = live[which]
        start = place - by_rarity[window, 0]
        fits = (start >= 0) & (start + tests.lengths[window] <= self.n)
        window, start = window[fits], start[fits]
        for step in range(1, tests.grid.shape[1]):
            offset = by_rarity[window, step]
            term = tests.grid[window, offset]
            # what the next list, moved by its offset, holds too
            want = term * self.n + start + offset
            found = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            good = (term < 0) | (self.keys[found] == want)
            window, start = window[good], start[good]
        inside = self.owner(start) == self.owner(start + tests.lengths[window] - 1)
        return window[inside], start[inside]

    def near(self, tests: TestTerms, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose words all stand, in order, with at most `slop` other words between neighbours: (window, first, last).

        Each place of the first word that begins such a chain is given once, with the earliest end. Words are dealt with from
        the last one back, and a place stays if the nearest staying place of the next word is within the gap: the ends of
        chains don't decrease with their places, so the nearest one also ends earliest, and no chain is lost."""
        live, _ = self._by_rarity(tests)
        none = np.zeros(0, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # staying places of the words dealt with so far, by window, and the ends of their chains
        window = place = end = none
        for offset in range(tests.grid.shape[1] - 1, -1, -1):
            has = live[tests.lengths[live] > offset]
            which, own = self._list(tests.grid[has, offset])
            own_window = has[which]
            last = tests.lengths[own_window] == offset + 1
            key, want = window * self.n + place, own_window * self.n + own
            at = np.searchsorted(key, want, "right")
            inside = at < len(key)
            at = np.minimum(at, max(0, len(key) - 1))
            stays = inside & (window[at] == own_window) & (place[at] - own <= slop + 1) & (self.owner(place[at]) == self.owner(own)) if len(key) else np.zeros(len(own), bool)
            own_end = np.where(last, own, end[at] if len(key) else own)
            keep = last | stays
            window, place, end = own_window[keep], own[keep], own_end[keep]
            if offset == 0:
                done.append((window, place, end))
        return done[0] if done else (none, none, none)


def store_index(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The positional index of `docs` (doc_id, text), written below `folder` (a new one in the cluster's shared folder) and read back.

    One row a block of documents. Null texts have no words, null ids stay, repeated rows are entries of their own."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"

    def run(batches):
        for part in chunks(batches):
            lists = Postings(part.column(1))
            one = [pa.array([x], pa.list_(pa.int64())) for x in (part.column(0), part.column(2), pa.array(lists.counts))]
            yield pa.RecordBatch.from_arrays([*one, *[pa.array([x], pa.binary()) for x in lists.packed()]], names=[x.split()[0] for x in INDEX.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows.mapInArrow(run, INDEX).write.parquet(folder)
    return docs.sparkSession.read.schema(INDEX).parquet(folder)


def _blocks(batches: Iterator[pa.RecordBatch], tests: TestTerms) -> Iterator[tuple[pa.RecordBatch, BlockIndex]]:
    """(doc_id and row_key of each document, lists of the test terms) of each row of a stored index."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, keys, counts = (batch.column(k)[i].values for k in range(3))
            lists = Postings.unpacked(counts.to_numpy(), *[batch.column(k)[i].as_py() for k in range(3, 6)])
            yield pa.RecordBatch.from_arrays([ids, keys], names=["doc_id", "row_key"]), BlockIndex(lists, tests)


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int, nameless: bool = False) -> Iterator[list[tuple[str | None, str]]]:
    """The test items in blocks of at most `limit` bytes (or one item), streamed partition by partition; `nameless` takes those without an id too."""
    block, size = [], 0
    own = items.select(F.col(item_id).cast("string").alias("i"), filled(text).alias("t")).where(F.lit(nameless) | F.col("i").isNotNull())
    for row in own.toLocalIterator():
        n = len(row.t.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield block


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block_bytes: int = ITEM_BLOCK_BYTES, nameless: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Every phrase match (kind ``phrase``) and, if `slop` is given, proximity match (kind ``near``): word positions, end exclusive.

    Null texts have no words; an item without an id counts only if `nameless`, with a null item_id; no items or no documents give no rows.
    `index` is a stored index of `docs` to use again."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, "item_id", "text", block_bytes, nameless):
        sent = spark.sparkContext.broadcast(block)
        index = store_index(docs) if index is None else index

        def run(batches, sent=sent):
            tests = TestTerms(sent.value, window)
            for rows, lists in _blocks(batches, tests):
                starts = lists.ends - lists.counts
                found = []
                w, s = lists.phrases(tests)
                found.append(("phrase", w, s, s + tests.lengths[w]))
                if slop is not None:
                    w, s, e = lists.near(tests, slop)
                    found.append(("near", w, s, e + 1))
                for kind, w, s, e in found:
                    own = lists.owner(s)
                    pairs = [(k, tests.names[i]) for k, x in enumerate(w) for i in tests.owners[x]]
                    k = np.array([x for x, _ in pairs], np.int64)
                    if len(k):
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own[k])), pa.array([x for _, x in pairs], pa.string()), pa.array([kind] * len(k)), pa.array((s - starts[own])[k], pa.int32()), pa.array((e - starts[own])[k], pa.int32())], names=["doc_id", "item_id", "kind", "start", "stop"])

        found = index.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def _digest(names: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in names if x is not None)).encode()).hexdigest()


def _hits(lists: BlockIndex, tests: TestTerms) -> tuple[np.ndarray, list[set[str | None]]]:
    """Which positions of the block are covered by windows, and the items that occur in each document."""
    w, s = lists.phrases(tests)
    hit = np.zeros(int(lists.ends[-1]) + 1 if len(lists.ends) else 1, np.int32)
    np.add.at(hit, s, 1)
    np.add.at(hit, s + tests.lengths[w], -1)
    names: list[set[str | None]] = [set() for _ in lists.counts]
    for own, x in zip(lists.owner(s).tolist(), w.tolist()):
        names[own].update(tests.names[i] for i in tests.owners[x])
    return np.cumsum(hit[:-1]) > 0, names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES, nameless: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items_sha256, contaminated.

    An item with fewer words than the window is one window; one without words never occurs. With `nameless`, items without an id
    hit too: n_items counts them as one together, and the digest is that of the ids. One block of items (the usual case) is
    one pass over the index without a shuffle; with more, the blocks' hits are joined per row. Rows are told apart by a hash of
    doc_id and text, so repeated rows get the same answer each. Very long texts are searched whole; no rows give none; other columns
    are ignored. `index` is a stored index of `docs` to use again."""
    spark = docs.sparkSession
    index = store_index(docs) if index is None else index
    blocks = item_blocks(items, "item_id", "text", block_bytes, nameless)
    first, second = next(blocks, []), next(blocks, None)

    def scan(block, alone: bool):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            tests = TestTerms(sent.value, window)
            for rows, lists in _blocks(batches, tests):
                covered, names = _hits(lists, tests)
                if alone:
                    total = np.concatenate(([0], np.cumsum(covered)))
                    n_hit = total[lists.ends] - total[lists.ends - lists.counts]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lists.counts), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([_digest(x) for x in names]), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    bits = [np.packbits(covered[e - n : e]).tobytes() for e, n in zip(lists.ends.tolist(), lists.counts.tolist())]
                    yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(0), pa.array(lists.counts), pa.array(bits, pa.binary()), pa.array([list(x) for x in names], pa.list_(pa.string()))], names=["row_key", "doc_id", "n_words", "hits", "items"])

        return index.mapInArrow(run, COUNTS if alone else REPORT)

    if second is None:
        return scan(first, True)
    parts = scan(first, False).unionByName(scan(second, False))
    for block in blocks:
        parts = parts.unionByName(scan(block, False))

    def merge(key, group):
        hits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("hits")], axis=0)
        names = {x for own in group.column("items").to_pylist() for x in own}
        n_hit = int(np.unpackbits(hits).sum())
        return pa.table({"row_key": [key[0].as_py()], "n_words": [group.column("n_words")[0].as_py()], "n_hit": [n_hit], "n_items": [len(names)], "items_sha256": [_digest(names)], "contaminated": [n_hit > 0]})

    each = parts.groupBy("row_key").applyInArrow(merge, "row_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    own = index.select(F.inline(F.arrays_zip("doc_ids", "row_keys"))).toDF("doc_id", "row_key")
    return own.join(each, "row_key").drop("row_key")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, nameless: bool = False, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of an item occurs; null texts stay. `nameless`: of items without an id too.

    The lists of a block are searched where its rows are, as soon as they are made, so nothing is stored. Null and wordless items
    drop nothing; repeated rows stay or go together; no items leave `docs` as it is; columns may be called anything."""
    kept = docs
    for block in item_blocks(items, "item_id", "text", block_bytes, nameless):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def start(sent=sent):
            tests = TestTerms(sent.value, window)

            def clean(texts):
                lists = BlockIndex(Postings(texts), tests)
                stays = np.ones(len(texts), bool)
                stays[lists.owner(lists.phrases(tests)[1])] = False
                return stays

            return clean

        kept = where_text(kept, start)
    return kept
