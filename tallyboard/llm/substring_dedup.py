"""Substring dedup: words covered by a window of words that also starts in an earlier document are removed.

Each shard (see `segments`) holds a compressed FM-index over the words of its distinct segments: the Burrows-Wheeler
transform as a wavelet matrix of packed bit vectors with rank counts. The segments are streamed against it by backward
search, all windows at once; a window's matching statistic counts up to the threshold, and a window whose range in the
index has shrunk to itself stops early. Windows whose range holds an earlier document are reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyboard.llm.common import Words, chunks, mix, packed_order, raw_bytes
from tallyboard.llm.segments import _slices, merged, with_repeated_spans

WINDOW = 13
GRAM = 5


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1])).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(low)


class FMIndex:
    """Backward search over numbers below `sigma`; the text ends with 0, which no pattern holds. Suffixes are ordered by `depth` numbers at least, enough for patterns shorter than that.

    What stays is the wavelet matrix, log2(sigma) bits and their counts for each place, and a 32-bit label for each suffix, by
    rank; the order itself and the text are given up."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, labels: np.ndarray | None = None):
        order = self._order(text, depth)
        self.labels = None if labels is None else labels.astype(np.uint32)[order]
        bwt = text[order - 1].astype(np.int32)
        del order
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((bwt >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(len(bit) - int(bit.sum()))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        symbols = np.arange(sigma)
        self.base = self._walk(symbols, np.zeros(sigma, np.int64))

    @staticmethod
    def _order(text: np.ndarray, depth: int) -> np.ndarray:
        rank, step, n = text, 1, len(text)
        bits = int(n).bit_length()
        order = packed_order((rank, bits))
        while step < depth:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - step)] = rank[step:] + 1
            order = packed_order((rank, bits), (behind, bits))
            a, b = rank[order], behind[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            step *= 2
        return order

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i).astype(np.int64)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of symbol + pattern from the pattern's ranges."""
        both = self._walk(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        first = self.below[symbol] - self.base[symbol]
        return first + both[: len(lo)], first + both[len(lo) :]


def repeated_words(segments: pa.Array, owners: np.ndarray, window: int = WINDOW):
    """Spans of words covered by windows that also start in a segment with a smaller owner."""
    words = Words(segments.cast(pa.large_binary()).view(pa.large_string()))
    sizes = words.counts
    none = np.zeros(0, np.int64)
    if not len(words.codes):
        return none, none, none, sizes
    # one separator (0) behind each segment
    own = words.owners()
    text = np.zeros(len(words.codes) + len(sizes), np.int64)
    place = np.arange(len(words.codes)) + own
    text[place] = words.codes + 1
    # documents by their order
    _, number = np.unique(owners, return_inverse=True)
    owner = np.zeros(len(text), np.uint32)
    owner[place] = number[own]
    sigma = len(words.dictionary) + 1
    index = FMIndex(text, sigma, window + 1, owner)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(own))
    start = place[left >= window]
    symbol = text[start + window - 1]
    lo, hi = index.below[symbol], index.below[symbol + 1]
    for k in range(window - 2, -1, -1):
        live = hi - lo > 1
        start, lo, hi = start[live], lo[live], hi[live]
        if not len(start):
            return none, none, none, sizes
        lo, hi = index.back(text[start + k], lo, hi)
    ranges, which = np.unique(lo, return_inverse=True)
    ends = np.empty(len(ranges), np.int64)
    ends[which] = hi
    by_rank = np.append(index.labels, np.uint32(0))
    least = np.minimum.reduceat(by_rank, np.stack((ranges, ends), axis=1).ravel())[::2]
    hit = np.sort(start[least[which] < owner[start]])
    seg = np.searchsorted(np.cumsum(sizes + 1), hit, "right")
    begin = (np.cumsum(sizes + 1) - sizes - 1)[seg]
    a, b, g = merged(hit - begin, hit - begin + window, seg)
    return g, a, b, sizes


def word_count(segments: pa.Array) -> np.ndarray:
    """Words of segments as `word_tokens` cuts them, one blank after each."""
    return pc.count_substring(segments, b" ").to_numpy(zero_copy_only=False).astype(np.int64)


def word_tokens(texts: pa.Array):
    words = Words(texts)
    hashes = words.hashes()
    flat, at = raw_bytes(words.flat)

    def grams(a: int, b: int) -> np.ndarray:
        h = hashes[a:b].copy()
        for k in range(1, GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[a + k : b + k]
        return mix(h)

    def slicer(start: np.ndarray, stop: np.ndarray) -> pa.Array:
        # words behind each other with one blank after each
        n = len(words.flat)
        spaced = np.full(len(flat) + n, 32, np.uint8)
        spaced[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(at))] = flat
        edge = at + np.arange(n + 1)
        return _slices(spaced, edge[start], edge[stop] - edge[start])

    return words.counts, grams, slicer


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text and removed: array of [start, stop) spans of words (``[^\\x20\\x09-\\x0D]+``) covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Windows are judged on the input. Null texts have no words; a null doc_id sorts last; rows with one doc_id are one
    document's rows and never remove each other. Texts with fewer words than the window lose nothing."""
    found = with_repeated_spans(docs, window, GRAM, word_tokens, lambda s, o: repeated_words(s, o, window), word_count)

    def run(batches):
        for part in batches:
            spans = [np.frombuffer(s, np.int32).reshape(-1, 2) if s else [] for s in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([[{"start": int(a), "stop": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "text", "removed"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, removed array<struct<start: int, stop: int>>")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, under the rules of `repeated_spans`."""
    found = with_repeated_spans(docs, window, GRAM, word_tokens, lambda s, o: repeated_words(s, o, window), word_count)

    def run(batches):
        for part in chunks(batches):
            n_words, removed, digest = [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = text.encode().split()
                pairs = np.frombuffer(spans, np.int32).reshape(-1, 2).tolist() if spans else []
                kept, at = [], 0
                for a, b in pairs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


