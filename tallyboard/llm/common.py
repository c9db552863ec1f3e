"""What the corpus operators share: table access, Arrow chunks, word splitting and lineage cuts.

Rules that hold for every operator here:

* a null ``text`` is an empty text; a null ``doc_id`` is kept and sorts after every other id;
* rows that repeat are answered one by one, never merged away;
* extra columns of the input are ignored unless an operator says that it passes rows through.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id takes this place in the order of documents.
NO_ID = 2**63 - 1
#: Bytes of text that one step inside a task works on at a time.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key partitions of packed exchanges for each shuffle partition of the session: numpy holds one of them as a whole.
FINER = 3


def shuffle_width(spark: SparkSession) -> int:
    """Partitions by document that packed exchanges use: the session's own setting, which grows with the input on a cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between steps, which all executors see: the one that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (as in tests) gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes until no column of `df` is called so, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hashed(text: Column) -> Column:
    """32 bits of the MD5 of a string, as a number."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")


def ordered_id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def filled(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of `column` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def where_text(docs: DataFrame, start: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of `docs`, all columns, whose texts pass. start() runs once a task and makes the test, which gets some texts (never null)
    and gives a boolean for each. Texts go to Python and booleans come back; rows stay where they are."""

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = start()
        for texts in batches:
            parts = [pa.array(test(part.column(0)), pa.bool_()) for part in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(passes(filled()))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.dtype("<i8" if pa.types.is_large_string(texts.type) else "<i4")
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words:
    """White-space words ([^\\x20\\x09-\\x0D]+) of a column of texts: dictionary, codes, and counts per text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not some.all():
            # a text without words gives one empty word
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner[some], minlength=len(counts)).astype(np.int64)
            flat = flat.filter(pa.array(some))
        self.flat, self.counts = flat, counts
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionary = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        one = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in self.dictionary.cast(pa.binary())), np.uint64, len(self.dictionary))
        return one[self.codes] if len(one) else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


#: Separators become blanks and A-Z lower case; what is left are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: A-Z in lower case, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def translated(texts: pa.Array, to: bytes) -> pa.Array:
    """Each byte of the texts replaced by the table; the tables map ASCII to ASCII, so the result is UTF-8 again."""
    data, at = raw_bytes(texts)
    moved = data.tobytes().translate(to)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(moved)])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the bits of uint64 keys."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose i-th value holds the items data[ends[i-1]:ends[i]]."""
    at = np.concatenate(([0], ends)).astype(np.int64) * data.dtype.itemsize
    values = np.ascontiguousarray(data)
    if at[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])
    return pa.array([values[a:b].tobytes() for a, b in zip(at[:-1] // data.dtype.itemsize, at[1:] // data.dtype.itemsize)], pa.binary())


def unpacked(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of all values of a binary column behind each other, and the number of items of each value."""
    parts = [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.zeros(0, dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], np.int64)


def packed_order(*fields: tuple[np.ndarray, int]) -> np.ndarray:
    """Stable order by the fields, each (non-negative values, bits). Fields that fit one word with the position are sorted as that word."""
    n = len(fields[0][0])
    place = max(1, int(n).bit_length())
    if sum(bits for _, bits in fields) + place > 64:
        return np.lexsort([x for x, _ in reversed(fields)])
    word = np.zeros(n, np.uint64)
    for x, bits in fields:
        word = (word << np.uint64(bits)) | x.astype(np.uint64)
    word = np.sort((word << np.uint64(place)) | np.arange(n, dtype=np.uint64))
    return (word & np.uint64((1 << place) - 1)).astype(np.int64)


def key_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of hashed keys of `bits` bits: by their upper bits and position as one word; the few ties of unequal keys are mended."""
    n = len(keys)
    place = max(1, int(n).bit_length())
    lost = max(0, bits + place - 64)
    upper = keys >> np.uint64(lost)
    order = packed_order((upper, bits - lost))
    if lost and n > 1:
        top, k = upper[order], keys[order]
        for at in np.unique(top[1:][(top[1:] == top[:-1]) & (k[1:] != k[:-1])]):
            a, b = np.searchsorted(top, [at, at + np.uint64(1)])
            order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
    return order
