r"""Hard-negative mining by a vertical scan of columnar vectors (BOND).

Vectors are quantised to integers. A chunk of rows lies in memory by dimension. For each anchor its dimensions are read in descending
order of the anchor's magnitude; after every `STEP` dimensions the smallest and largest products that the remaining ones can
add (from each dimension's least and greatest value in the chunk) bound every row's score, and rows that can't enter a result
any more leave the candidates. What is left at the end has its exact score.

Two passes over the rows: the first finds each anchor's positives, whose scores set the windows of the second. Anchors are a stated set
of queries: they are sent out in blocks of `ANCHOR_BYTES`, one after the other, and meet every row where it lies; a task keeps the best
few rows of each anchor and window, so what is shuffled grows with anchors and partitions, not with rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.llm.common import NO_ID, shared_folder

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
#: Bytes of anchors that are sent to all tasks at once.
ANCHOR_BYTES = 16 << 20
#: Dimensions between two looks at the bounds.
STEP = 16

FOUND = "anchor int, window int, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def relabelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding: labels of every seventh id are one further, as the query's contract asks."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a label, a vector and nothing null or non-finite in it."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)


def quantised(lists: pa.ListArray) -> np.ndarray:
    """One row of integers for each vector; shorter ones are filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Chunk:
    """Some rows by dimension. Sums up to 2**53 are exact as doubles; beyond, they are Python's integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, width: int, top: float):
        if rows.shape[1] < width:
            rows = np.concatenate((rows, np.zeros((len(rows), width - rows.shape[1]))), axis=1)
        self.ids, self.labels = ids, labels
        if top * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) >= 2.0**53:
            rows = np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)
        self.columns = np.ascontiguousarray(rows.T)
        self.low, self.high = (f(self.columns, axis=1) if rows.size else np.zeros(width) for f in (np.min, np.max))

    def scan(self, anchor: np.ndarray, rows: np.ndarray, windows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of those of `rows` that may be among the best of a window. windows: [low, high, wanted, least score that still counts]."""
        order = np.argsort(-np.abs(anchor[: len(self.columns)]).astype(float), kind="stable")
        a = anchor[order] if self.columns.dtype != object else np.array([int(x) for x in anchor[order]], object)
        each = np.stack((a * self.low[order], a * self.high[order]))
        least, most = (np.concatenate((np.cumsum(f(each, axis=0)[::-1])[::-1], [0])) for f in (np.min, np.max))
        part = np.zeros(len(rows), self.columns.dtype)
        for at in range(0, len(order), STEP):
            own = order[at : at + STEP]
            cols = self.columns[own]
            part = part + a[at : at + STEP] @ (cols if len(rows) == cols.shape[1] else cols[:, rows])
            end = min(at + STEP, len(order))
            bottom, top = part + least[end], part + most[end]
            alive = np.zeros(len(rows), bool)
            for w in windows:
                low, high, wanted, _ = w
                if high is None:
                    sure = bottom
                else:
                    sure = bottom[(top <= high) & (bottom >= low)]
                if len(sure) >= wanted:
                    w[3] = max(w[3], np.partition(sure, len(sure) - wanted)[len(sure) - wanted])
                fits = top >= w[3]
                if high is not None:
                    fits &= (bottom <= high) & (top >= low)
                alive |= fits
            if not alive.all():
                rows, part = rows[alive], part[alive]
            if not len(rows):
                break
        return rows, part


class Best:
    """The best rows so far of an anchor's windows, by score and id."""

    def __init__(self, windows: list[tuple]):
        self.windows = [[low, high, wanted, -float("inf")] for low, high, wanted in windows]
        self.scores, self.ids = [[np.zeros(0, np.int64)] * len(windows) for _ in range(2)]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = scores.astype(np.int64)
        for k, (low, high, wanted, _) in enumerate(self.windows):
            own = slice(None) if high is None else (scores >= low) & (scores <= high)
            s, i = np.concatenate((self.scores[k], scores[own])), np.concatenate((self.ids[k], ids[own]))
            order = np.lexsort((i, -s))[:wanted]
            self.scores[k], self.ids[k] = s[order], i[order]
            if len(order) == wanted:
                self.windows[k][3] = max(self.windows[k][3], int(s[order[-1]]))


def _best(rows: DataFrame, anchors: dict, windows: list[list[tuple]], same: bool) -> DataFrame:
    """(anchor, window, score, id): for each anchor (its number) and window the best rows of a partition, of the anchor's label or of others."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_windows = sent.value
        best = [Best(w) for w in own_windows]
        width, top = known["rows"].shape[1], float(np.abs(known["rows"]).max(initial=0))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = pa.compute.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
            chunk = Chunk(ids, batch.column(1).to_numpy(zero_copy_only=False), quantised(batch.column(2)), width, top)
            labels = {x: np.flatnonzero((chunk.labels == x) == same) for x in np.unique(known["labels"])}
            for n, (anchor_id, label, anchor) in enumerate(zip(known["ids"], known["labels"], known["rows"])):
                candidates = labels[label]
                if not own_windows[n] or not len(candidates):
                    continue
                if len(anchor) < len(chunk.columns):
                    anchor = np.concatenate((anchor, np.zeros(len(chunk.columns) - len(anchor))))
                if same:
                    # an anchor's own copies are counted elsewhere
                    twins = candidates[chunk.ids[candidates] == anchor_id]
                    if len(twins):
                        candidates = np.setdiff1d(candidates, twins[(chunk.columns[:, twins] == anchor[:, None]).all(axis=0)])
                found, scores = chunk.scan(anchor, candidates, best[n].windows)
                best[n].add(chunk.ids[found], scores)
        out = [(n, k, s, i) for n, b in enumerate(best) for k in range(len(b.windows)) for s, i in zip(b.scores[k].tolist(), b.ids[k].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "window", "score", "id"])

    import pyarrow.compute  # noqa: F401  pa.compute

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    own = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, block: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for some anchors (vec_id, label, embedding, copies)."""
    spark = rows.sparkSession
    lists = pa.array([r.embedding for r in block], pa.list_(pa.float64()))
    anchors = {"ids": np.array([r.vec_id for r in block], np.int64), "labels": np.array([r.label for r in block], np.int64), "rows": quantised(lists)}
    top = [[(None, None, positives)] for _ in block]
    near: list[list[tuple[int, int]]] = [[] for _ in block]
    for r in _ranked(_best(rows, anchors, top, True), positives).collect():
        near[r.anchor].append((-r.score, r.id))
    for n, r in enumerate(block):
        own = sum(int(x) ** 2 for x in anchors["rows"][n].tolist())
        near[n] = sorted(near[n] + [(-own, r.vec_id)] * min(positives, r.copies - 1))[:positives]
    # whole numbers s with low * p <= 100 * s <= high * p
    windows = [[(-(low * s // 100), -high * s // 100, negatives) for s, _ in own] for own in near]
    told = [(n, k, r.vec_id, None if i == NO_ID else i, -s, r.copies) for n, (r, own) in enumerate(zip(block, near)) for k, (s, i) in enumerate(own)]
    pairs = spark.createDataFrame(told, "anchor int, window int, anchor_id long, positive_id long, positive_score long, copies long")
    found = _ranked(_best(rows, anchors, windows, False), negatives).join(F.broadcast(pairs), ["anchor", "window"])
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("anchor_id", "positive_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `vectors` (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`; positives the first other rows of the same label by inner product of the
    vectors times 256, rounded down; negatives the first rows of other labels whose score lies between `low` and `high` percent
    of the positive's. Ties go to the smaller vec_id; null ids come last. Rows with a null label or vector, or anything null or
    non-finite in it, take no part. Shorter vectors are filled with zeros. Repeated rows are rows of their own; equal anchors are
    searched once and answered each. Scores beyond 64 bits are an error. Other columns are ignored; no rows or no anchors give none."""
    rows = usable(vectors)
    chosen = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    spark, size = rows.sparkSession, chosen.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 400), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    part = lambda b: chosen.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)) == b).orderBy("vec_id").collect()
    if blocks == 1:
        return _mined(rows, part(0), positives, negatives, low, high)
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    for b in range(blocks):
        _mined(rows, part(b), positives, negatives, low, high).write.parquet(f"{folder}/block={b}")
    return spark.read.schema(RESULT).parquet(*[f"{folder}/block={b}" for b in range(blocks)])
