r"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of text measures. The weights maximise the likelihood of preference pairs (a
document labelled 1 beats one labelled 0): logistic loss on feature differences. The threshold is a quantile of the training
documents' strengths, the labelled share of rejects; scores are shifted so that it becomes the given score.

Labels are learned from a bounded sample (`SAMPLE` labelled rows, those with the smallest hashes of their ids); ids, language,
source and labels are never inputs. Every text is scored as a whole, inside the tasks, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import Words, chunks, filled, raw_bytes, where_text

SAMPLE = 6000
PAIRS = 60_000
THRESHOLD = 0.3
FOLDS = 5

#: Byte classes that are counted per text.
CLASSES = {"symbol": b"#*$%&|<>@\\^~={}[]", "bang": b"!?", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "pause": b".,;:", "line": b"\n", "bar": b"|", "high": bytes(range(128, 256))}


def features(texts: pa.Array) -> np.ndarray:
    """One row of measures per text; texts without words have zeros."""
    data, at = raw_bytes(texts)
    words = Words(texts)
    n = words.counts.astype(float)
    per_word, size = np.maximum(n, 1), np.maximum(np.diff(at), 1)
    count = {}
    for name, members in CLASSES.items():
        mask = np.zeros(256, np.uint8)
        mask[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
        count[name] = (total[at[1:]] - total[at[:-1]]).astype(float)
    letters = np.maximum(count["upper"] + count["lower"] + count["high"], 1)
    own = words.owners().astype(np.uint64)

    def distinct(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        pairs = np.sort((owner << np.uint64(32)) | codes.astype(np.uint64))
        new = np.concatenate(([True], pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, bool)
        return np.bincount((pairs[new] >> np.uint64(32)).astype(np.int64), minlength=len(n)).astype(float)

    vocabulary = distinct(words.codes, own)
    same_next = np.zeros(len(n))
    if len(words.codes) > 1:
        again = (words.codes[1:] == words.codes[:-1]) & (own[1:] == own[:-1])
        same_next = np.bincount(own[1:][again].astype(np.int64), minlength=len(n)).astype(float)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(float)
    line_codes = pc.list_flatten(lines).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_kinds = distinct(line_codes, np.repeat(np.arange(len(n)), n_lines.astype(np.int64)).astype(np.uint64))
    length = (np.diff(at) - count["line"]) / per_word
    shares = [count["symbol"] / per_word, count["bang"] / per_word, count["bar"] / per_word, count["digit"] / size, count["upper"] / letters, 1 - vocabulary / per_word, same_next / per_word, 1 - line_kinds / np.maximum(n_lines, 1)]
    out = [np.log1p(n), np.log1p(n) ** 2, length, np.abs(length - 6), count["pause"] / per_word, *shares, *[np.sqrt(x) for x in shares], (1 - vocabulary / per_word) / np.maximum(np.log1p(n), 1)]
    return np.where(n[:, None] > 0, np.stack(out, axis=1), 0.0)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """Strengths as numbers between 0 and 1; `threshold` stands at the cut."""
        s = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.cut + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-4, rounds: int = 30) -> Ranker:
    """Newton steps on the pairwise logistic loss. Without both labels all weights are 0 and every text scores above the threshold."""
    width = x.shape[1] if x.ndim == 2 else 0
    if not len(x):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / spread, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, spread, np.zeros(width), -1.0)
    rng = np.random.default_rng(0)
    d = z[rng.choice(good, pairs)] - z[np.resize(rng.permutation(bad), pairs)]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (p - 1) / pairs + penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    # between the last strength that the quantile rejects and the first that it keeps
    s = np.sort(z @ w)
    k = min(max(1, round(len(s) * len(bad) / len(label))), len(s) - 1)
    return Ranker(mean, spread, w, float((s[k - 1] + s[k]) / 2))


def fold(column: str = "doc_id"):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fits on labelled rows outside fold 0. The sample of (id, label) pairs is bounded by `sample`, so it may be broadcast and collected;
    of several texts with one id the smallest is taken, and rows that repeat count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(sample)

    def run(batches):
        for part in chunks(batches):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], names=["x", "quality"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality").mapInArrow(run, "x array<double>, quality int").toPandas()
    if not len(rows):
        width = features(pa.array([""])).shape[1]
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    x, y = np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy()
    order = np.lexsort((y, *x.T))  # the rows come in any order; the fit shall not depend on it
    return fit(x[order], y[order])


def scored(docs: DataFrame, ranker: Ranker, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts get the score of a text without words, very long ones are scored whole; a null doc_id
    is never held out; repeated rows are answered one by one; no rows give none; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for part in chunks(batches):
            s = sent.value.score(features(part.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), filled().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score at or above the threshold; null and empty texts as `scored` scores them, repeated rows alike."""
    sent = docs.sparkSession.sparkContext.broadcast(ranker)
    return where_text(docs, lambda: lambda texts: sent.value.score(features(texts), threshold) >= threshold)
