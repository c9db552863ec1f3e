"""Continuous forms (inventory T): ingest, visit counts, rate limits, alerts and life cycles as Structured Streaming queries."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallyboard.operators.aggregates import merge_sketches, visitor_sketches
from tallyboard.operators.blocks import cut, delete, shared_folder
from tallyboard.operators.filters import judged as judge
from tallyboard.operators.joins import match_alerts
from tallyboard.operators.merge import merge_jobs, upsert_rejected
from tallyboard.operators.tables import BucketedTable


def stream_ingest(source: DataFrame, jobs: BucketedTable, rejected: BucketedTable, checkpoint: str, emitted: list[str], normalise: Callable[[DataFrame], DataFrame] = lambda df: df, counts: BucketedTable | None = None, **vocabularies) -> StreamingQuery:
    """Each micro-batch: normalise, set rejects aside, and merge both into the buckets that they fall into. The tables must exist, `jobs` by
    job_id, `rejected` by content_hash; `counts` (by company) holds the companies' active jobs.

    Tables remember the last batch that they merged, so a batch that is run again after a failure is merged once into each. What was
    gone through twice is the judging of its rows only. The three newest versions of a table stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, shared_folder(batch.sparkSession)
        normalise(batch).transform(judge, **vocabularies).write.parquet(path)
        judged = spark.read.parquet(path)
        bad = judged.where("reason IS NOT NULL").select("content_hash", "title", "company", F.col("scraped_at").alias("rejected_at"), "reason")
        rejected.merge(bad, lambda stored: upsert_rejected(stored, bad), number)
        merge_jobs(jobs, judged.where("reason IS NULL").drop("reason"), emitted, number, counts, stored=True)
        delete(spark, path)
        for table in (jobs, rejected, counts):
            if table is not None:
                table.vacuum()

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_visits(visits: DataFrame) -> DataFrame:
    """Visits per referrer, kept up to date (output mode complete or update)."""
    return visits.groupBy("referrer").agg(F.count(F.lit(1)).alias("visits"))


def stream_visitors(visits: DataFrame, delay: str = "1 day") -> DataFrame:
    """First visits of addresses within the watermark."""
    return visits.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["ip_address"])


def stream_visitor_sketches(visits: DataFrame, sketches: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Keeps visits and a visitor sketch for each day and referrer up to date in a table by day (`visitor_sketches`), whatever comes late.

    The visitors of any span are then a merge of its sketches; state doesn't grow with visitors. Batches that come again are left out."""

    def merge(batch: DataFrame, number: int) -> None:
        new = cut(visitor_sketches(batch))
        sketches.merge(new, lambda stored: merge_sketches(stored, new), number)
        sketches.vacuum()

    return visits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of one output batch.
PIECE = 10_000
LIMITED = "key string, ts timestamp, accepted boolean"


def _decide(times: Iterable[int], recent: list[int], limit: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Accepts an event iff fewer than `limit` accepted ones lie less than the window before it. Only the last `limit` accepted
    times matter: the earliest of them must be out of the window."""
    out = []
    for t in times:
        out.append(limit > 0 and (len(recent) < limit or t - recent[-limit] >= window_us))
        if out[-1]:
            insort(recent, t)
            del recent[:-limit]
    return out, recent


def _micros(ts: pd.Series) -> np.ndarray:
    return pd.to_datetime(ts).astype("datetime64[us]").astype("int64").to_numpy()


def rate_limit(events: DataFrame, limit: int, window_s: float) -> DataFrame:
    """Batch twin of `stream_rate_limit` over (key, ts): every event with `accepted`.

    Each decision depends on the accepted ones before it, so a key's events are taken in order; memory holds `limit` times only,
    because the rows of a key come sorted, in Arrow batches."""
    window_us = int(window_s * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent, started = None, [], False
        for pdf in batches:
            flags, times = [], _micros(pdf["ts"]).tolist()
            # runs of rows of one key
            starts = np.flatnonzero((pdf["key"] != pdf["key"].shift()).to_numpy()).tolist()
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if not started or pdf["key"].iat[a] != key:
                    key, recent, started = pdf["key"].iat[a], [], True
                ok, recent = _decide(times[a:b], recent, limit, window_us)
                flags += ok
            yield pdf.assign(accepted=flags)

    return events.select("key", "ts").repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, LIMITED)


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # eight bytes for each event of a key in a micro-batch; output in pieces
        times = np.sort(np.concatenate([_micros(r["ts"]) for r in rows]))
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        for at in range(0, len(times), PIECE):
            part = times[at : at + PIECE]
            flags, recent = _decide(part.tolist(), recent, self.limit, self.window_us)
            yield pd.DataFrame({"key": [key[0]] * len(part), "ts": part.astype("datetime64[us]"), "accepted": flags})
        self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, limit: int, window_s: float) -> DataFrame:
    """Sliding-window limiter over a stream of (key, ts); needs the RocksDB state store. Rejected events don't count."""
    return events.select("key", "ts").groupBy("key").transformWithStateInPandas(_Limiter(limit, int(window_s * 1_000_000)), LIMITED, "append", "none")


MAILED = "search_id string, last_emailed_at timestamp"


def stream_alerts(postings: DataFrame, searches: DataFrame, as_of: str, out_path: str, state_path: str, checkpoint: str, k: int | None = 10) -> StreamingQuery:
    """Each micro-batch of new postings meets the saved searches; each search's hits are one mail, its `k` newest ones or all.

    A search is not mailed older postings again: the newest posting of its last mail is its new cutoff. Mails and cutoffs of a
    batch are written under its number, so a batch that is run again after a failure replaces what it wrote."""

    def match(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MAILED).parquet(f"{state_path}/batch={number - 1}") if number else spark.createDataFrame([], MAILED)
        known = searches.join(before.withColumnRenamed("last_emailed_at", "_mailed"), searches["search_id"].cast("string") == before["search_id"], "left").drop(before["search_id"])
        current = known.withColumn("last_emailed_at", F.greatest("last_emailed_at", "_mailed")).drop("_mailed")
        match_alerts(current, batch, as_of, k).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        mailed = spark.read.parquet(f"{out_path}/batch={number}").select(F.col("search_id").cast("string").alias("search_id"), F.col("posted_date").alias("last_emailed_at"))
        mailed.unionByName(before).groupBy("search_id").agg(F.max("last_emailed_at").alias("last_emailed_at")).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return postings.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "job_id string, seen_at timestamp, event string"
SIGHTS = "job_id string, salary_min long, seen_at timestamp, is_ghost boolean"
DAY = 86_400_000_000


def _events(rows: list[tuple[str, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [x[0] for x in rows], "seen_at": np.array([x[1] for x in rows], "datetime64[us]"), "event": [x[2] for x in rows]})


#: Keys of the state: jobs or contents are dealt to so many by hash, each with one value that holds all of its own. A key of its own for
#: each would cost several calls to the state store and pandas frames of a few rows.
STATE_KEYS = 1024


def _state_key(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(STATE_KEYS)).cast("int")


class _Twins(StatefulProcessor):
    """Per content: whether the sight before was another job's, at most `gap` days ago. The last sight is kept for so long and no longer."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "contents array<string>, jobs array<string>, seen array<long>")

    def _ends(self, seen: int) -> int:
        return (seen // DAY + self.gap + 1) * (DAY // 1000)

    def _known(self) -> dict[str | None, tuple[str | None, int]]:
        known = self.last.get()
        return {c: (job, us) for c, job, us in zip(*known)} if known else {}

    def _keep(self, known: dict[str | None, tuple[str | None, int]]) -> None:
        if not known:
            self.last.clear()
            return
        self.last.update((list(known), [x[0] for x in known.values()], [x[1] for x in known.values()]))
        # earlier timers stay and find what is still held
        self.handle.registerTimer(min(self._ends(x[1]) for x in known.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # what a micro-batch has of these contents, in order of time and job
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["seen_at", "job_id"], kind="stable", ignore_index=True)
        known, ghosts = self._known(), []
        for content, job, us in zip(pdf["content_key"].tolist(), pdf["job_id"].tolist(), _micros(pdf["seen_at"]).tolist()):
            last, seen = known.get(content, (None, None))
            ghosts.append(last is not None and last != job and us // DAY - seen // DAY <= self.gap)
            known[content] = (job, us)
        self._keep(known)
        yield pdf.assign(is_ghost=ghosts)[["job_id", "salary_min", "seen_at", "is_ghost"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, known = _until(timerValues, expiredTimerInfo), self._known()
        held = {c: x for c, x in known.items() if self._ends(x[1]) > now}
        if len(held) < len(known):
            self._keep(held)
        yield from ()

    def close(self) -> None:
        pass


def _until(timerValues, expiredTimerInfo) -> int:
    """The last millisecond whose timers have expired."""
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)


class _Lifecycle(StatefulProcessor):
    """Per job: first sight, higher pay, and silence longer than the time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "jobs array<string>, pay array<long>, seen array<long>")

    def _known(self) -> dict[str | None, tuple[int | None, int]]:
        known = self.last.get()
        return {job: (pay, us) for job, pay, us in zip(*known)} if known else {}

    def _keep(self, known: dict[str | None, tuple[int | None, int]]) -> None:
        if not known:
            self.last.clear()
            return
        self.last.update((list(known), [x[0] for x in known.values()], [x[1] for x in known.values()]))
        # earlier timers stay and find that the jobs were seen again
        self.handle.registerTimer(min(x[1] for x in known.values()) // 1000 + self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["job_id"].to_numpy(dtype=object), _micros(r["seen_at"]), r["salary_min"].to_numpy(dtype=float, na_value=np.nan), r["is_ghost"].to_numpy(dtype=bool)) for r in rows]
        ids, times, pays, ghosts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(times, kind="stable")
        known, out = self._known(), []
        for job, us, amount, ghost in zip(ids[order].tolist(), times[order].tolist(), pays[order].tolist(), ghosts[order].tolist()):
            pay, seen = known.get(job, (None, None))
            amount = None if amount != amount else int(amount)
            if seen is not None and us - seen > self.ttl_ms * 1000:
                # silent for too long, whether or not its timer has gone off
                out.append((job, seen, "delisted"))
                pay, seen = None, None
            if seen is None:
                out.append((job, us, "ghost_repost" if ghost else "new"))
            elif pay is not None and amount is not None and amount > pay:
                out.append((job, us, "salary_bump"))
            known[job] = (amount, max(us, seen or us))
        self._keep(known)
        if out:
            yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, known = _until(timerValues, expiredTimerInfo), self._known()
        gone = [(job, x[1], "delisted") for job, x in known.items() if x[1] // 1000 + self.ttl_ms <= now]
        if gone:
            for job, *_ in gone:
                del known[job]
            self._keep(known)
            yield _events(gone)

    def close(self) -> None:
        pass


def stream_lifecycle(snapshots: DataFrame, ttl_hours: float, delay: str = "1 hour", gap_days: int = 7) -> DataFrame:
    """Events of jobs (job_id, salary_min, seen_at, and content_key if it has one): new, ghost_repost, salary_bump, delisted after `ttl_hours`
    unseen; needs the RocksDB state store.

    Two stateful stages, each keyed by a hash of what it looks at: with a content_key, the first one marks sights whose content another job
    showed at most `gap_days` days before; the second one follows each job, and a first sight that is marked is a ghost
    repost. Sights must come in order of time within the delay."""
    rows = snapshots.withWatermark("seen_at", delay)
    if "content_key" in snapshots.columns:
        rows = rows.select(_state_key("content_key").alias("_key"), "content_key", "job_id", "salary_min", "seen_at").groupBy("_key").transformWithStateInPandas(_Twins(gap_days), SIGHTS, "append", "eventTime", eventTimeColumnName="seen_at")
    else:
        rows = rows.select("job_id", "salary_min", "seen_at", F.lit(False).alias("is_ghost"))
    return rows.withColumn("_key", _state_key("job_id")).groupBy("_key").transformWithStateInPandas(_Lifecycle(int(ttl_hours * 3_600_000)), EVENTS, "append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
