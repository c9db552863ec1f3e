"""Writes with merge semantics (inventory U): a keyed full outer join rebuilds the target, then a new snapshot folder is switched to."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.operators.blocks import cut
from tallyboard.operators.tables import BucketedTable
from tallyboard.operators.windows import latest_per_key


def upsert_jobs(stored: DataFrame, incoming: DataFrame, emitted: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """`stored` after `incoming`: equal hash touches last_seen_at and is_active only; another hash overwrites what the source emits, even with null; new ids are inserted; the rest stays.

    Several incoming rows of one id count as applied one after the other in `order` (default last_seen_at)."""
    last = latest_per_key(incoming, ["job_id"], order or [F.col("last_seen_at"), F.col("content_hash")])
    columns = stored.columns
    new = last.select("job_id", *[F.col(c).alias(f"_{c}") for c in columns if c != "job_id" and c in last.columns], F.lit(True).alias("_in"))
    both = stored.withColumn("_old", F.lit(True)).join(new, "job_id", "full_outer")
    here, there = F.col("_in").isNotNull(), F.col("_old").isNotNull()
    same = here & there & F.col("content_hash").eqNullSafe(F.col("_content_hash"))
    touched, out = ("last_seen_at", "is_active"), []
    for c in columns:
        if c == "job_id":
            out.append(F.col(c))
        elif c == "is_active":
            out.append(F.when(here & there, True if c not in last.columns else F.when(same, True).otherwise(F.col("_is_active"))).when(here, F.col("_is_active") if c in last.columns else F.lit(True)).otherwise(F.col(c)).alias(c))
        elif c not in last.columns:
            out.append(F.col(c))
        else:
            take = here & ~there if c not in emitted and c not in touched else here & (~same | F.lit(c in touched))
            out.append(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], set_columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`target` with the changes' columns set on equal keys, and new keys inserted (other columns null).

    Changes of one key count as applied one after the other in `order`, which should tell them apart: the last one stays."""
    last = latest_per_key(changes, keys, order)
    new = last.select(*keys, *[F.col(c).alias(f"_{c}") for c in set_columns], F.lit(True).alias("_in"))
    both = target.join(new, list(keys), "full_outer")
    return both.select(*[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in set_columns else F.col(c) for c in target.columns])


def upsert_rejected(stored: DataFrame, rejected: DataFrame) -> DataFrame:
    return upsert(stored, rejected, ["content_hash"], ["title", "company", "rejected_at", "reason"], [F.col("rejected_at"), F.col("reason")])


def merge_jobs(table: BucketedTable, incoming: DataFrame, emitted: Sequence[str], batch: int | None = None, counts: BucketedTable | None = None, stored: bool = False) -> list[int]:
    """`upsert_jobs` into a bucketed table by job_id: only the buckets of incoming ids are read and rewritten; returns them. `stored`: the
    incoming rows are a stored table's, and needn't be kept from being computed again.

    With `counts` (company, active_jobs), the number of each company's active jobs is kept up to date by what the merge changes."""
    if table.has(batch):
        return []
    incoming = incoming if stored else cut(incoming)
    if counts is not None:
        # first, from the table as it was: if this dies in between, the batch is found to be counted, and the table takes it
        merge_counts(counts, active_deltas(table.touched(incoming), incoming, emitted), batch)
    return table.merge(incoming, lambda stored: upsert_jobs(stored, incoming, emitted), batch)


def active_deltas(stored: DataFrame, incoming: DataFrame, emitted: Sequence[str]) -> DataFrame:
    """(company, delta): what `upsert_jobs` does to the number of each company's active jobs, from signed rows of the incoming ids; zeros are left out."""
    ids = incoming.select("job_id").distinct()
    before = stored.join(ids, "job_id", "left_semi")
    after = upsert_jobs(before, incoming, emitted)
    signed = before.where("is_active").select("company", F.lit(-1).alias("n")).unionByName(after.where("is_active").select("company", F.lit(1).alias("n")))
    return signed.groupBy("company").agg(F.sum("n").alias("delta")).where("delta <> 0")


def merge_counts(counts: BucketedTable, deltas: DataFrame, batch: int | None = None) -> list[int]:
    """Adds (company, delta) to the stored (company, active_jobs); companies without active jobs stay with 0. A null company is one of its own."""
    deltas = cut(deltas)

    def added(stored: DataFrame) -> DataFrame:
        both = stored.select("company", "active_jobs").unionByName(deltas.select("company", F.col("delta").alias("active_jobs")))
        return both.groupBy("company").agg(F.sum("active_jobs").alias("active_jobs"))

    return counts.merge(deltas, added, batch)


def count_active(jobs: DataFrame) -> DataFrame:
    """(company, active_jobs) of every company of `jobs`: what the stored counts begin with, and what they must equal."""
    return jobs.groupBy("company").agg(F.count_if("is_active").alias("active_jobs"))


def apply_decisions(requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their status after decisions (request_id, action), new companies of approved pending ones)."""
    out = requests.join(decisions.select("request_id", "action"), "request_id", "left")
    open_ = F.col("status") == "pending"
    approved = out.where(open_ & (F.col("action") == "approve")).select("name", "careers_url", F.lit("unknown").alias("ats_type"), F.lit(True).alias("is_active"))
    status = F.when(open_ & (F.col("action") == "approve"), "approved").when(open_ & (F.col("action") == "reject"), "rejected").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("action"), approved


def touch(target: DataFrame, keys: DataFrame, on: Sequence[str], column: str, ts: str) -> DataFrame:
    mark = keys.select(*on).distinct().withColumn("_t", F.lit(True))
    return target.join(mark, list(on), "left").withColumn(column, F.when(F.col("_t"), F.lit(ts).cast("timestamp")).otherwise(F.col(column))).drop("_t")


def company_record(rows: DataFrame, confidence: float = 1.0, frequency_hours: int = 12, priority: int = 5, tags: Sequence[str] = ()) -> DataFrame:
    """Company rows (name, domain, ats_type, ats_url, location) as full records with defaults."""
    tag_list = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    return rows.select(
        "name", "domain", F.concat(F.lit("https://"), F.col("domain"), F.lit("/careers")).alias("careers_url"), "ats_url",
        F.struct(F.coalesce("ats_type", F.lit("unknown")).alias("type"), F.when(F.col("ats_type").isNotNull(), confidence).otherwise(0.5).alias("confidence")).alias("ats_system"),
        F.struct(F.lit(frequency_hours).alias("frequency_hours"), F.lit(priority).alias("priority")).alias("schedule"),
        F.struct(F.lit(0).cast("long").alias("total_jobs_found"), F.lit(0).cast("long").alias("active_jobs")).alias("stats"),
        F.struct(tag_list.alias("tags"), F.lit(False).alias("verified")).alias("metadata"), "location", F.lit(True).alias("is_active"),
    )


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Folders of the whole snapshots below `path`, oldest first: those that their writer has marked as done."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(x.getPath().getParent().toString() for x in found)


def switch_snapshot(df: DataFrame, path: str, keep: int = 3) -> str:
    """Writes a new snapshot below `path`, which is the current one as soon as it is whole; what is being read is never overwritten.

    Readers of the `keep` newest ones are safe; older ones are deleted."""
    spark, name = df.sparkSession, f"{path}/snapshot-{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    for old in _snapshots(spark, path)[:-keep]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return name


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_snapshots(spark, path)[-1])
