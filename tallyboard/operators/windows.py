"""Order, pages, top-k and histories (inventory W). Every limit has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.functions import presets


def page(df: DataFrame, order: Sequence[Column | str], skip: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    return df.orderBy(*order).offset(skip).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def rank_companies(companies: DataFrame) -> DataFrame:
    """Most active jobs first, then by name; `silent` where there are none."""
    jobs = F.coalesce("active_jobs", F.lit(0))
    return companies.withColumn("silent", jobs == 0).orderBy(jobs.desc(), F.coalesce("name", F.lit("")))


def top_matches(scored: DataFrame, least: float = 5.0, k: int = 15) -> DataFrame:
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), F.col("posted_date").desc(), "job_id").limit(k)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, with `rank`; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no, line): of numbered items with one name, whatever its case, the first stays; all other lines stay."""
    name = F.lower(F.trim(F.regexp_extract("line", presets.NUMBERED, 1)))
    keyed = lines.withColumn("_name", name)
    first = top_k_per(keyed.where("_name <> ''"), ["_name"], ["line_no"], 1).drop("rank")
    return first.unionByName(keyed.where("_name = ''")).drop("_name")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key: rows applied one after the other leave that one."""
    return top_k_per(df, keys, [c.desc() for c in order], 1).drop("rank")


def sample_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 3) -> DataFrame:
    return top_k_per(df, keys, order, k).drop("rank")


def reverse_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.col("line_no").desc())


def latest_n(df: DataFrame, ts: str, tie: str, k: int, pending_only: bool = False) -> DataFrame:
    rows = df.where(F.col("status") == "pending") if pending_only else df
    return rows.orderBy(F.col(ts).desc(), tie).limit(k)


def enforce_quota(df: DataFrame, key: str, created: str, tie: str, k: int = 5) -> DataFrame:
    """The first k rows that a user made."""
    return top_k_per(df, [key], [created, tie], k).drop("rank")


def lifecycle(snapshots: DataFrame, gap_days: int = 7) -> DataFrame:
    """(job_id, seen_at, event) of snapshots (job_id, content_key, salary_min, seen_at): new, salary_bump, ghost_repost, delisted.

    A ghost repost is a new id whose content another id showed at most `gap_days` before. A job that the latest snapshot lacks is delisted at its last sight."""
    own, twin = W.partitionBy("job_id").orderBy("seen_at"), W.partitionBy("content_key").orderBy("seen_at", "job_id")
    rows = snapshots.withColumns({"_no": F.row_number().over(own), "_pay": F.lag("salary_min").over(own), "_twin": F.lag("job_id").over(twin), "_twin_at": F.lag("seen_at").over(twin)})
    near = F.col("_twin").isNotNull() & (F.col("_twin") != F.col("job_id")) & (F.datediff("seen_at", "_twin_at") <= gap_days)
    event = F.when((F.col("_no") == 1) & near, "ghost_repost").when(F.col("_no") == 1, "new").when(F.col("salary_min") > F.col("_pay"), "salary_bump")
    seen = rows.withColumn("event", event).where(F.col("event").isNotNull()).select("job_id", "seen_at", "event")
    latest = snapshots.agg(F.max("seen_at").alias("_latest"))
    last = snapshots.groupBy("job_id").agg(F.max("seen_at").alias("seen_at"))
    gone = last.join(F.broadcast(latest), F.col("seen_at") < F.col("_latest")).select("job_id", "seen_at", F.lit("delisted").alias("event"))
    return seen.unionByName(gone)


def staleness(jobs: DataFrame, runs: DataFrame, as_of: str, months: int = 4, misses: int = 3) -> DataFrame:
    """job_id with `old` (open longer than `months`) and `archive` (not seen in the last `misses` runs of its source)."""
    order = W.partitionBy("source").orderBy(F.col("run_at").desc())
    limit = runs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == misses).select("source", F.col("run_at").alias("_since"))
    old = F.col("posted_date") < F.add_months(F.lit(as_of).cast("date"), -months)
    return jobs.join(limit, "source", "left").select("job_id", F.coalesce(old, F.lit(False)).alias("old"), F.coalesce(F.col("last_seen_at") < F.col("_since"), F.lit(False)).alias("archive"))


def weekly_reposts(jobs: DataFrame, keys: Sequence[str] = ("company", "title"), least: int = 3) -> DataFrame:
    """keys, weekday (1 is Sunday), first_week (its first day) and weeks of roles posted on one weekday in `least` or more consecutive weeks."""
    day = F.col("posted_date").cast("date")
    weeks = jobs.where(day.isNotNull()).select(*keys, F.dayofweek(day).alias("weekday"), day.alias("_day")).distinct()
    own = W.partitionBy(*keys, "weekday").orderBy("_day")
    islands = weeks.withColumn("_start", F.date_add("_day", -7 * F.row_number().over(own)))
    # days of consecutive weeks lead back to one start
    runs = islands.groupBy(*keys, "weekday", "_start").agg(F.min("_day").alias("first_week"), F.count(F.lit(1)).alias("weeks"))
    return runs.where(F.col("weeks") >= least).drop("_start")


def list_status(collections: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """`collections` with expiry_date (`months` after created_at, unless it has one) and status: archived from that day on, else active."""
    own = F.col("expiry_date").cast("date") if "expiry_date" in collections.columns else F.lit(None).cast("date")
    df = collections.withColumn("expiry_date", F.coalesce(own, F.add_months(F.col("created_at").cast("date"), months)))
    return df.withColumn("status", F.when(F.col("expiry_date") <= F.lit(as_of).cast("date"), "archived").otherwise("active"))
