"""Aggregations (inventory A): one pass with map-side combine each; no grouping sets are needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def n(alias: str = "n"):
    return F.count(F.lit(1)).alias(alias)


def dashboard_stats(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals: active and remote, active jobs per company, most first)."""
    act = jobs.where("is_active")
    totals = act.agg(n("total_active"), F.count_if(F.col("remote_type") == "Remote").alias("remote"))
    return totals, act.groupBy("company").agg(n("jobs")).orderBy(F.col("jobs").desc(), "company")


def visitor_stats(visits: DataFrame, top: int = 10, recent: int = 50, approximate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, top referrers with null as a group of its own, latest visits)."""
    distinct = F.approx_count_distinct("ip_address") if approximate else F.count_distinct("ip_address")
    totals = visits.agg(n("visits"), distinct.alias("visitors"))
    referrers = visits.groupBy("referrer").agg(n("visits")).orderBy(F.col("visits").desc(), F.col("referrer").asc_nulls_first()).limit(top)
    return totals, referrers, visits.orderBy(F.col("timestamp").desc(), "ip_address").limit(recent)


def share_of(df: DataFrame, column: str, missing: str) -> DataFrame:
    """Counts of the column's values with their percentage; the small result alone is summed again."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(n("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))


def ats_distribution(companies: DataFrame) -> DataFrame:
    return share_of(companies, "ats_type", "unknown")


def size_distribution(companies: DataFrame) -> DataFrame:
    return companies.groupBy(F.coalesce("size", F.lit("Not Set")).alias("size")).agg(n("n"))


def sync_job_counts(companies: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies with their current active_jobs and whether it changed, summary with/without jobs and changes)."""
    counts = jobs.where("is_active").groupBy(F.col("company").alias("name")).agg(n("_n"))
    now = F.coalesce("_n", F.lit(0))
    out = companies.join(counts, "name", "left").withColumn("changed", ~now.eqNullSafe(F.col("active_jobs"))).withColumn("active_jobs", now).drop("_n")
    return out, out.agg(F.count_if(F.col("active_jobs") > 0).alias("with_jobs"), F.count_if(F.col("active_jobs") == 0).alias("without_jobs"), F.count_if("changed").alias("updated"))


def collection_mix(collections: DataFrame, companies: DataFrame, id: str) -> DataFrame:
    names = collections.where(F.col("id") == id).select(F.explode("data.companies").alias("name"))
    return companies.join(names, "name").groupBy(F.coalesce("ats_type", F.lit("unknown")).alias("ats_type")).agg(n("companies"), F.sum("active_jobs").alias("active_jobs"))


def coverage(jobs: DataFrame, column: str) -> DataFrame:
    """total, filled, percent of rows whose column is neither null nor an empty text."""
    value = F.col(column)
    filled = F.count_if(value.isNotNull() & (value.cast("string") != ""))
    return jobs.agg(n("total"), filled.alias("filled"), F.round(100.0 * filled / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("percent"))


def import_summary(results: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "success")
    return results.agg(n("total"), done.alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.round(100.0 * done / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("success_rate"))


def distinct_locations(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_distinct("location").alias("locations"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(n("total"), F.count_distinct("user_email").alias("users"))


def visit_count(visits: DataFrame) -> DataFrame:
    return visits.agg(n("visits"))


def run_outcome(actions: DataFrame) -> DataFrame:
    """Per company: saved (new or changed) and skipped (unchanged)."""
    return actions.groupBy("company").agg(F.count_if(F.col("action").isin("new", "changed")).alias("saved"), F.count_if(F.col("action") == "unchanged").alias("skipped"))


def run_metrics(logs: DataFrame, frequency_hours: int = 12) -> DataFrame:
    """Per source: runs, success rate, jobs found and new, average new jobs a week, last run and when the next is due."""
    weeks = F.count_distinct(F.date_trunc("week", "completed_at"))
    last = F.max("completed_at")
    return logs.groupBy("source").agg(
        n("runs"), F.round(F.count_if(F.col("status") == "success") / F.count(F.lit(1)), 4).alias("success_rate"), F.sum("jobs_found").alias("jobs_found"),
        F.sum("jobs_new").alias("jobs_new"), F.round(F.sum("jobs_new") / F.nullif(weeks, F.lit(0)), 4).alias("avg_new_per_week"), last.alias("last_run"), (last + F.make_interval(hours=F.lit(frequency_hours))).alias("next_due"),
    )


def skill_trend(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.date_format("posted_date", "yyyy-MM").alias("month"), F.explode("skills").alias("skill")).groupBy("month", "skill").agg(n("jobs"))


#: Two to this power are the registers of a visitor sketch.
SKETCH_BITS = 12


def sketch_bound(bits: int = SKETCH_BITS, deviations: float = 3) -> float:
    """The relative error that an estimate stays within, up to `deviations` standard errors."""
    return deviations * 1.04 / 2 ** (bits / 2)


def visitor_sketches(visits: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(day, referrer, visits, sketch): visits and a mergeable sketch of the addresses of each day and referrer. Null addresses are no visitors,
    a null referrer is one of its own, rows without a time are left out."""
    day = F.col("timestamp").cast("timestamp").cast("date")
    return visits.withColumn("day", day).where("day IS NOT NULL").groupBy("day", "referrer").agg(F.count(F.lit(1)).alias("visits"), F.hll_sketch_agg("ip_address", F.lit(bits)).alias("sketch"))


def merge_sketches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' sketches, one row for each day and referrer: those of visits that came later are merged into the stored ones."""
    return stored.unionByName(new).groupBy("day", "referrer").agg(F.sum("visits").alias("visits"), F.hll_union_agg("sketch").alias("sketch"))


def visitors_between(sketches: DataFrame, first: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, visits, visitors) of the days from `first` to the one before `end`; visitors is an estimate. No visit is read for it."""
    days = sketches.where((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    return days.groupBy(*by).agg(F.coalesce(F.sum("visits"), F.lit(0).cast("long")).alias("visits"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("visitors"))
