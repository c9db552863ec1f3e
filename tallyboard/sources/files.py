"""File sources and sinks (inventory S1, S2, S10, S12, S13)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions import presets
from tallyboard.functions.text import strip_suffix

COMPANY_LIST = "name string, domain string, ats_type string, ats_url string, size string, industry string, is_active boolean, tags array<string>, file string"


def read_company_lists(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Companies of YAML lists (``companies:``), one or several documents a file, read file by file inside the tasks; rows without a
    name or domain are left out."""
    files = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select("value", F.input_file_name().alias("file"))

    def run(batches):
        import yaml

        for pdf in batches:
            rows = []
            for value, file in zip(pdf["value"], pdf["file"]):
                for c in (c for part in yaml.safe_load_all(value) for c in (part or {}).get("companies") or []):
                    ats = c.get("ats_system") or {}
                    rows.append((c.get("name"), c.get("domain"), c.get("ats_type") or ats.get("type"), c.get("ats_url"), c.get("size"), c.get("industry"), c.get("is_active"), c.get("tags"), file))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COMPANY_LIST.split(", ")])

    return files.mapInPandas(run, COMPANY_LIST).where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("domain", F.lit("")) != ""))


def parse_curated_list(lines: DataFrame, column: str = "value", suffixes: Sequence[str] = presets.CURATED_SUFFIXES) -> DataFrame:
    """raw_name, name, description, location of lines ``N) Name - description (place)``; other lines give nothing."""
    part = lambda g: F.trim(F.regexp_extract(F.trim(column), presets.CURATED, g))
    rows = lines.where(F.trim(column).rlike(presets.CURATED)).select(part(1).alias("raw_name"), part(2).alias("description"), part(3).alias("location"))
    return rows.select("raw_name", strip_suffix(F.col("raw_name"), suffixes).alias("name"), "description", "location")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and fixed columns; missing columns and nulls are blank, quotes are doubled."""
    full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    full.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def acceptable_feedback(feedback: DataFrame, most: int = 2000) -> DataFrame:
    return feedback.where(F.length("content").between(1, most))


def append(df: DataFrame, path: str, batch: str | int) -> None:
    """Appends rows to a log (digests, visits, feedback) as its part `batch`; written again, a part is replaced, not doubled."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
