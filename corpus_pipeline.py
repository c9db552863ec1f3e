"""The corpus pipeline: five stages, each a DataFrame of what its predecessor kept, written as Parquet between stages.

quality classifier -> near duplicates -> benchmark decontamination -> mixing to target weights -> sharding
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyboard.llm import decontaminate, hilbert_shards, jaccard_join, mixing, quality_ranker
from tallyboard.llm.common import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker, trained on the labels of `docs` itself, scores at or above the threshold."""
    return quality_ranker.keep_good(docs, quality_ranker.train(docs, table(spark, sf_dir, "labels")))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each component of near copies (see `jaccard_join.one_of_each`); texts without words all stay."""
    return jaccard_join.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands, items without an id included; null texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: sources are repeated up to the limit, none is thinned out."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard, slot and curve; null ids, sources and languages sort first."""
    return hilbert_shards.with_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_first_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("source mixing", mix_sources),
    ("Hilbert sharding", shard),
]

#: The first stage is a trained model, which SQL can't express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`, each written as Parquet to the shared folder and read again.

    Columns of `documents` come back as they are, whatever their names, with shard, slot and curve (which replace columns of these
    names). Null and blank texts pass if the classifier keeps them; a null id is a document like any other; repeated rows are near
    copies of each other; texts count whole, however long; mixing may repeat a row; no rows give none. A stage's folder is
    deleted once the next one is written; the last one is what the result reads."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _drop(spark, f"{folder}/{k - 1}")
    return docs
