"""The most similar vectors by products of matrices, against the formula for every pair."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.operators import nearest as N
from tallyboard.operators import scoring as M

INF, NAN = float("inf"), float("nan")
SHORT, LONG = "vec_id long, embedding array<float>", "vec_id string, embedding array<double>"


def rows(df):
    # as text: NaN equals nothing
    return sorted(map(str, df.collect()))


def all_pairs(vectors, queries, k):
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    double = lambda df, i, o: df.select(i, F.col("embedding").cast("array<double>").alias(o)).withColumn(f"n{o}", norm(F.col(o)))
    both = double(vectors, "vec_id", "e").crossJoin(double(queries, "query_id", "q"))
    dot = F.aggregate(F.zip_with("e", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", "vec_id", F.round(dot / F.nullif(F.col("ne") * F.col("nq"), F.lit(0.0)), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id"))).where(F.col("rank") <= k)


def table(spark, schema, rng, n):
    near = [rng.uniform(-1, 1) for _ in range(4)]
    kinds = [None, [], [0.0] * 4, [1.0, NAN, 0.0, 0.0], [INF, 1.0, 0.0, 2.0], [1.0, None, 0.0, 0.0], [1.0, 2.0, 3.0], [1e-30] * 4]
    if schema == LONG:
        kinds += [[1e200, 1.0, 0.0, -1e200], [1e-200, 0.0, 1e-200, 0.0], [1e120, 1e110, 0.0, 0.0]]

    def one():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(kinds)
        if kind < 0.6:  # differences about the last decimal that is kept
            return [x + rng.uniform(-1e-3, 1e-3) for x in near]
        if kind < 0.8:
            return near
        return [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-1, 1)]) for _ in range(4)]

    ids = lambda i: (None if i == 7 else i // 2) if schema == SHORT else (None if i == 7 else rng.choice(["a", "B", "é", "😀", "ｚ"]) + str(i))
    return spark.createDataFrame([(ids(i), one()) for i in range(n)], schema).repartition(3)


@pytest.mark.parametrize("schema", [SHORT, LONG])
@pytest.mark.parametrize("size", [64, 2])
def test_as_all_pairs(spark, monkeypatch, schema, size):
    """Odd vectors, ties, repeated ids and blocks of any size."""
    monkeypatch.setattr(N, "QUERIES", size)
    for seed in range(3):
        rng = random.Random(seed)
        v, q = table(spark, schema, rng, 500), table(spark, schema, rng, 60).withColumnRenamed("vec_id", "query_id").cache()
        v = v.cache()
        for k in (1, 4):
            assert rows(M.semantic_topk(v, q, k)) == rows(all_pairs(v, q, k))
    few = v.limit(3)
    assert rows(M.semantic_topk(few, q, 5)) == rows(all_pairs(few, q, 5))
    assert M.semantic_topk(v.limit(0), q, 2).count() == 0 == M.semantic_topk(v, q.limit(0), 2).count()


def test_no_product_of_rows(spark):
    """Pairs aren't rows: their number grows with the square of the table."""
    v, q = table(spark, SHORT, random.Random(9), 300), table(spark, SHORT, random.Random(8), 20).withColumnRenamed("vec_id", "query_id")
    plan = M.semantic_topk(v, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_without_product_of_rows(spark, tmp_path):
    """All lists give what all pairs give, nulls and ids beyond 2**53 included; queries meet rows in blocks, not in a join."""
    v, q = (table(spark, SHORT, random.Random(k), n).withColumn("vec_id", F.col("vec_id") + 2**60) for k, n in ((4, 400), (5, 40)))
    v, q = v.cache(), q.withColumnRenamed("vec_id", "query_id").cache()
    path = f"file://{tmp_path}/v"
    M.index_vectors(v, path, lists=9)
    found = M.indexed_topk(spark, path, q, 4, 1.0)
    assert rows(found) == rows(all_pairs(v, q, 4))
    plan = M.indexed_topk(spark, path, q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
