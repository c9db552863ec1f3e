"""Scores and matching (inventory M)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions import presets
from tallyboard.functions.text import empty_if_null
from tallyboard.operators import keyed
from tallyboard.operators.blocks import over_blocks
from tallyboard.operators.filters import settled
from tallyboard.operators.nearest import nearest
from tallyboard.operators.windows import top_matches


def _present(text: Column, words: Sequence[str]) -> Column:
    """The words that occur in the text, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])) if words else F.array().cast("array<string>")


def keyword_score(jobs: DataFrame, high: Sequence[str] = presets.HIGH_SIGNAL, exclude: Sequence[str] = presets.EXCLUDED, targets: Sequence[str] = ()) -> DataFrame:
    """`jobs` with score and reason: 3, plus 1.5 for each strong word and once for a target company, 10 at most; an excluded word gives 0."""
    text = F.lower(F.concat_ws(" ", empty_if_null(F.col("title")), empty_if_null(F.col("company")), F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ")))
    df = jobs.withColumn("_text", text).withColumns({"_out": _present(F.col("_text"), exclude), "_high": _present(F.col("_text"), high), "_target": _present(F.col("_text"), targets)})
    hits = F.size("_high") + F.when(F.size("_target") > 0, 1).otherwise(0)
    out = F.size("_out") > 0
    parts = F.when(out, F.array(F.concat(F.lit("Excluded: contains '"), F.get("_out", F.lit(0)), F.lit("'")))).otherwise(
        F.concat(F.col("_high"), F.when(F.size("_target") > 0, F.array(F.concat(F.lit("target co: "), F.get("_target", F.lit(0))))).otherwise(F.array().cast("array<string>")))
    )
    reason = F.when(F.size(parts) > 0, F.concat(F.lit("Keyword match: "), F.array_join(F.slice(parts, 1, 4), ", "))).otherwise("Low signal match")
    score = F.when(out, 0.0).otherwise(F.round(F.least(F.lit(10.0), 3 + 1.5 * hits), 1))
    return df.withColumns({"score": score, "reason": reason}).drop("_text", "_out", "_high", "_target")


def landed_score(jobs: DataFrame, scores: DataFrame, answered: DataFrame | None = None, **vocabulary) -> DataFrame:
    """`jobs` with the score and reason that a model gave (job_id, score, reason). Jobs of batches that it answered (job_id; none
    given: all) without naming them get 3, the others are scored by keywords."""
    by_words = keyword_score(jobs, **vocabulary).withColumnsRenamed({"score": "_score", "reason": "_reason"})
    given = scores.select("job_id", F.col("score").cast("double").alias("score"), "reason", F.lit(True).alias("_given"))
    df = by_words.join(given, "job_id", "left")
    df = df.join(answered.select("job_id").distinct().withColumn("_asked", F.lit(True)), "job_id", "left") if answered is not None else df.withColumn("_asked", F.lit(True))
    pick = lambda c, default: F.when(F.col("_given"), F.coalesce(c, F.lit(default))).when(F.col("_asked"), F.lit(default)).otherwise(F.col(f"_{c}"))
    return df.withColumns({"score": pick("score", 3.0), "reason": pick("reason", "Not scored")}).drop("_score", "_reason", "_given", "_asked")


#: Scorers by name: (jobs, **options) -> jobs with score and reason. Users add their own.
SCORERS: dict[str, Callable[..., DataFrame]] = {"keywords": keyword_score, "landed": landed_score}


def run_digest(jobs: DataFrame, as_of: str, days: int = 1, n: int = 15, least: float = 5.0, scan: int = 100, scorer: str = "keywords", **options) -> tuple[DataFrame, DataFrame]:
    """(top matches, log row): the `scan` newest active jobs of the window are scored; without any there is no log row.

    matched_count counts the matches that are shown, `n` at most."""
    recent = jobs.where("is_active").where(F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    recent = recent.orderBy(F.col("posted_date").desc(), "job_id").limit(scan)
    scored = SCORERS[scorer](recent, **options)
    top = top_matches(scored, least, n)
    matched = F.least(F.count_if(F.col("score") >= least), F.lit(n).cast("long"))
    log = scored.agg(F.count(F.lit(1)).alias("total_scanned"), matched.alias("matched_count")).where("total_scanned > 0")
    return top, log.select(F.lit(as_of).cast("timestamp").alias("run_at"), F.lit(scorer).alias("provider"), F.lit(days).alias("days_lookback"), "total_scanned", "matched_count")


def preference_score(jobs: DataFrame, prefs: DataFrame, below: bool = False) -> DataFrame:
    """(user_email, job_id, match_score) of the jobs that reach the user's least score; with `below`, of all, and `kept` tells which do.

    30 for keywords, 30 skills, 20 place, 20 pay; an excluded word gives 0. Without `below`, users are listed by the words, skills
    and places without any of which a job can't reach their least score, and jobs probe the list (`keyed`). Users who have no such
    words (the least score is within reach of any job) meet every job, as all do with `below`; both in blocks of checked size."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    p = prefs.select("user_email", *[low(F.col(c)).alias(f"_{c}") for c in ("keywords", "exclude_keywords", "locations", "required_skills", "preferred_skills")], F.coalesce("min_salary", F.lit(0)).alias("_min"), F.coalesce("min_match_score", F.lit(0)).alias("_least"))
    texts = settled(jobs, {"_text": F.lower(F.concat_ws(" ", empty_if_null(F.col("title")), empty_if_null(F.col("description")))), "_skills": low(F.col("skills")), "_place": F.lower(empty_if_null(F.col("location")))})
    share = lambda words, hit: F.size(F.filter(words, hit)) / F.size(words)
    known = keyed.vocabulary(p.select(F.explode(F.concat("_keywords", "_exclude_keywords")).alias("w")))
    if known is not None:
        # each word is looked for once a job, not once a pair, and pairs carry no texts
        texts = keyed.held(texts, known, ["job_id", "remote_type", "salary", "_skills", "_place"])
    in_text = lambda w: F.contains(F.col("_text"), w) if known is None else F.array_contains("_held", w)
    is_skill = lambda w: F.array_contains(F.col("_skills"), w)
    none = lambda c: F.size(c) == 0
    keywords = F.when(none("_keywords"), 1.0).otherwise(share(F.col("_keywords"), in_text))
    need = F.when(none("_required_skills"), 1.0).otherwise(share(F.col("_required_skills"), is_skill))
    nice = F.when(none("_preferred_skills"), 1.0).otherwise(share(F.col("_preferred_skills"), is_skill))
    skills = F.when(~none("_required_skills") & (need < 0.5), 0.0).otherwise(need * 0.7 + nice * 0.3)
    two_way = F.exists("_locations", lambda x: F.contains(F.col("_place"), x) | F.contains(x, F.col("_place")))
    remote = F.exists("_locations", lambda x: F.contains(x, F.lit("remote"))) & (F.contains("_place", F.lit("remote")) | F.coalesce(F.col("remote_type") == "Remote", F.lit(False)))
    place = F.when(none("_locations") | two_way | remote, 1.0).otherwise(0.0)
    low_pay, high_pay = F.coalesce("salary.min", F.lit(0)), F.coalesce("salary.max", F.lit(0))
    pay = F.when((F.col("_min") == 0) | ((low_pay >= F.col("_min")) & (low_pay > 0)), 1.0).when((low_pay == 0) & (high_pay == 0), 0.5).when(high_pay >= F.col("_min"), 0.7).otherwise(0.0)
    score = F.when(F.exists("_exclude_keywords", in_text), 0.0).otherwise(F.round(keywords * 30 + skills * 30 + place * 20 + pay * 20, 2))

    def scored(both: DataFrame) -> DataFrame:
        df = settled(both, {"match_score": score})
        return df.select("user_email", "job_id", "match_score", (F.col("match_score") >= F.col("_least")).alias("kept"))

    if below:
        return over_blocks(p, "user_email", lambda block: scored(texts.join(F.broadcast(block))))
    groups = ("_keywords", "_required_skills", "_preferred_skills", "_locations")
    n = F.size("_required_skills")
    takes = (F.size("_keywords"), n - F.ceil(n / 2) + 1, F.size("_preferred_skills"), F.lit(2**30))
    words = (keyed.items(keyed.TEXT, F.col("_keywords")), *[keyed.items(keyed.SKILL, F.col(c)) for c in groups[1:3]], keyed.places(F.col("_locations")))
    parts = F.array(*[keyed.part(F.lit(k), none(groups[k]), F.lit(False), takes[k], words[k]) for k in range(4)])

    def way(found: Column) -> Column:
        of = lambda k: F.get(F.filter(found, lambda x: x["part"] == k), F.lit(0))
        ways = []
        for without in range(1, 16):
            out = [k for k in range(4) if without >> k & 1]
            best = (0 if 0 in out else 30) + (0 if 1 in out else 21 if 2 in out else 30) + (0 if 3 in out else 20) + 20
            possible = F.lit(best) < F.col("_least")
            for k in out:
                possible = possible & ~of(k)["open"]
            ways.append((possible, sum((of(k)["cost"] for k in out), F.lit(0).cast("long")), F.concat(*[of(k)["keys"] for k in out])))
        return keyed.cheapest(ways)

    near = F.concat_ws("\n", "_place", F.when(F.col("remote_type") == "Remote", "remote"))
    index, probing = keyed.listed(p, parts, way, texts, near)
    return keyed.met(probing, index, scored).where("kept").drop("kept")


def criteria_score(jobs: DataFrame, criteria: DataFrame, zeros: bool = False) -> DataFrame:
    """(set_id, job_id, score) of criteria (set_id, type, words, priority, is_required): weighted share of what fits, 0 if a required
    one doesn't. Zeros are left out unless asked for.

    Types: keyword (any word in title or description), location (any word in the place), skills (half of them). Without zeros, a set is
    listed by its required criterion of the rarest words, or by the words of all criteria where none is required, and jobs probe the
    list (`keyed`). Each set is one row, and sets are sent out in blocks of checked size, so no scores are shuffled."""
    text, place = F.lower(F.concat_ws(" ", empty_if_null(F.col("title")), empty_if_null(F.col("description")))), F.lower(empty_if_null(F.col("location")))
    own = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.lower(s))
    df = settled(jobs.select("job_id", "title", "description", "location", "skills"), {"_text": text, "_place": place, "_skills": own})
    parts = F.struct("type", F.transform("words", lambda w: F.lower(w)).alias("words"), (F.col("priority") * 20).alias("weight"), "is_required")
    sets = criteria.groupBy("set_id").agg(F.collect_list(parts).alias("_all"))
    known = keyed.vocabulary(criteria.where("type = 'keyword'").select(F.explode("words").alias("w")).select(F.lower("w").alias("w")))
    if known is not None:
        # each word is looked for once a job, not once a pair, and pairs carry no texts
        df = keyed.held(df, known, ["job_id", "_skills", "_place"])

    def fits(x: Column) -> Column:
        in_ = lambda c, w: F.array_contains("_held", w) if c == "_text" and known is not None else F.contains(F.col(c), w)
        some = lambda c: F.exists(x["words"], lambda w: in_(c, w))
        skills = F.size(F.filter(x["words"], lambda w: F.array_contains(F.col("_skills"), w))) >= F.size(x["words"]) * 0.5
        return F.coalesce(F.when(x["type"] == "keyword", some("_text")).when(x["type"] == "location", some("_place")).when(x["type"] == "skills", skills), F.lit(False))

    hits = F.transform("_all", lambda x: F.struct(fits(x).alias("fits"), x["weight"].alias("weight"), x["is_required"].alias("is_required")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    share = F.round(100.0 * total(F.filter("_hits", lambda x: x["fits"])) / total(F.col("_hits")), 2)
    score = F.when(F.forall("_hits", lambda x: x["fits"] | ~x["is_required"]), share).otherwise(0.0)

    def scored(both: DataFrame) -> DataFrame:
        return settled(both, {"_hits": hits}).select("set_id", "job_id", score.alias("score"))

    if zeros:
        return over_blocks(sets, "set_id", lambda block: scored(df.join(F.broadcast(block))))
    none = F.array().cast("array<string>")
    space = lambda x: F.when(x["type"] == "keyword", keyed.items(keyed.TEXT, x["words"])).when(x["type"] == "location", keyed.items(keyed.PLACE, x["words"])).when(x["type"] == "skills", keyed.items(keyed.SKILL, x["words"])).otherwise(keyed.items(keyed.TEXT, none))
    size = lambda x: F.size(F.coalesce(x["words"], none))
    take = lambda x: F.when(x["type"] == "skills", size(x) - F.ceil(size(x) / 2) + 1).otherwise(size(x))
    # half of no skills is none, which every job has
    every = lambda x: (x["type"] == "skills") & x["words"].isNotNull() & (size(x) == 0)
    parts = F.transform("_all", lambda x, k: keyed.part(k, every(x), F.coalesce(x["is_required"], F.lit(True)), take(x), space(x)))

    def way(found: Column) -> Column:
        must = F.transform(F.filter(found, lambda x: x["required"] & ~x["open"]), lambda x: F.struct(x["cost"].alias("cost"), x["keys"].alias("keys")))
        any_ = keyed.cheapest([(~F.exists(found, lambda x: x["open"]), F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x["cost"]), F.flatten(F.transform(found, lambda x: x["keys"])))])
        return F.coalesce(F.array_min(must), any_)

    index, probing = keyed.listed(sets, parts, way, df, F.col("_place"))
    return keyed.met(probing, index, scored).where("score > 0")


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar vectors by cosine; ties by id.

    A stated set of queries against all rows, sent out in blocks of checked size. The work is queries times rows; products of
    matrices do it (`nearest`), and each task gives k rows a query."""
    return over_blocks(queries.select("query_id", "embedding"), "query_id", lambda part: nearest(vectors.select("vec_id", "embedding"), part, k))


#: Vectors that centroids are fitted on; every vector is listed, however many there are.
SAMPLE = 20_000
#: Rounds of the fit.
ROUNDS = 10
#: The share of all lists that a query looks into. Vectors that hardly lie in clusters need so many for a recall of 0.9; others need few.
PROBED = 0.7


def _units(lists: pd.Series) -> np.ndarray:
    """Rows of length one; a null, zero or infinite vector is a zero row."""
    width = max((len(x) for x in lists if x is not None), default=0)
    rows = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        if x is not None:
            rows[k, : len(x)] = np.asarray(x, float)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=(norms > 0) & np.isfinite(norms))


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of spherical k-means on at most `sample` vectors, those with the smallest hashes of their ids; the same for the same table."""
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    x = _units(some["embedding"])
    if not len(x):
        return np.zeros((1, 0))
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        # an empty list starts again at a vector that its own centre fits worst
        worst = x[np.argsort((x * centres[own]).sum(axis=1))[: len(centres)]]
        centres = np.where(norms > 0, np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0), np.resize(worst, centres.shape))
    return centres


def index_vectors(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Stores all vectors (vec_id, embedding) in folders by the centroid that they are nearest to, and the centroids beside them.

    lists: default the square root of the number of vectors, 2000 at most, so that centroids stay small enough for every task."""
    spark = vectors.sparkSession
    lists = lists or max(1, min(2000, round(vectors.count() ** 0.5)))
    centres = fit_centroids(vectors, lists, sample)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(1).to_pandas())
            width = min(x.shape[1], sent.value.shape[1])
            own = np.argmax(x[:, :width] @ sent.value[:, :width].T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["vec_id", "embedding", "list"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(assign, "vec_id long, embedding array<double>, list int")
    rows.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def indexed_topk(spark: SparkSession, path: str, queries: DataFrame, k: int, probed: float = PROBED) -> DataFrame:
    """(query_id, vec_id, similarity, rank) as `semantic_topk`, of the vectors in the `probed` share of lists whose centroids are most similar to the query.

    Exact within these lists; what lies elsewhere is missed, so recall grows with `probed` and is whole at 1. Each list meets the queries
    that look into it by products of matrices (`nearest`), in as many tasks as its rows are read by."""
    centres = _units(pd.Series([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").select("centre").collect()]))
    sent, own = spark.sparkContext.broadcast(centres), max(1, round(len(centres) * probed))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(1).to_pandas())
            width = min(x.shape[1], sent.value.shape[1])
            best = np.argsort(-(x[:, :width] @ sent.value[:, :width].T), axis=1, kind="stable")[:, :own]
            bits = np.zeros((len(x), len(sent.value)), bool)
            np.put_along_axis(bits, best, True, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], names=["query_id", "embedding", "lists"])

    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = q.mapInArrow(look, f"query_id {q.schema['query_id'].dataType.simpleString()}, embedding array<double>, lists binary")
    rows = spark.read.schema("vec_id long, embedding array<double>, list int").parquet(f"{path}/vectors")
    return over_blocks(asked, "query_id", lambda part: nearest(rows, part, k))
