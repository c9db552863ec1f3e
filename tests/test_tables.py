"""Bucketed tables, counts kept by deltas, keyword indexes and pages by seeking, against plain rebuilds and scans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import links
from tallyboard.functions import text as X
from tallyboard.operators import aggregates as A
from tallyboard.operators import filters as P
from tallyboard.operators import joins as J
from tallyboard.operators import merge as U
from tallyboard.operators import scoring as M
from tallyboard.operators import search as Q
from tallyboard.operators.tables import BucketedTable
from tallyboard.plans.views import view

JOBS = "job_id string, company string, content_hash string, last_seen_at timestamp, is_active boolean, note string"
EMITTED = ["company", "content_hash"]
SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def job(k, rng, day=1):
    return (f"j{k}", rng.choice(["a", "b", "c", None]), f"h{rng.randrange(3)}", datetime.datetime(2024, 1, day), rng.random() < 0.6, None)


def test_counts_after_random_batches(spark, tmp_path):
    """Ten random batches: the table equals plain upserts, and the counts a recount."""
    rng = random.Random(0)
    plain = spark.createDataFrame([job(k, rng) for k in range(60)], JOBS)
    table, counts = BucketedTable(spark, f"file://{tmp_path}/t", ["job_id"]), BucketedTable(spark, f"file://{tmp_path}/c", ["company"])
    table.create(plain, 8)
    counts.create(U.count_active(plain), 3)
    for b in range(10):
        batch = spark.createDataFrame([job(rng.randrange(90), rng, b + 2) for _ in range(rng.randrange(12))], JOBS)
        plain = spark.createDataFrame(U.upsert_jobs(plain, batch, EMITTED).collect(), JOBS)
        U.merge_jobs(table, batch, EMITTED, b, counts)
    assert rows(table.read()) == rows(plain)
    assert rows(counts.read().where("active_jobs > 0")) == rows(U.count_active(plain).where("active_jobs > 0"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    stored = spark.createDataFrame([job(k, random.Random(k)) for k in range(400)], JOBS)
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["job_id"])
    table.create(stored, 16)
    one = [r.job_id for r in stored.withColumn("b", table.bucket(16)).where("b = 5").limit(4).collect()]
    before = set(tmp_path.glob("t/data-*/_bucket=*"))
    batch = stored.where(F.col("job_id").isin(one)).withColumns({"content_hash": F.lit("new"), "last_seen_at": F.lit("2024-02-01").cast("timestamp")})
    merge = lambda number: U.merge_jobs(table, batch, EMITTED, number)
    old = table.read()
    assert merge(0) == [5]
    new = set(tmp_path.glob("t/data-*/_bucket=*")) - before
    assert len(before) == 16 and {p.name for p in new} == {"_bucket=5"}
    assert rows(table.read()) == rows(U.upsert_jobs(stored, batch, EMITTED))
    assert merge(0) == [] and set(tmp_path.glob("t/data-*/_bucket=*")) - before == new
    # who reads the version before still does
    assert rows(old) == rows(stored)
    table.vacuum(1)
    assert len(list(tmp_path.glob("t/list-*"))) == 1 and {p.name for p in before & set(tmp_path.glob("t/data-*/_bucket=*"))} == {f"_bucket={b}" for b in range(16) if b != 5}
    assert table.read().count() == 400


def test_a_merge_that_dies_changes_nothing(spark, tmp_path):
    stored = spark.createDataFrame([job(k, random.Random(k)) for k in range(40)], JOBS)
    table, counts = BucketedTable(spark, f"file://{tmp_path}/t", ["job_id"]), BucketedTable(spark, f"file://{tmp_path}/c", ["company"])
    table.create(stored, 4)
    counts.create(U.count_active(stored), 2)
    batch = stored.withColumn("content_hash", F.lit("n")).withColumn("company", F.lit("moved"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|lost"):
        table.merge(batch, lambda own: own.withColumn("note", F.raise_error(F.lit("lost")).cast("string")), 0)
    assert rows(table.read()) == rows(stored)
    # dies between counts and table: the counts have the batch, the table takes it when it comes again
    U.merge_counts(counts, U.active_deltas(table.touched(batch), batch, EMITTED), 0)
    U.merge_jobs(table, batch, EMITTED, 0, counts)
    assert rows(counts.read().where("active_jobs > 0")) == rows(U.count_active(table.read()).where("active_jobs > 0"))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], JOBS)
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["job_id"])
    assert not table.exists()
    table.create(none, 4)
    assert table.read().count() == 0 and U.merge_jobs(table, none, EMITTED, 0) == []
    U.merge_jobs(table, spark.createDataFrame([job(1, random.Random(1))], JOBS), EMITTED, 1)
    assert table.read().count() == 1


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stored")
    jobs = view(spark, SF, "postings").select("job_id", "title", "company", "description", "skills", "posted_date")
    odd = spark.createDataFrame([("x1", None, None, None, None, None), ("x2", "Größe ÄÖ", "", "ab", ["C++", "ab\ncd"], None), ("x3", "zzzq", "zz", "q", [], datetime.datetime(2024, 2, 1))], "job_id string, title string, company string, description string, skills array<string>, posted_date timestamp")
    jobs.unionByName(odd).repartition(12, "job_id").write.parquet(f"file://{at}/jobs")
    Q.index_keywords(spark, f"file://{at}/jobs", f"file://{at}/index")
    return f"file://{at}/jobs", f"file://{at}/index"


def test_indexed_keywords_equal_the_scan(spark, stored):
    rng = random.Random(1)
    jobs = spark.read.parquet(stored[0])
    texts = [r.description for r in jobs.where("length(description) > 50").limit(30).collect()]
    cuts = [t[k : k + rng.randrange(1, 12)] for t in texts[:6] for k in [rng.randrange(40)]]
    for q in ["The  OU", "größe", "C++ AB", "zzzq", "nowhere", "", "q", "ab", "cd größe", *cuts]:
        assert rows(Q.indexed_keyword_filter(spark, *stored, q).select("job_id")) == rows(P.keyword_filter(jobs, q).select("job_id")), q


def test_rare_terms_read_few_files(spark, stored):
    read = lambda q: sum("/jobs/" in f for f in Q.indexed_keyword_filter(spark, *stored, q).inputFiles())
    assert read("zzzq") == 1 and read("nowhere xyz") == 0 and read("the") == 12
    plan = Q.candidates(spark, stored[1], "zzzq")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(EqualTo(gram" in plan or "In(gram" in plan


def test_pages_by_seeking(spark, tmp_path):
    """All pages together are the order, whichever way they are found; a deep page reads one or two files."""
    jobs = view(spark, SF, "postings").select("job_id", F.when(F.col("doc_id") % 50 != 0, F.col("posted_date")).alias("posted_date"))
    path = f"file://{tmp_path}/t"
    Q.write_in_order(jobs, path, 9)
    index = Q.page_index(spark, path).cache()
    whole = [r.job_id for r in jobs.orderBy(F.col("posted_date").desc_nulls_last(), "job_id").collect()]
    seen = [r.job_id for k in range(0, 1100, 130) for r in Q.seek_page(spark, path, index, k, 130).collect()]
    assert seen == whole
    deep = Q.seek_page(spark, path, index, 800, 50)
    assert len(deep.inputFiles()) <= 2 and "Offset" not in deep._jdf.queryExecution().toString()
    key, seen = None, []
    while page := Q.page_after(spark, path, index, key, 170).collect():
        seen += [r.job_id for r in page]
        key = (page[-1].posted_date, page[-1].job_id)
    assert seen == whole


def test_sketches(spark):
    """Estimates of merged sketches stay within their bound of the exact count, over any span and however the visits came in."""
    visits = spark.range(200_000).select((F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(20 * 86400)))).alias("timestamp"), F.concat(F.lit("ip"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60_000))).alias("ip_address"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("referrer"))
    parts = [A.visitor_sketches(visits.where(F.col("timestamp").cast("long") % 3 == k)) for k in range(3)]
    sketches = A.merge_sketches(A.merge_sketches(parts[0], parts[1]), parts[2]).cache()
    assert sketches.groupBy("day", "referrer").count().where("count > 1").count() == 0
    for first, end in [("2024-01-01", "2024-01-21"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-15")]:
        own = visits.where((F.col("timestamp") >= first) & (F.col("timestamp") < end))
        exact = {r[0]: r[1:] for r in own.groupBy("referrer").agg(F.count("*"), F.count_distinct("ip_address")).collect()}
        exact["all"] = own.agg(F.count("*"), F.count_distinct("ip_address")).first()
        found = {r.referrer: r for r in A.visitors_between(sketches, first, end, ["referrer"]).collect()}
        found["all"] = A.visitors_between(sketches, first, end).first()
        for k, (n, ips) in exact.items():
            assert found[k].visits == n and abs(found[k].visitors - ips) <= A.sketch_bound() * ips
    assert tuple(A.visitors_between(sketches, "2030-01-01", "2031-01-01").first()) == (0, 0)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_semantic_index(spark, tmp_path, sf):
    """Every vector is listed; recall against the exact search is 0.9 at least; all lists give the exact result."""
    v = view(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path = f"file://{tmp_path}/v"
    M.index_vectors(v, path)
    assert rows(spark.read.parquet(f"{path}/vectors").select("vec_id")) == rows(v.select(F.col("vec_id").cast("long")))
    exact = {(r.query_id, r.vec_id) for r in M.semantic_topk(v, q, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in M.indexed_topk(spark, path, q, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact), len(exact & found) / len(exact)
    whole = M.indexed_topk(spark, path, q, 5, 1.0)
    assert {(r.query_id, r.vec_id, r.similarity) for r in whole.collect()} == {(r.query_id, r.vec_id, r.similarity) for r in M.semantic_topk(v, q, 5).collect()}


def test_semantic_index_of_odd_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], schema)
    for table, n in ((v, 6), (v.limit(0), 0)):
        path = f"file://{tmp_path}/v{n}"
        M.index_vectors(table, path)
        found = M.indexed_topk(spark, path, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>"), 3, 1.0).collect()
        assert sorted(r.vec_id for r in found) == ([1, 4, 4] if n else [])


def test_typos_are_found(spark):
    """Names with a letter too many or too few against the similarity of all pairs."""
    from tallyboard.plans.queries import QUERIES, misspelt

    sf = "/root/testdata/sf0.001"
    names = sorted({f"{r.p_name} {r.p_type}" for r in view(spark, sf, "part").collect()})
    wanted = {}
    for (name, _) in map(tuple, misspelt(spark, sf).distinct().collect()):
        best = max(names, key=lambda n: J.token_set_similarity(name, n))
        score = J.token_set_similarity(name, best)
        if score >= 90:
            wanted[name] = (min(n for n in names if J.token_set_similarity(name, n) == score), round(score, 4))
    found = {r.candidate: (r.match, r.score) for r in QUERIES["j10_fuzzy_typos"](spark, sf).collect()}
    assert found == wanted and sum(90 <= s < 100 for _, s in found.values()) > 100


def test_anchors_by_parser(spark):
    """Where the parser and the pattern differ: comments, scripts, links without quotes, anchors that aren't closed."""
    html = """<!-- <a href="no">x</a> --><a name=top>t</a><A HREF=a/b>One <b>two</b><a href='c'>Three</A><script>s='<a href="no2">y</a>'</script><a href="d&amp;e">4</a><a href>5</a>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")
    assert rows(links.page_anchors(df)) == [(1, 0, "a/b", "one two"), (1, 1, "c", "three"), (1, 2, "d&e", "4")]
    by_pattern = df.select(F.explode(X.anchors(F.col("html"))["href"])).collect()
    assert [r[0] for r in by_pattern] != ["a/b", "c", "d&e"]
