"""The pipeline against brute-force versions of its stages; the trained scores of the first stage are taken from the operator."""

import duckdb
from brute import components, contamination
from compare import SF

import corpus_pipeline
from tallyboard.llm.queries import ORACLE_SQL, QUERIES


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in QUERIES["op6_quality_ranker"](spark, SF).where("predicted = 1").collect()}
    first = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    roots = {i for i, n, root in components(first) if n == 0 or i == root}
    second = [(i, t) for i, t in first if i in roots]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = sorted(x[0] for x in contamination(second, items) if not x[-1])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN ({','.join(map(str, kept))})")
    wanted = sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op9_mixing']})").fetchall())
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(found.doc_id) == wanted and set(found.doc_id) == set(kept)
    counts = found.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert list(found.columns)[: len(docs.columns)] == docs.columns


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, blank and very long texts, repeated rows, names that the operators use themselves, and no rows at all."""
    prose = " ".join(f"word{k * k % 97}" for k in range(120)) + ". "
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose + "end", None, None), (3, None, None, "a"), (None, prose.upper(), "en", None), (None, None, None, None), (4, " \n", "de", "b"), (5, prose[::-1] * 90, "en", "b"), (6, "q " * 30, "en", "b")]
    names = ["doc_id", "text", "lang", "source", "block", "epoch", "_id", "_node", "_source", "_code", "n_tokens", "part"]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names[4:]))
    for table, schema, data in (("labels", "doc_id long, quality int, toxic int", [(1, 1, 0), (6, 0, 0), (None, 1, 1)]), ("benchmark", "item_id int, text string", [(1, "word0 word1 zz"), (None, None)])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for source in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, source, str(tmp_path))
            kept = found.collect()
            assert found.columns[: len(names)] == names
            assert all([r[n] for n in names[4:]] == list(range(1, 9)) for r in kept) and bool(kept) == (source is docs)
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(*names[:4])
    source.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [*names[:4], "shard", "slot", "curve"]
