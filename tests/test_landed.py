"""Landed payload folders: batch and stream give the same postings; filters and offsets choose files."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyboard.sources import boards as B
from tallyboard.sources import landed as L


def land(folder, vendor, name, rows, at):
    path = folder / f"vendor={vendor}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    os.utime(path / name, ns=(at * 10**9, at * 10**9))


def payload(vendor, k, at):
    body = {"lever": [{"id": f"l{k}", "text": f"Role {k}", "createdAt": 1700000000000, "categories": {"location": "Paris"}}], "workday": {"jobPostings": [{"title": f"Job {k}", "externalPath": f"/job/x_R{k}"}]}}[vendor]
    return {"company": f"c{k}", "company_location": "FR", "board": "b", "kind": "list", "fetched_at": datetime.datetime.fromtimestamp(at, datetime.UTC).isoformat(), "body": json.dumps(body)}


START = 1_700_000_000


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        for vendor in ("lever", "workday"):
            land(tmp_path / "in", vendor, f"f{k}.json", [payload(vendor, 10 * k + n, START + k) for n in range(3)], START + k + 1)
    land(tmp_path / "in", "lever", "bad.json", ["no json", "[1]", json.dumps({"company": "only"}), ""], START + 1)
    land(tmp_path / "in", "lever", "_part.json", [payload("lever", 999, START)], START + 1)
    return tmp_path


def postings(df):
    parts = [B.NORMALISERS[v](df.where(F.col("vendor") == v)) for v in ("lever", "workday")]
    return B.all_postings(*parts).select("job_id", "title", "company", "source", "scraped_at")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch(spark, folder):
    L.register(spark)
    df = spark.read.format(L.FORMAT).option("partitionBytes", 600).load(f"file://{folder}/in")
    assert df.count() == 37 and df.rdd.getNumPartitions() > 3
    assert df.where("vendor = 'workday'").count() == 18 and df.where("vendor IN ('lever', 'none')").count() == 19
    since = datetime.datetime.fromtimestamp(START + 4, datetime.UTC).isoformat()
    assert df.where(F.col("fetched_at") >= F.lit(since).cast("timestamp")).count() == 12
    assert postings(df).count() == 36
    assert spark.read.format(L.FORMAT).load(f"file://{folder}/nothing").count() == 0


def test_options_choose_files(spark, folder):
    at = datetime.datetime.fromtimestamp(START + 4, datetime.UTC).isoformat()
    r = L.LandedReader({"path": f"file://{folder}/in", "vendors": "lever,none", "since": at})
    assert [f.path.rpartition("/")[2] for p in r.partitions() for f in p.value] == ["f3.json", "f4.json", "f5.json"]
    L.register(spark)
    assert spark.read.format(L.FORMAT).option("vendors", "workday").load(f"file://{folder}/in").count() == 18


def test_stream_equals_batch(spark, folder):
    """The stream runs twice, with files that land in between; it gives what a batch read gives."""
    L.register(spark)
    path = f"file://{folder}/in"
    stream = lambda: postings(spark.readStream.format(L.FORMAT).option("partitionBytes", 600).load(path))
    run = lambda: stream().writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    land(folder / "in", "lever", "late.json", [payload("lever", 500, START + 50)], START + 60)
    land(folder / "in", "workday", "late.json", [payload("workday", 501, START + 50)], START + 60)
    for _ in range(2):
        run()
    whole = rows(postings(spark.read.format(L.FORMAT).load(path)))
    assert rows(spark.read.parquet(f"{folder}/out")) == whole and len(whole) == 38


def test_memory_by_bytes(tmp_path):
    """A task hands rows on when they are large enough together, not when they are many."""
    long = [{"company": f"c{k}", "fetched_at": "2024-03-01T02:00:00+02:00", "body": "é" * 700_000} for k in range(12)]
    land(tmp_path / "in", "lever", "long.json", long, START)
    r = L.LandedReader({"path": f"file://{tmp_path}/in"})
    batches = [b for p in r.partitions() for b in r.read(p)]
    assert sum(b.num_rows for b in batches) == 12 and max(b.num_rows for b in batches) < 7
    assert batches[0].to_pylist()[0]["fetched_at"] == datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
