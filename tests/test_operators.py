"""Properties of operators: idempotence, splits, limits, merges, streams equal to batches."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import presets
from tallyboard.operators import alerts, blocks, keyed
from tallyboard.operators import filters as P
from tallyboard.operators import joins as J
from tallyboard.operators import merge as U
from tallyboard.operators import scoring as M
from tallyboard.operators import windows as W
from tallyboard.plans import stream_queries  # noqa: F401
from tallyboard.plans.queries import HIT, QUERIES, plain_jobs
from tallyboard.plans.views import view
from tallyboard.sources.boards import NORMALISERS, extract_cards
from tallyboard.streaming import streams as S

from compare import SF


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_gate_splits(spark):
    jobs = plain_jobs(spark, SF)
    good, bad = P.gate(jobs, **HIT)
    a, b = {r.job_id for r in good.collect()}, {r.job_id for r in bad.collect()}
    assert not a & b and len(a) + len(b) == jobs.count()


def test_pages_make_the_whole(spark):
    jobs = view(spark, SF, "postings").select("job_id", "posted_date")
    order = [F.col("posted_date").desc(), "job_id"]
    parts = [r.job_id for k in range(0, 210, 50) for r in W.page(jobs, order, k, 50)[0].collect()]
    assert parts == [r.job_id for r in jobs.orderBy(*order).collect()]


JOBS = "job_id string, title string, benefits string, content_hash string, last_seen_at timestamp, is_active boolean"


def test_upsert_jobs(spark):
    d = lambda n: datetime.datetime(2024, 1, n)
    stored = spark.createDataFrame([("same", "a", "x", "h1", d(1), False), ("new hash", "b", "x", "h2", d(1), True), ("stored only", "c", "x", "h3", d(1), False)], JOBS)
    incoming = spark.createDataFrame([("same", "A", "h1", d(2), True), ("new hash", None, "h9", d(2), True), ("twice", "1", "h4", d(2), True), ("twice", "2", "h5", d(3), True)], "job_id string, title string, content_hash string, last_seen_at timestamp, is_active boolean")
    once = U.upsert_jobs(stored, incoming, ["title", "content_hash"])
    assert rows(once, "job_id", "title", "benefits", "content_hash", "is_active") == sorted([("same", "a", "x", "h1", True), ("new hash", None, "x", "h9", True), ("stored only", "c", "x", "h3", False), ("twice", "2", None, "h5", True)], key=str)
    assert rows(U.upsert_jobs(once, incoming, ["title", "content_hash"])) == rows(once)


def test_skip_known_treats_null_as_equal(spark):
    a = spark.createDataFrame([("c", "t", None), ("c", "u", None)], "company string, title string, location string")
    b = spark.createDataFrame([("c", "t", None)], "company string, title string, location string")
    assert rows(J.skip_known(a, b)) == [("c", "u", None)]


def test_alerts_by_day_equal_broadcast(spark, monkeypatch):
    from tallyboard.plans.queries import AS_OF, searches

    args = searches(spark, SF), view(spark, SF, "postings"), AS_OF
    few = rows(J.match_alerts(*args))
    monkeypatch.setattr(J.blocks, "SENT_BYTES", 4000)
    assert rows(J.match_alerts(*args)) == few


def brute_limit(times, limit, window):
    kept, out = [], []
    for t in times:
        out.append(len([k for k in kept if t - k < window]) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_decisions_are_those_of_all_accepted_times():
    rng = random.Random(1)
    for _ in range(300):
        limit, window = rng.randrange(4), rng.randrange(1, 12)
        times = sorted(rng.randrange(60) for _ in range(rng.randrange(40)))
        flags, recent = S._decide(times[:9], [], limit, window)
        assert flags + S._decide(times[9:], recent, limit, window)[0] == brute_limit(times, limit, window)


def test_rate_limit(spark):
    start = datetime.datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 10, 11, 12, 20, 21]
    events = spark.createDataFrame([("k", start + datetime.timedelta(seconds=t)) for t in times] + [("other", start)], "key string, ts timestamp")
    found = [r.accepted for r in S.rate_limit(events, 3, 10).where("key = 'k'").orderBy("ts").collect()]
    assert found == brute_limit(times, 3, 10)


def test_streams_equal_batches(spark):
    assert rows(QUERIES["t3_stream_rate_limit"](spark, SF)) == rows(QUERIES["t3_rate_limit"](spark, SF))
    events = {r.event: r.n for r in QUERIES["t5_stream_lifecycle"](spark, SF).collect()}
    assert events["new"] >= view(spark, SF, "snapshots").select("job_id").distinct().count()


def test_alerts_are_mailed_once(spark, tmp_path):
    """A search's cutoff follows its mails; a batch that is run again replaces its mail; k limits each mail."""
    day = lambda n: datetime.datetime(2024, 3, n)
    searches = spark.createDataFrame([(1, "u", True, day(1), ("x", None, None)), (2, "u", True, None, (None, None, None)), (3, "u", False, day(1), (None, None, None))], "search_id long, user_email string, email_alert boolean, last_emailed_at timestamp, criteria struct<q: string, location: string, category: string>")
    schema = "job_id string, title string, company string, location string, remote_type string, skills array<string>, posted_date timestamp, is_active boolean"
    for part in ([("a", day(2)), ("b", day(3))], [("c", day(3)), ("d", day(4)), ("e", day(5))]):
        spark.createDataFrame([(i, "x", "c", "l", "r", [], d, True) for i, d in part], schema).write.mode("append").parquet(f"{tmp_path}/in")
        S.stream_alerts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), searches, "2024-03-04", f"{tmp_path}/out", f"{tmp_path}/mailed", f"{tmp_path}/state", 1).awaitTermination()
    found = rows(spark.read.parquet(f"{tmp_path}/out"), "batch", "search_id", "job_id")
    assert found == [(0, 1, "b"), (1, 1, "e"), (1, 2, "e")]


def typo(rng, name):
    letters = list(name)
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(letters) + 1)
        letters[k : k + rng.randrange(2)] = rng.choice(["", "x", " ", "ab"])
    return "".join(letters)


@pytest.mark.parametrize("least", [90.0, 75.0])
def test_fuzzy_match_finds_all(spark, least):
    """Against all pairs, with typos in names of one token, one common token, and tokens of one letter."""
    rng = random.Random(2)
    words = ["apple", "microsoft", "inc", "corp", "holdings", "a", "ab", "data", "systems", "globex", "the", "umbrella", "aaaaaa", "international"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(90)] + ["Microsoft", "apple inc", "a b c e"]
    candidates = [typo(rng, rng.choice(names)) for _ in range(90)] + ["Microsft", "appleinc", "inc", "", " ", "a b c d"]
    frame = lambda xs: spark.createDataFrame([(x, None) for x in xs], "name string, domain string")
    found = {r.candidate: (r.match, round(r.score, 6)) for r in J.fuzzy_match(frame(candidates), frame(names), least).collect()}
    wanted = {}
    for x in set(candidates):
        score, name = min((-J.token_set_similarity(x, n), n) for n in set(names))
        if -score >= least:
            wanted[x] = (name, round(-score, 6))
    assert found == wanted and found["Microsft"][0] == "Microsoft"


def test_gate_computes_once(spark):
    """Each text is lowered once and no test is repeated, whatever columns and filters use the reason."""
    jobs = plain_jobs(spark, SF)
    plan = P.gate(jobs)[1].select("job_id", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 4 + len(presets.LANGUAGE_REQUIRED) and plan.count("lower(") == 2
    words = P.gate(spark.createDataFrame([(None, None), ("Engineer", "jlpt n2"), ("Engineer", "English only, jlpt"), ("Cook", "soup")], "title string, description string"))
    assert rows(words[1], "title", "reason") == [("Cook", "Non-IT: No IT keywords found"), ("Engineer", "Language: Detected Japanese requirement keyword: jlpt"), (None, "Non-IT: No IT keywords found")]
    assert words[0].count() == 1


def test_one_pass(spark):
    """The expression that branches by character finds what the patterns find one by one."""
    rng = random.Random(2)
    pieces = ["a", "b", "ab", "日本", r"\b", r"\s+", "[ab]", "c?", "(?:d|a)", "n1", r"\.", ".", "a{2}", "ba*", "^", "|"]
    texts = ["".join(rng.choice(["a", "b", "c", "d", " ", "日本", ".", "n1", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).cache()
    for _ in range(25):
        patterns = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))).strip("|") or "a" for _ in range(rng.randint(1, 8))]
        try:
            each = [re.compile(p) for p in patterns]
        except re.error:
            continue
        single = F.lit(False)
        for p in patterns:
            single = single | F.col("t").rlike(f"(?u){p}")
        assert df.where(single != P.any_pattern(F.col("t"), patterns)).collect() == [], (patterns, each)
    assert P.one_pass([r"\bdata\b", r"\bdev\b", r"\bdevops\b"]) == r"\b(?=[d])d(?:ata\b|ev(?:\b|ops\b))"


def test_blocks_change_nothing(spark, monkeypatch):
    names = ["m4_preference_score", "m5_criteria_score", "m6_semantic_topk", "j14_due_digests"]
    whole = {n: rows(QUERIES[n](spark, SF)) for n in names}
    monkeypatch.setattr(blocks, "SENT_BYTES", 700)
    assert all(rows(QUERIES[n](spark, SF)) == whole[n] for n in names)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("counted", [1000, 0])
def test_keyed_preferences(spark, monkeypatch, counted):
    """Users by their words, skills and places find what all pairs give, without a nested loop; those whom any job may please stay apart."""
    monkeypatch.setattr(keyed, "COUNTED", counted)
    rng = random.Random(4)
    words, skills, towns = ["alpha", "be", "c", "delta ray", "the", "Ünit", "日本", "x😀y", ""], ["Ai", "Go", "C++", "SQL", None], ["Tokyo", "To", "", "Remote", "Paris, France", "東京", None]
    some = lambda xs, k: rng.choice([None, []] + [[rng.choice(xs) for _ in range(rng.randint(1, k))]] * 4)
    pay = lambda: rng.choice([None, (0, 0), (40, 60), (70, 90)])
    jobs = spark.createDataFrame([(f"j{i}", rng.choice([None, "The Alpha", "delta"]), " ".join(some(words, 6) or []), rng.choice(towns), rng.choice(["Remote", "On-site", None]), some(skills, 3), pay()) for i in range(80)], "job_id string, title string, description string, location string, remote_type string, skills array<string>, salary struct<min:long,max:long>")
    person = lambda i, least: (f"u{i % 55}", some([*words, None], 3), some(words[:8], 1), some([*towns[:6], "remote europe", "Tokyo, Japan"], 2), some(skills, 4), some(skills, 2), rng.choice([None, 0, 50]), least)
    schema = "user_email string, keywords array<string>, exclude_keywords array<string>, locations array<string>, required_skills array<string>, preferred_skills array<string>, min_salary long, min_match_score long"
    users = spark.createDataFrame([person(i, rng.choice([None, 0, 30, 45, 60, 72, 85, 95])) for i in range(60)], schema)
    wanted = rows(M.preference_score(jobs, users, below=True).where("kept").drop("kept"))
    assert rows(M.preference_score(jobs, users)) == wanted and len(wanted) > 100
    picky = users.where("min_match_score >= 72 AND size(keywords) > 0 AND size(required_skills) > 0")
    found = M.preference_score(jobs, picky)
    assert "NestedLoop" not in plan_of(found) and rows(found) == rows(M.preference_score(jobs, picky, below=True).where("kept").drop("kept"))
    assert M.preference_score(jobs.limit(0), users).count() == 0 and M.preference_score(jobs, users.limit(0)).count() == 0


@pytest.mark.parametrize("counted", [1000, 0])
def test_keyed_criteria(spark, monkeypatch, counted):
    monkeypatch.setattr(keyed, "COUNTED", counted)
    rng = random.Random(5)
    words = ["alpha", "be", "c", "Delta ray", "日本", "go", "sql", "", None]
    some = lambda k: rng.choice([None, []] + [[rng.choice(words) for _ in range(rng.randint(1, k))]] * 6)
    jobs = spark.createDataFrame([(f"j{i}", rng.choice([None, "Alpha"]), " ".join(w or "" for w in some(5) or []), rng.choice(["", "Delta", "be", None]), some(3)) for i in range(60)], "job_id string, title string, description string, location string, skills array<string>")
    criteria = [(s, rng.choice(["keyword", "location", "skills", "other"]), some(4), rng.randint(1, 3), rng.choice([True, False, False, None])) for s in range(60) for _ in range(rng.randint(1, 3))]
    sets = spark.createDataFrame(criteria, "set_id int, type string, words array<string>, priority int, is_required boolean")
    wanted = rows(M.criteria_score(jobs, sets, zeros=True).where("score > 0"))
    assert rows(M.criteria_score(jobs, sets)) == wanted and len(wanted) > 100
    strict = sets.where("type = 'keyword' AND is_required")
    assert "NestedLoop" not in plan_of(M.criteria_score(jobs, strict))
    assert M.criteria_score(jobs, sets.limit(0)).count() == 0


def test_landed_scores(spark):
    jobs = spark.createDataFrame([(i, "llm", "c", []) for i in "abc"], "job_id string, title string, company string, skills array<string>")
    scores = spark.createDataFrame([("a", 9.0, "fits")], "job_id string, score double, reason string")
    answered = spark.createDataFrame([("a",), ("b",)], "job_id string")
    assert rows(M.landed_score(jobs, scores, answered), "job_id", "score", "reason") == [("a", 9.0, "fits"), ("b", 3.0, "Not scored"), ("c", 4.5, "Keyword match: llm")]


def test_weekly_reposts(spark):
    days = [datetime.datetime(2024, 1, 1 + 7 * k) for k in (0, 1, 2)] + [datetime.datetime(2024, 2, 5), datetime.datetime(2024, 1, 2)]
    jobs = spark.createDataFrame([("c", "t", d) for d in days] + [("c", "u", None)], "company string, title string, posted_date timestamp")
    assert rows(W.weekly_reposts(jobs)) == [("c", "t", 2, datetime.date(2024, 1, 1), 3)]


def test_snapshots(spark, tmp_path):
    """The newest whole one is current, an unfinished one isn't, and old ones go."""
    path = f"file://{tmp_path}/t"
    for n in range(1, 6):
        U.switch_snapshot(spark.range(n), path, keep=2)
    (tmp_path / "t" / "snapshot-99999999999999999999-unfinished").mkdir()
    assert U.current_snapshot(spark, path).count() == 5 and len(list((tmp_path / "t").glob("snapshot-*/_SUCCESS"))) == 2


def test_upsert_takes_the_last_change(spark):
    target = spark.createDataFrame([("a", 1, "x")], "k string, v int, other string")
    changes = spark.createDataFrame([("a", 5, 2), ("a", 4, 3), ("b", 7, 1)], "k string, v int, at int")
    assert rows(U.upsert(target, changes, ["k"], ["v"], [F.col("at")])) == [("a", 4, "x"), ("b", 7, None)]


def test_cards(spark):
    page = '<div data-test="JobResult"><h2>A <b>b</b></h2><p class="styles_location__q9">Oslo</p><a data-test="JobTitleLink" href="/j/1">x</a></div><div data-test="JobResult"><span>none</span></div>'
    found = extract_cards(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).orderBy("pos").collect()
    assert [(r.title, r.location, r.href) for r in found] == [("A b", "Oslo", "/j/1"), (None, None, None)]


def test_bad_payloads_give_no_rows(spark):
    bad = spark.createDataFrame([("c", None, datetime.datetime(2024, 1, 1), "b", "list", body) for body in ("", "not json", "{}", None, "[]")], "company string, company_location string, fetched_at timestamp, board string, kind string, body string")
    for normalise in NORMALISERS.values():
        assert normalise(bad).count() == 0


def test_quota_and_latest(spark):
    df = spark.createDataFrame([("u", i, i) for i in range(9)] + [("v", 1, 1)], "user string, created int, id int")
    assert W.enforce_quota(df, "user", "created", "id").count() == 6
    assert rows(W.latest_per_key(df, ["user"], [F.col("created")]), "user", "id") == [("u", 8), ("v", 1)]


def test_collection_report(spark):
    co = spark.createDataFrame([("a",), ("b",)], "name string")
    col = spark.createDataFrame([("k", (["a", "z"],))], "id string, data struct<companies: array<string>>")
    here, missing = J.collection_members(col, co, "k")
    assert rows(here) == [("a",)] and rows(missing) == [("z",)]


@pytest.mark.parametrize(("pattern", "literals"), [
    ("python", [["python"]]), ("fr|de", [["fr"], ["de"]]), (r"c\+\+", [["c++"]]), (r"\bml\b", [["ml"]]), ("colou?r", [["colo", "r"]]), ("a{0,2}bc", [["bc"]]), ("ab{2}c", [["ab", "c"]]), ("ab+?c", [["ab", "c"]]), ("x(yy|z)w", [["x", "w"]]),
    ("[abc]de.fg$", [["de", "fg"]]), ("Größe", [["gr", "e"]]), (".*", None), ("a|", None), ("a?|bc", None), ("(?x)a b", None), (r"\x41b", None), (r"\Qa|b\E", None), (r"[a[b]]c", None), ("(a|b)", None), (r"\d+ years", [[" years"]]), ("a||b", None),
])
def test_required_literals(pattern, literals):
    assert alerts.required_literals(pattern) == literals


def test_alerts_of_many_searches(spark, monkeypatch):
    """100,000 searches of some 1,500 patterns against every posting, and searches whose cases and alphabets are odd."""
    jobs = view(spark, "/root/testdata/sf0.1", "postings").select("job_id", "title", "company", "location", "remote_type", "skills", "posted_date", "is_active")
    odd = [("odd1", "Kelvin ſtaff", "x", "İzmir", None, ["straße"]), ("odd2", "KELVIN STAFF", None, "izmir", "Remote", None), ("odd3", None, "ıx", None, None, []), ("odd4", "a\nb", "c++", "Remote city", "Hybrid", ["x"])]
    more = spark.createDataFrame([(*x, datetime.datetime(2024, 3, 20), True) for x in odd], "job_id string, title string, company string, location string, remote_type string, skills array<string>, posted_date timestamp, is_active boolean")
    jobs = jobs.unionByName(more)
    stored = [r.asDict() for r in jobs.where("is_active").collect()]
    rng = random.Random(0)
    words = sorted({w.lower() for r in stored[::40] for w in (r["title"] or "").split() if w.isalnum()})
    pool = [rng.choice(words) for _ in range(700)] + [f"{rng.choice(words)}|{rng.choice(words)}" for _ in range(150)] + [rf"\b{rng.choice(words)}.?{rng.choice(words)[:2]}" for _ in range(100)]
    pool += ["kelvin", "STAFF", "izmir", "ix", r"c\+\+", "strasse|Straße", "a.b", "^the", r"\d{2}", "", None, "(?i)THE AND", "[tT]he (the|and)"]
    patterns = [(q, rng.choice([None, None, "", "en", "remote", "fr|de", "izm", ".*y"]), rng.choice([None, None, None, "tech", r"\bai\b", "Ux|zz"])) for q in pool for _ in range(2)]
    searches = []
    for k in range(100_000):
        q, place, category = patterns[k] if k < len(patterns) else rng.choice(patterns)
        searches.append((k, f"u{k % 900}", q, place, category, k % 50 != 7, datetime.datetime(2024, 1, 1 + k % 28) if k % 3 else None))
    schema = "search_id long, user_email string, q string, location string, category string, email_alert boolean, last_emailed_at timestamp"
    df = spark.createDataFrame(searches, schema).select("search_id", "user_email", "email_alert", "last_emailed_at", F.struct("q", "location", "category").alias("criteria"))
    stored.sort(key=lambda r: r["job_id"])
    stored.sort(key=lambda r: r["posted_date"], reverse=True)
    tests, newest = {}, {}

    def hits(pattern, texts):
        if (pattern, texts) not in tests:
            test = re.compile(pattern.replace("(?i)", ""), re.IGNORECASE)
            columns = {"q": ("title", "company", "skills"), "category": ("title", "skills"), "location": ("location",)}[texts]
            found = set()
            for n, r in enumerate(stored):
                if any(test.search(x) for x in ("\n".join(r[c] or []) if c == "skills" else r[c] for c in columns) if x is not None) or (texts == "location" and pattern == "remote" and r["remote_type"] == "Remote"):
                    found.add(n)
            tests[pattern, texts] = found
        return tests[pattern, texts]

    def matches(q, place, category):
        if (q, place, category) not in newest:
            own = set(range(len(stored)))
            for x, texts in ((q, "q"), (place, "location"), (category, "category")):
                own &= hits(x, texts) if x else own
            newest[q, place, category] = sorted(own)[:3]
        return newest[q, place, category]

    wanted = set()
    for i, _, q, place, category, on, last in searches:
        cutoff = last or datetime.datetime(2024, 3, 14)
        if on:
            wanted.update((i, stored[n]["job_id"], rank + 1) for rank, n in enumerate(n for n in matches(q, place, category) if stored[n]["posted_date"] > cutoff))
    found = J.match_alerts(df, jobs, "2024-03-15", 3)
    assert {tuple(r) for r in found.select("search_id", "job_id", "rank").collect()} == wanted and len(wanted) > 50_000
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    some = df.where("search_id < 300")
    whole = rows(J.match_alerts(some, jobs, "2024-03-15", 3))
    monkeypatch.setattr(blocks, "SENT_BYTES", 20_000)
    monkeypatch.setattr(alerts, "COUNTED", 10)
    assert rows(J.match_alerts(some, jobs, "2024-03-15", 3)) == whole
