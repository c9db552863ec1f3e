"""Literal cases of scalar functions, quirks included."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyboard.functions import links
from tallyboard.functions import text as X
from tallyboard.operators import filters as P
from tallyboard.operators import joins as J
from tallyboard.operators import scoring as M

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(v):
    return L(v).cast("string")


@pytest.mark.parametrize(("given", "expected"), [("  Review  ", "Review"), ("Google Inc.", "Google"), ("Amazon.com", "Amazon"), ("a.b.com", "a.b.com"), (None, ""), ("Acme Co Inc", "Acme")])
def test_normalise_company(spark, given, expected):
    assert value(spark, X.normalise_company(text(given))) == expected


@pytest.mark.parametrize(("given", "expected"), [("Oxide Computer Company", "Oxide Computer"), ("Noveon Magnetics Inc.", "Noveon Magnetics"), ("Skild AI", "Skild AI"), ("Foo LLC Company", "Foo LLC")])
def test_strip_suffix(spark, given, expected):
    # the first suffix of the list that ends the name, not the longest
    assert value(spark, X.strip_suffix(text(given))) == expected


@pytest.mark.parametrize(("title", "body", "expected"), [("Internal Auditor", "", "Internship"), ("Contract", "part-time", "Contract"), ("x", "Part Time", "Part-time"), ("x", None, "Full-time")])
def test_job_type(spark, title, body, expected):
    assert value(spark, X.job_type(text(title), text(body))) == expected


@pytest.mark.parametrize(("place", "body", "expected"), [("Remote", "hybrid team", "Hybrid"), ("Remote", "", "Remote"), ("NYC", None, "On-site")])
def test_remote_type(spark, place, body, expected):
    assert value(spark, X.remote_type(text(place), text(body))) == expected


@pytest.mark.parametrize(("given", "compat", "expected"), [("$100k - $150k", True, (100000, 150000)), ("$100,000 - $150,000", True, (100, 150)), ("$100,000 - $150,000", False, (100000, 150000)), ("none", True, None)])
def test_salary(spark, given, compat, expected):
    found = value(spark, X.salary_range(text(given), compat))
    assert (found and (found["min"], found["max"])) == expected


def test_skills(spark):
    assert set(value(spark, X.extract_skills(text("google node.js ci/cd javascript")))) == {"Go", "Node.Js", "Ci/Cd", "Java", "Javascript"}
    assert value(spark, X.extract_skills(text(None))) == []


@pytest.mark.parametrize(("place", "home", "expected"), [("Hybrid", "Japan", "Hybrid (Japan)"), ("", "Japan", "Japan"), ("Tokyo", "Japan", "Tokyo"), (None, None, ""), ("Remote", None, "Remote")])
def test_tag_location(spark, place, home, expected):
    assert value(spark, X.tag_location(text(place), text(home))) == expected


def test_vendor_and_token(spark):
    url = text("https://boards.greenhouse.io/embed/job_board?for=acme")
    assert value(spark, X.vendor_of(url)) == "greenhouse"
    assert value(spark, X.board_token(L("greenhouse"), url, text(None), text("x.com"), text("X"))) == "acme"
    assert value(spark, X.vendor_of(text("https://jobs.lever.co/acme/1"))) == "lever"
    assert value(spark, X.board_token(L("workable"), text("https://apply.workable.com/rakuten/"), text(None), text("x.com"), text("X"))) == "rakuten"
    assert value(spark, X.board_token(L("lever"), text(None), text(None), text("a.b.com"), text("X"))) == "ab"


@pytest.mark.parametrize(("url", "slug"), [("https://www.acme.com/x", "acme"), ("https://careers.acme.co.jp", "co"), ("https://jobs.com", "jobs"), ("https://global.acme.io", "acme")])
def test_slug(spark, url, slug):
    assert value(spark, X.slug_of(text(url))) == slug


@pytest.mark.parametrize(("days", "expected"), [(None, "stale"), (8, "warn"), (15, "stale"), (7, "ok")])
def test_check_bucket(spark, days, expected):
    at = datetime.datetime(2024, 3, 31)
    ts = None if days is None else at - datetime.timedelta(days=days)
    assert value(spark, X.check_bucket(L(ts).cast("timestamp"), L(at))) == expected


@pytest.mark.parametrize(("frequency", "hours", "expected"), [("daily", None, True), ("daily", 22.99, False), ("daily", 23, True), ("weekly", 143, False), ("weekly", 144, True), ("off", 1000, False)])
def test_due(spark, frequency, hours, expected):
    at = datetime.datetime(2024, 3, 31)
    last = None if hours is None else at - datetime.timedelta(hours=hours)
    assert value(spark, J.due(L(frequency), L(last).cast("timestamp"), L(at))) is expected


TITLES = {"Software Engineer": True, "Staff Technical Program Manager": True, "Data Scientist": True, "Manager, Sales": False, "Technical Accounting Manager": True, "Recruiting Coordinator": False, "Sales Engineer": True, "UX Designer": True, "": False}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "title string").select("title", P.classify_it(F.col("title"))["flag"].alias("flag"))
    assert {r.title: r.flag for r in df.collect()} == TITLES


@pytest.mark.parametrize(("given", "expected"), [("No Japanese required, JLPT N1 a plus", True), ("JLPT N2", False), ("", True), (None, True), ("column1", False)])
def test_language(spark, given, expected):
    assert value(spark, P.classify_language(text(given)))["flag"] is expected


def test_keyword_score(spark):
    rows = [("1", "LLM platform engineer", "x", []), ("2", "cuda LLM", "x", None), ("3", "llm rag genai mlops kubernetes terraform", "aws", ["ml platform"]), ("4", "clerk", "x", [])]
    df = M.keyword_score(spark.createDataFrame(rows, "job_id string, title string, company string, skills array<string>"))
    found = {r.job_id: (r.score, r.reason) for r in df.collect()}
    assert found["1"] == (6.0, "Keyword match: llm, platform engineer")
    assert found["2"] == (0.0, "Keyword match: Excluded: contains 'cuda'")
    assert found["3"][0] == 10.0
    assert found["4"] == (3.0, "Low signal match")


def test_similarity():
    assert J.token_set_similarity("Segment", "Twilio Segment") == 100.0
    assert J.token_set_similarity("Acme Robotics", "Zebra Logistics") < 90
    assert J.token_set_similarity(None, "x") == 0.0


def test_html():
    page = "<p>A &amp; b</p><script>x()</script>\n <div> c<br>d </div>"
    assert links.text_of(page) == "A & b\nc\nd"
    assert "x()" in links.text_of(page, skip_scripts=False)
    assert links.text_of("&lt;p&gt;hi&lt;/p&gt;", unescape=True) == "hi"


def test_absolute(spark):
    base = "https://a.example.com/x/y?q#z"
    for href, want in {"/b": "https://a.example.com/b", "//c.example.com/": "https://c.example.com/", "http://d.example.com": "http://d.example.com", "e": "https://a.example.com/x/e"}.items():
        assert value(spark, links.absolute_url(L(base), L(href))) == want
