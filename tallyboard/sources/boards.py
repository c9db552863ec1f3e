"""Landed job-board payloads as postings of one shape (inventory S3-S9, S11, S14).

A landed row has company, company_location, fetched_at, board (token or base URL) and body (the payload's text).
A payload of unknown shape gives no rows; a field that a source lacks is null."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions import presets
from tallyboard.functions.links import absolute_url, escaped_html_text, html_text
from tallyboard.functions.text import compose_location, content_hash, empty_if_null, extract_skills, job_type, parse_posted, remote_type, salary_range, tag_location

POSTING = [
    "job_id", "title", "company", "location", "company_location", "description", "source", "source_url", "posted_date", "scraped_at",
    "last_seen_at", "content_hash", "is_active", "job_type", "remote_type", "skills", "salary", "raw_data",
]


def _postings(df: DataFrame, source: str) -> DataFrame:
    """Common shape from columns id, raw_title, raw_location, url, description, posted_date and the facets."""
    location = tag_location(F.col("raw_location"), F.col("company_location"))
    df = df.withColumn("location", location)
    return df.select(
        F.concat(F.lit(f"{source}_"), F.col("id")).alias("job_id"), F.trim("raw_title").alias("title"), "company", "location", "company_location", "description",
        F.lit(source).alias("source"), F.col("url").alias("source_url"), "posted_date", F.col("fetched_at").alias("scraped_at"), F.col("fetched_at").alias("last_seen_at"),
        content_hash(F.trim("raw_title"), F.col("description"), F.col("location")).alias("content_hash"), F.lit(True).alias("is_active"), "job_type", "remote_type", "skills", "salary", "raw_data",
    )


def _rows(landed: DataFrame, path: str | None, item: str) -> DataFrame:
    """One row per element of the payload's list: below `path`, or the bare array."""
    bare = F.from_json("body", f"array<{item}>")
    listed = F.from_json("body", f"struct<{path}: array<{item}>>")[path] if path else bare
    is_array = F.startswith(F.ltrim("body"), F.lit("["))
    return landed.withColumn("j", F.explode(F.when(is_array, bare).otherwise(listed)))


GREENHOUSE = "struct<id: string, title: string, absolute_url: string, location: string, departments: array<struct<name: string>>, updated_at: string, created_at: string, content: string, description: string>"


def normalise_greenhouse(landed: DataFrame, text: Callable[[Column], Column] = escaped_html_text) -> DataFrame:
    """Lists (kind ``list``) joined with details (kind ``detail``), which win. Rows without a title or without a detail are dropped."""
    listed = _rows(landed.where("kind = 'list'"), "jobs", GREENHOUSE).select("company", "company_location", "fetched_at", "board", "j")
    detail = landed.where("kind = 'detail'").select("company", "board", F.from_json("body", GREENHOUSE).alias("d"))
    both = listed.join(detail.withColumn("_id", F.col("d.id")), (listed["company"] == detail["company"]) & (listed["board"] == detail["board"]) & (F.col("j.id") == F.col("_id"))).select(listed["company"], listed["company_location"], listed["fetched_at"], listed["board"], "j", "d")
    pick = lambda c: F.coalesce(F.col(f"d.{c}"), F.col(f"j.{c}"))
    none = lambda c: F.nullif(c, F.lit(""))
    place = pick("location")
    name = F.get_json_object(place, "$.name")
    df = both.select(
        "company", "company_location", "fetched_at", pick("id").alias("id"), F.trim(empty_if_null(pick("title"))).alias("raw_title"),
        F.when(F.startswith(place, F.lit("{")), empty_if_null(name)).otherwise(empty_if_null(place)).alias("raw_location"),
        F.coalesce(none(pick("absolute_url")), F.concat(F.lit("https://boards.greenhouse.io/"), F.col("board"), F.lit("/jobs/"), pick("id"))).alias("url"),
        text(F.coalesce(none(pick("content")), pick("description"))).alias("description"),
        parse_posted(F.coalesce(none(pick("updated_at")), pick("created_at"))).alias("posted_date"),
        F.to_json(F.struct(pick("id").alias("id"), F.col("board").alias("board_token"), F.transform(pick("departments"), lambda d: d["name"]).alias("departments"))).alias("raw_data"),
    ).where("raw_title <> ''")
    return _postings(_facets(df), "greenhouse")


def _facets(df: DataFrame, commitment: Column | None = None) -> DataFrame:
    return df.withColumns({
        "job_type": job_type(F.col("raw_title"), F.col("description"), commitment), "remote_type": remote_type(F.col("raw_location"), F.col("description")),
        "skills": extract_skills(F.col("description")), "salary": salary_range(F.col("description")),
    })


LEVER = "struct<id: string, text: string, hostedUrl: string, categories: struct<location: string, commitment: string>, description: string, lists: array<struct<text: string, content: string>>, descriptionPlain: string, createdAt: bigint, additional: string>"


def normalise_lever(landed: DataFrame, text: Callable[[Column], Column] = html_text) -> DataFrame:
    df = _rows(landed, None, LEVER)
    lists = F.array_join(F.transform(F.filter(F.coalesce("j.lists", F.array()), lambda x: (x["text"] != "") & (x["content"] != "")), lambda x: F.concat(F.lit("<h3>"), x["text"], F.lit("</h3>"), x["content"])), "")
    whole = text(F.concat(empty_if_null(F.col("j.description")), empty_if_null(lists)))
    df = df.select(
        "company", "company_location", "fetched_at", F.col("j.id").alias("id"), F.trim(empty_if_null(F.col("j.text"))).alias("raw_title"), empty_if_null(F.col("j.categories.location")).alias("raw_location"),
        F.col("j.categories.commitment").alias("commitment"), F.coalesce(F.nullif("j.hostedUrl", F.lit("")), F.concat(F.lit("https://jobs.lever.co/"), F.col("board"), F.lit("/"), F.col("j.id"))).alias("url"),
        F.coalesce(F.nullif(whole, F.lit("")), empty_if_null(F.col("j.descriptionPlain"))).alias("description"), F.timestamp_millis("j.createdAt").alias("posted_date"), F.to_json(F.struct("j.categories", "j.additional")).alias("raw_data"),
    ).where("raw_title <> ''")
    return _postings(_facets(df, F.col("commitment")), "lever")


ASHBY = "struct<id: string, title: string, location: string, address: struct<city: string, region: string, country: string>, isRemote: boolean, jobUrl: string, descriptionHtml: string, description: string, publishedAt: string, employmentType: string, compensation: struct<min: double, max: double, currency: string>>"


def normalise_ashby(landed: DataFrame, text: Callable[[Column], Column] = html_text) -> DataFrame:
    """The API's JSON, or the JSON that a page embeds. Job type and remote facet are kept; a missing or bad date is the fetch time."""
    page = F.regexp_extract("body", presets.EMBEDDED, 1)
    embedded = F.from_json(page, f"struct<props: struct<pageProps: struct<jobBoard: struct<jobs: array<{ASHBY}>>>>>")["props"]["pageProps"]["jobBoard"]["jobs"]
    df = landed.withColumn("j", F.explode(F.when(page != "", embedded).otherwise(F.from_json("body", f"struct<jobs: array<{ASHBY}>>")["jobs"])))
    place = F.col("j.location")
    parts = [F.coalesce(F.get_json_object(place, f"$.{k}"), F.when(F.coalesce(place, F.lit("")) == "", F.col(f"j.address.{k}"))) for k in ("city", "region", "country")]
    plain = F.when((place != "") & ~F.startswith(place, F.lit("{")), place)
    location = F.coalesce(plain, compose_location(parts, F.col("j.isRemote")))
    description = F.coalesce(text(F.coalesce(F.nullif("j.descriptionHtml", F.lit("")), F.col("j.description"))), F.lit(""))
    remote = F.coalesce("j.isRemote", F.lit(False))
    df = df.select("company", "company_location", "fetched_at", "board", "j", location.alias("raw_location"), description.alias("description"))
    pay = F.when(F.coalesce("j.compensation.min", F.lit(0)) != 0, F.struct(F.col("j.compensation.min").cast("long").alias("min"), F.col("j.compensation.max").cast("long").alias("max"), F.coalesce("j.compensation.currency", F.lit("USD")).alias("currency")))
    df = df.select(
        "company", "company_location", "fetched_at", F.col("j.id").alias("id"), F.coalesce("j.title", F.lit("Unknown Role")).alias("raw_title"), "raw_location", "description",
        F.coalesce(F.nullif("j.jobUrl", F.lit("")), F.concat(F.rtrim("board", F.lit("/")), F.lit("/"), F.col("j.id"))).alias("url"), parse_posted(F.col("j.publishedAt"), "iso", F.col("fetched_at")).alias("posted_date"),
        F.coalesce("j.employmentType", F.lit("Full-time")).alias("job_type"), F.when(remote, "Remote").when(F.contains(F.lower("raw_location"), F.lit("hybrid")), "Hybrid").otherwise("On-site").alias("remote_type"),
        extract_skills(F.col("description")).alias("skills"), F.coalesce(salary_range(F.col("description")), pay).alias("salary"), F.to_json("j").alias("raw_data"),
    )
    return _postings(df, "ashby")


NO_PAY = "struct<min: bigint, max: bigint, currency: string>"
WORKDAY = "struct<title: string, externalPath: string, locationsText: string, description: string>"


def normalise_workday(landed: DataFrame) -> DataFrame:
    df = _rows(landed, "jobPostings", WORKDAY)
    path = empty_if_null(F.col("j.externalPath"))
    last = lambda sep: F.element_at(F.split(path, sep), -1)
    df = df.select(
        "company", "company_location", "fetched_at", F.when(F.contains(path, F.lit("_")), last("_")).otherwise(last("/")).alias("id"), empty_if_null(F.col("j.title")).alias("raw_title"),
        empty_if_null(F.col("j.locationsText")).alias("raw_location"), F.concat("board", path).alias("url"), empty_if_null(F.col("j.description")).alias("description"), F.lit(None).cast("timestamp").alias("posted_date"),
        F.lit("Full-time").alias("job_type"), F.lit("On-site").alias("remote_type"), F.array().cast("array<string>").alias("skills"), F.lit(None).cast(NO_PAY).alias("salary"), F.to_json("j").alias("raw_data"),
    )
    return _postings(df, "workday")


WORKABLE = "struct<shortcode: string, title: string, location: struct<city: string, country: string>, description: string, published: string, type: string, workplace: string>"


def normalise_workable(landed: DataFrame) -> DataFrame:
    df = _rows(landed, "results", WORKABLE).where(F.coalesce("j.shortcode", F.lit("")) != "")
    title = F.trim(empty_if_null(F.col("j.title")))
    place = F.trim(F.concat(empty_if_null(F.col("j.location.city")), F.lit(", "), empty_if_null(F.col("j.location.country"))), F.lit(", "))
    description = F.coalesce(F.nullif("j.description", F.lit("")), title)
    df = df.select(
        "company", "company_location", "fetched_at", F.col("j.shortcode").alias("id"), title.alias("raw_title"), place.alias("raw_location"),
        F.concat(F.lit("https://apply.workable.com/"), F.col("board"), F.lit("/j/"), F.col("j.shortcode"), F.lit("/")).alias("url"), description.alias("description"), parse_posted(F.col("j.published")).alias("posted_date"),
        F.coalesce("j.type", F.lit("Full-time")).alias("job_type"), F.coalesce("j.workplace", F.lit("On-site")).alias("remote_type"), extract_skills(description).alias("skills"), F.lit(None).cast(NO_PAY).alias("salary"), F.lit(None).cast("string").alias("raw_data"),
    )
    return _postings(df, "workable")


class _Cards(HTMLParser):
    """Texts of the parts of repeated cards. A part is found by tag, by a class prefix or by an attribute."""

    def __init__(self, selectors: dict):
        super().__init__()
        self.s, self.cards, self.open, self.depth = selectors, [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
        fits = lambda x: all((tag == v) if k == "tag" else any(c.startswith(v) for c in a.get("class", "").split()) if k == "class" else a.get(k) == v for k, v in x.items())
        if fits(self.s["card"]):
            self.cards.append({})
        if self.cards:
            for part, x in self.s.items():
                if part != "card" and part not in self.cards[-1] and fits(x):
                    self.cards[-1][part] = ""
                    self.open.append((part, self.depth, len(self.cards) - 1))
                    if part == "link":
                        self.cards[-1]["href"] = a.get("href", "")

    def handle_endtag(self, tag):
        self.open = [x for x in self.open if x[1] < self.depth]
        self.depth -= 1

    def handle_data(self, data):
        for part, _, card in self.open:
            self.cards[card][part] += data


CARDS = {"card": {"tag": "div", "data-test": "JobResult"}, "title": {"tag": "h2"}, "company": {"class": "styles_companyName__"}, "location": {"class": "styles_location__"}, "description": {"class": "styles_description__"}, "link": {"tag": "a", "data-test": "JobTitleLink"}}


def extract_cards(pages: DataFrame, selectors: dict = CARDS) -> DataFrame:
    """(url, pos, title, company, location, description, href) of each card of the pages (url, html)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                parser = _Cards(selectors)
                parser.feed(page or "")
                for i, c in enumerate(parser.cards):
                    rows.append([url, i, *[c.get(k, "").strip() if k in c else None for k in ("title", "company", "location", "description", "href")]])
            yield pd.DataFrame(rows, columns=["url", "pos", "title", "company", "location", "description", "href"])

    return pages.select("url", "html").mapInPandas(run, "url string, pos int, title string, company string, location string, description string, href string")


def normalise_cards(landed: DataFrame, origin: str, selectors: dict = CARDS) -> DataFrame:
    """Card listings (company, company_location, fetched_at, board, body) as postings; ids are hashes of the links."""
    keyed = landed.withColumn("_key", F.md5(F.concat_ws("|", "company", "board", F.col("fetched_at").cast("string"), "body")))
    found = extract_cards(keyed.select(F.col("_key").alias("url"), F.col("body").alias("html")).dropDuplicates(["url"]), selectors).withColumnRenamed("url", "_key").withColumnsRenamed({"company": "_company", "description": "_text"})
    df = keyed.dropDuplicates(["_key"]).join(found, "_key")
    url = F.when(F.coalesce("href", F.lit("")) != "", absolute_url(F.lit(origin), "href")).otherwise("")
    df = df.select(
        F.coalesce(F.nullif("_company", F.lit("")), F.col("company")).alias("company"), "company_location", "fetched_at", F.md5(url).alias("id"), F.coalesce("title", F.lit("Unknown Title")).alias("raw_title"), empty_if_null(F.col("location")).alias("raw_location"),
        url.alias("url"), empty_if_null(F.col("_text")).alias("description"), F.col("fetched_at").alias("posted_date"), F.lit(None).cast("string").alias("job_type"), F.lit(None).cast("string").alias("remote_type"), F.lit(None).cast("array<string>").alias("skills"), salary_range(F.col("_text")).alias("salary"), F.lit(None).cast("string").alias("raw_data"),
    )
    return _postings(df, "cards")


JSONLD = r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""
LD_POSTING = "struct<`@type`: string, title: string, description: string, datePosted: string, employmentType: string, hiringOrganization: struct<name: string>, jobLocation: struct<address: struct<addressLocality: string>>>"


def extract_jsonld(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' columns with one row per schema.org JobPosting: ld_title, ld_company, ld_location, ld_description, ld_date, ld_type."""
    found = F.transform(F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1)), lambda x: F.from_json(x, LD_POSTING))
    df = pages.withColumn("_ld", F.explode(F.filter(found, lambda x: F.coalesce(x["@type"] == "JobPosting", F.lit(False)))))
    fields = {"ld_title": "title", "ld_company": "hiringOrganization.name", "ld_location": "jobLocation.address.addressLocality", "ld_description": "description", "ld_date": "datePosted", "ld_type": "employmentType"}
    return df.select(*pages.columns, *[F.col(f"_ld.{p}").alias(n) for n, p in fields.items()])


def all_postings(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def parse_json_array(df: DataFrame, column: str, item: str) -> DataFrame:
    """One row per element of the array between the first ``[`` and the last ``]`` of a response text; text that isn't JSON gives no rows."""
    found = F.from_json(F.regexp_extract(column, r"(?s)\[.*\]", 0), f"array<{item}>")
    return df.withColumn("item", F.explode(found)).where(F.col("item").isNotNull())


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": normalise_greenhouse, "lever": normalise_lever, "ashby": normalise_ashby, "workday": normalise_workday, "workable": normalise_workable}
"""By adapter; users add their own."""
