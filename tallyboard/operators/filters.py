"""Predicates and splits: search facets, classifiers, gates, validation and repairs (inventory F)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions import presets
from tallyboard.functions.text import any_contains, empty_if_null


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where("is_active")


def keyword_match(q: str) -> Column:
    """Every blank-separated term is a literal, case-insensitive part of title, company, description or a skill."""
    out = F.lit(True)
    for term in (q or "").split():
        t = F.lit(term.lower())
        hit = F.exists("skills", lambda s: F.contains(F.lower(s), t))
        for c in ("title", "company", "description"):
            hit = F.coalesce(F.contains(F.lower(F.col(c)), t), F.lit(False)) | F.coalesce(hit, F.lit(False))
        out = out & hit
    return out


def keyword_filter(jobs: DataFrame, q: str) -> DataFrame:
    return jobs.where(keyword_match(q))


def company_filter(jobs: DataFrame, company: str | None = None, companies: Sequence[str] | None = None) -> DataFrame:
    """A list of companies takes the place of a single one."""
    if companies:
        return jobs.where(F.col("company").isin(list(companies)))
    return jobs.where(F.col("company") == company) if company else jobs


def facet_filter(jobs: DataFrame, job_type: str | None = None, remote_type: str | None = None) -> DataFrame:
    for c, v in (("job_type", job_type), ("remote_type", remote_type)):
        jobs = jobs.where(F.col(c) == v) if v else jobs
    return jobs


def location_match(locations: Sequence[str], aliases: Mapping[str, str] = presets.LOCATION_ALIASES) -> Column | None:
    """OR over the places. A place is a regular expression (as users type it), aliases widen it; ``remote`` also means the facet."""
    out = None
    for place in locations:
        if not place:
            continue
        if place.lower() == "remote":
            hit = F.col("location").rlike("(?iu)remote") | (F.col("remote_type") == "Remote")
        else:
            pattern = f"(?iu){aliases.get(place.lower(), place)}"
            hit = F.col("location").rlike(pattern) | F.col("company_location").rlike(pattern)
        hit = F.coalesce(hit, F.lit(False))
        out = hit if out is None else out | hit
    return out


def location_filter(jobs: DataFrame, locations: Sequence[str] | None = None, location: str | None = None, aliases: Mapping[str, str] = presets.LOCATION_ALIASES) -> DataFrame:
    test = location_match(locations or ([location] if location else []), aliases)
    return jobs if test is None else jobs.where(test)


def category_filter(jobs: DataFrame, category: str | None, vocabulary: Mapping[str, Sequence[str]] = presets.CATEGORIES) -> DataFrame:
    """Any word of the category in title or a skill; an unknown category filters nothing."""
    words = vocabulary.get(category) if category else None
    if not words:
        return jobs
    pattern = "(?iu)" + "|".join(words)
    return jobs.where(F.coalesce(F.col("title").rlike(pattern), F.lit(False)) | F.coalesce(F.exists("skills", lambda s: s.rlike(pattern)), F.lit(False)))


def since(jobs: DataFrame, days: int | None, as_of: str) -> DataFrame:
    """Posted at or after as_of minus days; 0 or None filters nothing, null dates never match."""
    if not days:
        return jobs
    return jobs.where(F.col("posted_date") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))


def matching_jobs(jobs: DataFrame, as_of: str, q: str = "", company: str | None = None, companies: Sequence[str] | None = None, job_type: str | None = None, remote_type: str | None = None, location: str | None = None, locations: Sequence[str] | None = None, category: str | None = None, days: int | None = None, aliases: Mapping[str, str] = presets.LOCATION_ALIASES, categories: Mapping[str, Sequence[str]] = presets.CATEGORIES) -> DataFrame:
    """The faceted search without order and page. Cheap equalities and the date come first, so they reach the scan."""
    out = since(facet_filter(company_filter(active(jobs), company, companies), job_type, remote_type), days, as_of)
    return keyword_filter(category_filter(location_filter(out, locations, location, aliases), category, categories), q)


def search_jobs(jobs: DataFrame, as_of: str, skip: int = 0, limit: int = 100, **facets) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest first, ties by job_id; total has one row with a column ``total``."""
    found = matching_jobs(jobs, as_of, **facets)
    page = found.orderBy(F.col("posted_date").desc_nulls_last(), "job_id").offset(skip).limit(limit)
    return page, found.agg(F.count(F.lit(1)).alias("total"))


def search_companies(companies: DataFrame, q: str) -> DataFrame:
    return companies.where(F.col("name").rlike(f"(?iu){q}")) if q else companies


def company_jobs(jobs: DataFrame, name: str) -> DataFrame:
    return active(jobs).where(F.col("company") == name).orderBy(F.col("posted_date").desc_nulls_last(), "job_id")


def settled(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """`df` with the columns added or replaced through a generator of one row: each is computed once a row, whatever refers to it
    later. Filters and columns above a plain projection would compute its expressions again."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


#: One step of a pattern: an escape, a class, or a character, with its quantifier.
STEP = re.compile(r"(\\[^\W_]|\\\W|\[\^?[^\]\[\\&]+\]|[^\\\[(){|*+?])([*+?][+?]?|\{\d+(?:,\d*)?\}[+?]?)?", re.S)
#: Escapes that take more than one character.
LONG_ESCAPES = "QEupPxkcN0123456789"


def _steps(pattern: str) -> list[str]:
    """The pattern in steps, or as a single one where it holds groups, alternatives or escapes of many characters."""
    out, i = [], 0
    while i < len(pattern):
        step = STEP.match(pattern, i)
        if not step or step[1][0] == "\\" and step[1][1] in LONG_ESCAPES:
            return [f"(?:{pattern})"]
        out.append(step[0])
        i = step.end()
    return out


def one_pass(patterns: Sequence[str]) -> str:
    """An expression that is found where any of the patterns is. Equal beginnings are tested once (a trie), and characters that begin
    none of them are passed over by one test, so its time hardly depends on how many patterns there are."""
    root: dict = {}
    for p in patterns:
        node = root
        for step in _steps(p):
            node = node.setdefault(step, {})
        node[""] = {}

    def text(node: dict) -> str:
        if "" in node:  # whatever is longer is found here too
            return ""
        ways = [step + text(rest) for step, rest in node.items()]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    start, node = "", root
    if list(node) == [r"\b"]:
        start, node = r"\b", node[r"\b"]
    plain = all(len(step) == 1 and step.isalnum() for step in node)
    return start + (f"(?=[{''.join(node)}])" if plain and node else "") + text(node)


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?u)" + one_pass(patterns)) if patterns else F.lit(False)


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern of the list that the text matches, or null. One test of all patterns comes first, which most texts fail."""
    out = None
    for p in patterns:
        hit = text.rlike(f"(?u){p}")
        out = F.when(hit, p) if out is None else out.when(hit, p)
    if out is None:
        return F.lit(None).cast("string")
    return F.when(any_pattern(text, patterns), out) if len(patterns) > 3 else out


def classify_it(text: Column, is_title: bool = True, roles: Sequence[str] = presets.IT_ROLES, others: Sequence[str] = presets.NON_IT_TITLES) -> Column:
    """struct(flag, reason). A title with a foreign word and no role word is out; else the first role word decides."""
    low = F.lower(empty_if_null(text))
    role = first_pattern(low, roles)
    no = lambda reason: F.struct(F.lit(False).alias("flag"), reason.alias("reason"))
    out = F.when(low == "", no(F.lit("No text provided")))
    if is_title:
        other = first_pattern(low, others)
        out = out.when(~any_pattern(low, roles) & other.isNotNull(), no(F.concat(F.lit("Detected non-IT role keyword in title: "), other)))
    out = out.when(role.isNotNull(), F.struct(F.lit(True).alias("flag"), F.concat(F.lit("Detected IT role keyword: "), role).alias("reason")))
    return out.otherwise(no(F.lit("No IT keywords found")))


def classify_language(text: Column, ok: Sequence[str] = presets.LANGUAGE_OK, required: Sequence[str] = presets.LANGUAGE_REQUIRED) -> Column:
    """struct(flag, reason): an explicit waiver passes, then a requirement fails, everything else passes."""
    low = F.lower(empty_if_null(text))
    waiver, need = first_pattern(low, ok), first_pattern(low, required)
    verdict = lambda flag, reason: F.struct(F.lit(flag).alias("flag"), reason.alias("reason"))
    return (
        F.when(low == "", verdict(True, F.lit("No text provided")))
        .when(waiver.isNotNull(), verdict(True, F.concat(F.lit("Found explicit English-only keyword: "), waiver)))
        .when(need.isNotNull(), verdict(False, F.concat(F.lit("Detected Japanese requirement keyword: "), need)))
        .otherwise(verdict(True, F.lit("No specific Japanese requirements detected")))
    )


def judged(jobs: DataFrame, roles: Sequence[str] = presets.IT_ROLES, others: Sequence[str] = presets.NON_IT_TITLES, ok: Sequence[str] = presets.LANGUAGE_OK, required: Sequence[str] = presets.LANGUAGE_REQUIRED) -> DataFrame:
    """`jobs` with `reason`: null if accepted, else ``Non-IT: ...`` or ``Language: ...``.

    The verdicts are those of `classify_it` on title or body and of `classify_language` on the body. A role word decides the
    title's alone, so `others` changes nothing here. Texts and reason are computed once a row."""
    title, body = F.lower(empty_if_null(F.col("title"))), F.lower(F.concat_ws(" ", empty_if_null(F.col("description")), empty_if_null(F.col("title"))))
    texts = settled(jobs, {"_title": title, "_body": body})
    it = any_pattern(F.col("_title"), roles) | any_pattern(F.col("_body"), roles)
    need = F.concat(F.lit("Language: Detected Japanese requirement keyword: "), first_pattern(F.col("_body"), required))
    reason = F.when(~it, F.when(F.col("_body") == "", "Non-IT: No text provided").otherwise("Non-IT: No IT keywords found")).when(~any_pattern(F.col("_body"), ok), need)
    return settled(texts, {"reason": reason}).drop("_title", "_body")


def gate(jobs: DataFrame, **vocabularies) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): disjoint, together all of `jobs`; rejected rows carry their reason. `judged` has both in one column."""
    out = judged(jobs, **vocabularies)
    return out.where(F.col("reason").isNull()).drop("reason"), out.where(F.col("reason").isNotNull())


def silent_companies(companies: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Candidates for another look at their board: no active jobs, or an unknown or custom vendor; active ones only unless forced."""
    out = companies.where((F.coalesce("active_jobs", F.lit(0)) == 0) | F.col("ats_type").isin("unknown", "custom"))
    out = out if force else out.where("is_active")
    return out.orderBy("name").limit(limit) if limit else out


def eligible_companies(companies: DataFrame, location: str | None = None, added_by: str | None = None) -> DataFrame:
    out = companies.where(F.col("ats_url").isNotNull())
    out = out.where(F.col("location") == location) if location else out
    return out.where(F.col("added_by") == added_by) if added_by else out


def has_body(jobs: DataFrame, least: int = 50) -> DataFrame:
    return jobs.where(F.length("description") > least)


def validity(words: Sequence[str] = presets.TEST_WORDS) -> Column:
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return filled("title") & filled("company") & filled("source_url") & F.length("title").between(3, 200) & F.startswith("source_url", F.lit("http")) & ~any_contains(F.col("title"), words)


def validate(jobs: DataFrame, words: Sequence[str] = presets.TEST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)."""
    good = F.coalesce(validity(words), F.lit(False))
    return jobs.where(good), jobs.where(~good)


def adapter(url: Column, configured: Column, adapters: Sequence[tuple[str, str]] = presets.ADAPTERS) -> Column:
    """The adapter of the first URL part that occurs, else the configured type if one exists for it."""
    out = None
    for part, name in adapters:
        hit = F.contains(url, F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    known = list(dict.fromkeys(n for _, n in adapters))
    chosen = F.coalesce(out, F.lower(configured))
    return F.when(chosen.isin(known), chosen)


def route(companies: DataFrame) -> DataFrame:
    return companies.withColumn("adapter", adapter(F.col("ats_url"), F.col("ats_type"))).where(F.col("adapter").isNotNull())


def backfill(df: DataFrame, col: str, value: object) -> DataFrame:
    """The column filled where it is absent, with `filled` telling which rows changed."""
    return df.withColumn("filled", F.col(col).isNull()).withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def repair_ats_fields(rows: DataFrame) -> DataFrame:
    """Undoes swapped fields: a URL in ats_type belongs to ats_url and the type stands in board_identifier. Unknown types are dropped."""
    swapped = F.startswith("ats_type", F.lit("http"))
    fixed = F.when(swapped, F.col("board_identifier")).otherwise(F.col("ats_type"))
    url = F.when(swapped, F.col("ats_type")).otherwise(F.coalesce(F.nullif(F.col("ats_url"), F.lit("")), F.when(F.startswith("board_identifier", F.lit("http")), F.col("board_identifier"))))
    out = rows.withColumn("_type", fixed).withColumn("ats_url", url).withColumn("ats_type", F.col("_type")).drop("_type")
    return out.where((F.col("ats_type") != "") & (F.col("ats_type") != "unknown"))


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")

