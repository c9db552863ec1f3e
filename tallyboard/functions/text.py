"""Scalar functions on text columns: names, facets, hashes, dates, labels. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.functions import presets


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_true(pairs: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for test, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return other if out is None else out.otherwise(other)


def any_contains(c: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased column holds any of the words as a substring."""
    low, out = F.lower(c), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def normalise_company(c: Column, suffixes: Sequence[str] = presets.LEGAL_SUFFIXES) -> Column:
    """Trimmed, legal suffixes dropped one after the other, and the TLD of a bare domain dropped; null gives an empty name."""
    out = F.trim(empty_if_null(c))
    for s in suffixes:
        out = F.regexp_replace(out, f"(?i){s}", "")
    bare = ~F.contains(out, F.lit(" ")) & (F.size(F.split(out, r"\.")) == 2)
    return F.when(bare, F.split_part(out, F.lit("."), F.lit(1))).otherwise(out)


def strip_suffix(c: Column, suffixes: Sequence[str] = presets.CURATED_SUFFIXES) -> Column:
    """Only the first listed suffix that ends the name (case matters) is dropped."""
    name = F.trim(c)
    return _first_true([(F.endswith(name, F.lit(f" {s}")), F.trim(F.substr(name, F.lit(1), F.length(name) - len(s) - 1))) for s in suffixes], name)


def content_hash(title: Column, description: Column, location: Column) -> Column:
    return F.md5(F.concat_ws("|", empty_if_null(title), empty_if_null(description), empty_if_null(location)))


def job_type(title: Column, description: Column, commitment: Column | None = None) -> Column:
    """Substring precedence: intern, contract, part-time (or part time, where there is no commitment field), else full-time."""
    parts = [title, description] if commitment is None else [title, commitment, description]
    text = F.lower(F.concat_ws(" ", *[empty_if_null(p) for p in parts]))
    part_time = F.contains(text, F.lit("part-time"))
    if commitment is None:
        part_time = part_time | F.contains(text, F.lit("part time"))
    return _first_true([(F.contains(text, F.lit("intern")), "Internship"), (F.contains(text, F.lit("contract")), "Contract"), (part_time, "Part-time")], "Full-time")


def remote_type(location: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", empty_if_null(location), empty_if_null(description)))
    remote = F.contains(text, F.lit("remote"))
    return _first_true([(remote & F.contains(text, F.lit("hybrid")), "Hybrid"), (remote, "Remote")], "On-site")


def salary_range(c: Column, compat: bool = True) -> Column:
    """struct(min, max, currency) of the first ``$a - $b``; null if there is none.

    compat counts only the digits before the first comma (``$100,000 - $150,000`` gives 100 and 150); otherwise all count."""
    pattern = presets.SALARY if compat else presets.SALARY_WHOLE
    found = F.regexp_extract(c, pattern, 0)
    times = F.when(F.contains(F.lower(found), F.lit("k")), 1000).otherwise(1)
    number = lambda g: F.regexp_replace(F.regexp_extract(c, pattern, g), ",", "").try_cast("long") * times
    return F.when(found != "", F.struct(number(1).alias("min"), number(2).alias("max"), F.lit("USD").alias("currency")))


def title_case(word: str) -> str:
    """Every letter after a non-letter is a capital."""
    return re.sub(r"[A-Za-z]+", lambda m: m[0][0].upper() + m[0][1:].lower(), word)


def extract_skills(c: Column, vocabulary: Sequence[str] = presets.SKILLS) -> Column:
    """Sorted display names of the vocabulary's terms that occur as substrings (so ``go`` occurs in ``google``)."""
    low = F.lower(empty_if_null(c))
    found = F.array(*[F.when(F.contains(low, F.lit(v)), F.lit(title_case(v))) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def tag_location(location: Column, company_location: Column, vague: Sequence[str] = presets.VAGUE_LOCATIONS) -> Column:
    here, home = F.trim(empty_if_null(location)), empty_if_null(company_location)
    return _first_true([((here != "") & (home != "") & F.lower(here).isin(list(vague)), F.concat(here, F.lit(" ("), home, F.lit(")"))), (here == "", home)], here)


def compose_location(parts: Sequence[Column], is_remote: Column) -> Column:
    joined = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(joined != "", joined).when(F.coalesce(is_remote, F.lit(False)), "Remote").otherwise("Unknown")


def vendor_of(url: Column, vendors: Sequence[tuple[str, str]] = presets.VENDORS) -> Column:
    """The first vendor whose URL pattern is found; null if none is."""
    return _first_true([(url.rlike(p), v) for v, p in vendors], F.lit(None).cast("string"))


def vendor_evidence(url: Column, html: Column, links: Sequence[tuple[str, str]] = presets.VENDOR_LINKS, markers: Sequence[tuple[str, Sequence[str]]] = presets.VENDOR_MARKERS) -> Column:
    """struct(vendor, confidence, method) of a careers page: by its URL, else by a marker in its text, else custom."""
    found = lambda v, confidence, method: F.struct(F.lit(v).alias("vendor"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    by_url = [(url.rlike(p), found(v, 0.95, "url_pattern")) for v, p in links]
    by_text = [(F.contains(html, F.lit(m)), found(v, 0.85, "dom_analysis")) for v, ms in markers for m in ms]
    return _first_true(by_url + by_text, found("custom", 1.0, "unknown"))


def board_token(vendor: Column, url: Column, endpoint: Column, domain: Column, name: Column) -> Column:
    """The board's token: from its URL, from the configured endpoint, else the domain without ``.com`` and dots, else the name."""
    none = lambda c: F.nullif(c, F.lit(""))
    in_url = _first_true(
        [
            (vendor == "greenhouse", none(F.regexp_extract(url, presets.GREENHOUSE_URL, 1))),
            (vendor == "workable", none(F.regexp_extract(url, presets.WORKABLE_URL, 1))),
            (vendor == "workday", none(F.regexp_extract(url, presets.WORKDAY_URL, 1))),
            (vendor.isin("lever", "ashby"), none(F.regexp_extract(F.rtrim(url, F.lit("/")), presets.LAST_PART, 1))),
        ],
        F.lit(None).cast("string"),
    )
    in_endpoint = _first_true([(vendor == "greenhouse", none(F.regexp_extract(endpoint, presets.GREENHOUSE_ENDPOINT, 1))), (vendor == "lever", none(F.regexp_extract(endpoint, presets.LEVER_ENDPOINT, 1))), (vendor == "workday", none(F.regexp_extract(endpoint, presets.WORKDAY_URL, 1)))], F.lit(None).cast("string"))
    guessed = none(F.when(vendor == "workable", F.split_part(domain, F.lit("."), F.lit(1))).otherwise(F.replace(F.replace(domain, F.lit(".com"), F.lit("")), F.lit("."), F.lit(""))))
    return F.coalesce(in_url, in_endpoint, guessed, none(F.replace(F.lower(name), F.lit(" "), F.lit(""))))


def slug_of(url: Column, tlds: Sequence[str] = presets.SLUG_TLDS, generic: Sequence[str] = presets.SLUG_GENERIC) -> Column:
    host = F.split(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"\.")
    parts = F.when(F.get(host, F.lit(0)) == "www", F.slice(host, 2, 99)).otherwise(host)
    left = F.filter(parts, lambda p: ~F.lower(p).isin(list(tlds)))
    slug = F.when(F.size(left) > 0, F.get(left, F.lit(0))).otherwise(F.get(parts, F.lit(0)))
    second = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0)))
    return F.when(slug.isin(list(generic)), second).otherwise(slug)


def probe_urls(slug: Column, probes: Sequence[tuple[str, str]] = presets.PROBES) -> Column:
    """array of struct(order, url, vendor) to try for a slug."""
    return F.array(*[F.struct(F.lit(i).alias("order"), F.format_string(p, slug).alias("url"), F.lit(v).alias("vendor")) for i, (p, v) in enumerate(probes)])


def career_urls(domain: Column, paths: Sequence[str] = presets.CAREER_PATHS) -> Column:
    return F.array(*[F.concat(F.lit("https://"), domain, F.lit(p)) for p in paths])


def guess_domain(name: Column) -> Column:
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit("")), F.lit(".com"))


ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def anchors(html: Column) -> Column:
    """array of struct(pos, href, text) of the anchors in document order; text without tags, lower case, trimmed."""
    href, text = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    return F.transform(F.arrays_zip(href.alias("href"), text.alias("text")), lambda a, i: F.struct(i.alias("pos"), a["href"].alias("href"), F.trim(F.lower(F.regexp_replace(a["text"], "<[^>]*>", ""))).alias("text")))


def absolute(base: Column, href: Column) -> Column:
    """Absolute form of the common kinds of links; `links.absolute_url` covers all."""
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-z]+:)", 1)
    return _first_true([(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href), (F.startswith(href, F.lit("//")), F.concat(scheme, href)), (F.startswith(href, F.lit("/")), F.concat(origin, href))], F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*)/?[^/]*$|[^/]*$", "$1"), F.lit("/"), href))


def vendor_link(html: Column, base: Column) -> Column:
    """struct(url, vendor) of the first anchor that leads to a known vendor."""
    found = F.transform(anchors(html), lambda a: F.struct(absolute(base, a["href"]).alias("url"), vendor_of(absolute(base, a["href"])).alias("vendor")))
    return F.get(F.filter(found, lambda x: x["vendor"].isNotNull()), F.lit(0))


def careers_link(html: Column, base: Column, words: Sequence[str] = presets.CAREER_WORDS) -> Column:
    """The first anchor with a career word in its text, or careers/jobs in its link; mail, phone, script and page links are skipped."""

    def fits(a: Column) -> Column:
        href = F.lower(a["href"])
        return ~a["href"].rlike("^(mailto:|tel:|javascript:|#)") & (any_contains(a["text"], words) | F.contains(href, F.lit("careers")) | F.contains(href, F.lit("jobs")))

    first = F.get(F.filter(anchors(html), fits), F.lit(0))
    return F.when(first.isNotNull(), absolute(base, first["href"]))


def parse_posted(c: Column, fmt: str = "iso", fallback: Column | None = None) -> Column:
    """ISO text or epoch milliseconds as a UTC timestamp; bad values are null or the fallback."""
    out = F.try_to_timestamp(c) if fmt == "iso" else F.timestamp_millis(c.try_cast("long"))
    return out if fallback is None else F.coalesce(out, fallback)


def activity_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"activity:(\d+)", 1), F.lit(""))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def age_label(ts: Column, as_of: Column) -> Column:
    """Just now, Nh ago, Nd ago (days rounded up, to 30), else the date."""
    s = F.abs(seconds_between(ts, as_of))
    hours, days = F.floor(s / 3600), F.ceil(s / 86400)
    return _first_true([(ts.isNull() | (hours < 1), "Just now"), (hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))), (days <= 30, F.concat(days.cast("string"), F.lit("d ago")))], F.date_format(ts, "yyyy-MM-dd"))


def check_bucket(ts: Column, as_of: Column) -> Column:
    """Days since the last check, rounded up (null: 999): more than 14 stale, more than 7 warn, else ok."""
    days = F.coalesce(F.ceil(F.abs(seconds_between(ts, as_of)) / 86400), F.lit(999))
    return _first_true([(days > 14, "stale"), (days > 7, "warn")], "ok")


def highlight(c: Column, query: str) -> Column:
    return F.regexp_replace(c, f"(?iu)({query})", "<mark>$1</mark>") if query else c


def score_badge(score: Column) -> Column:
    return _first_true([(score >= 8, "strong"), (score >= 6, "good")], "possible")


def parse_tags(c: Column) -> Column:
    """Comma-separated tags: trimmed, blanks dropped, each once, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(empty_if_null(c), ","), lambda x: F.trim(x)), lambda x: x != ""))


def merge_query(tags: Column, live: Column) -> Column:
    """Keyword tags and the live query as one query text."""
    return F.trim(F.concat_ws(" ", F.array_join(parse_tags(tags), " "), F.nullif(F.trim(empty_if_null(live)), F.lit(""))))


def head(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, n)


def short_title(title: Column, n: int = 50) -> Column:
    return F.substring(title, 1, n)


def name_of_email(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def place_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
