"""Joins and set operations (inventory J). Wide OR conditions are chained anti joins, fuzzy matching is filtered by rare tokens and 3-grams."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyboard.functions.text import careers_link, empty_if_null, vendor_link, vendor_of
from tallyboard.operators import blocks
from tallyboard.operators.alerts import alert_condition, alert_hits, match_alerts  # noqa: F401  they belong to the joins
from tallyboard.operators.filters import matching_jobs


def lowered(c: str) -> Column:
    return F.lower(F.col(c))


def favorite_companies(companies: DataFrame, favorites: DataFrame, user: str) -> DataFrame:
    """The user's favourite companies with their favourite's own columns."""
    own = favorites.where(F.col("user_email") == user).select(F.col("company_name").alias("name"), "is_monitor", "last_checked_at")
    return companies.join(own, "name")


def collection_members(collections: DataFrame, companies: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """(member companies, names that no company has)."""
    names = collections.where(F.col("id") == id).select(F.explode("data.companies").alias("name"))
    return companies.join(names, "name"), names.join(companies, "name", "left_anti")


def preset_search(collections: DataFrame, jobs: DataFrame, id: str, as_of: str, **facets) -> DataFrame:
    """Jobs of a collection's companies under its other facets, which are read as the one row they are."""
    own = collections.where(F.col("id") == id)
    row = own.select("data.q", "data.location", "data.category").first()
    if row is None:
        return jobs.limit(0)
    names = own.select(F.explode("data.companies").alias("company")).distinct()
    return matching_jobs(jobs, as_of, q=row.q or "", location=row.location, category=row.category, **facets).join(names, "company", "left_semi")


def skip_rejected(jobs: DataFrame, rejected: DataFrame) -> DataFrame:
    return jobs.join(rejected.select("content_hash").distinct(), "content_hash", "left_anti")


def diff_jobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(job_id, action): new, changed, unchanged, or stored (not in this batch). Only keys and hashes are joined."""
    a = incoming.select("job_id", F.col("content_hash").alias("new_hash"))
    b = stored.select("job_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("_old"))
    both = a.withColumn("_new", F.lit(True)).join(b, "job_id", "full_outer")
    action = F.when(F.col("_new").isNull(), "stored").when(F.col("_old").isNull(), "new").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return both.select("job_id", action.alias("action"))


def skip_known(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("company", "title", "location")) -> DataFrame:
    """Rows whose keys (null equal to null) no stored row has."""
    a, b = incoming.alias("a"), stored.select(*keys).distinct().alias("b")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, test, "left_anti").select("a.*")


def plan_import(new: DataFrame, companies: DataFrame, update: bool = False) -> DataFrame:
    """`new` with an action by domain: insert, or update/skip for known ones."""
    known = companies.select("domain").distinct().withColumn("_known", F.lit(True))
    return new.join(known, "domain", "left").withColumn("action", F.when(F.col("_known").isNull(), "insert").otherwise("update" if update else "skip")).drop("_known")


def new_companies(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates of which neither name nor domain is known, whatever the case."""
    by_name = companies.select(lowered("name").alias("_k")).distinct()
    by_domain = companies.select(lowered("domain").alias("_k")).distinct()
    rest = candidates.join(by_name, lowered("name") == F.col("_k"), "left_anti")
    return rest.join(by_domain, lowered("domain") == F.col("_k"), "left_anti")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; the bits of one number are the columns of the usual table."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_similarity(a: str | None, b: str | None) -> float:
    """Best indel ratio between the common tokens and each side's common plus own tokens; 100 if one side's tokens are all common."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    scores = [_ratio(left, right)]
    if both:
        scores += [_ratio(both, left), _ratio(both, right)]
    return max(scores)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_similarity(x, y) for x, y in zip(a, b)])


GRAM = 3


def _tokens(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.col(name)), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))


def _rare_first(rows: DataFrame, ranks: DataFrame, item: str) -> DataFrame:
    """(name, size, items): each name's items in one order for all, rarest first."""
    return rows.join(ranks, item).groupBy("name", "size").agg(F.sort_array(F.collect_list(F.struct("n", F.col(item).alias("item")))).alias("items"))


def _leading(size: Column, items: Column, spare: float) -> Column:
    """The rarest tokens, up to the first that makes them longer than a `spare` share of the name: one of them is common if the
    tokens that aren't take no more than that."""
    end = F.aggregate(items, F.struct(F.lit(0).alias("k"), F.lit(0).alias("chars")), lambda s, x: F.when(s["chars"] > size * spare + 1e-9, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["chars"] + F.length(x["item"]) + 1).alias("chars"))))["k"]
    return F.slice(items, 1, end)


def _named(df: DataFrame) -> DataFrame:
    """(name, tokens, size, grams) of each name with tokens: the distinct tokens, their length joined, and their 3-grams with a blank on both sides."""
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    cut_up = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(padded(t), i, F.lit(GRAM)))
    df = df.select("name").distinct().withColumn("tokens", _tokens("name")).where(F.size("tokens") > 0)
    return df.withColumns({"size": F.length(F.array_join("tokens", " ")), "grams": F.array_distinct(F.flatten(F.transform("tokens", cut_up)))})


def _ranks(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    each = a.select(F.explode(kind).alias(kind)).unionByName(b.select(F.explode(kind).alias(kind)))
    return each.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def _by_tokens(few: DataFrame, many: DataFrame, ranks: DataFrame, spare: float) -> DataFrame:
    """(name, tokens, other, other_tokens): pairs in which `many` has one of the leading tokens of `few`."""
    heads = _rare_first(few.select("name", "size", F.explode("tokens").alias("tokens")), ranks, "tokens")
    heads = heads.select("name", F.col("items.item").alias("tokens"), F.explode(_leading(F.col("size"), F.col("items"), spare)["item"]).alias("t"))
    return heads.join(many.select(F.col("name").alias("other"), F.col("tokens").alias("other_tokens"), F.explode("tokens").alias("t")), "t").drop("t")


def contained_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(candidate, match) of names of which one side's tokens are all the other's too: these meet at the rarest token of that side."""
    ranks, inside = _ranks(a, b, "tokens"), F.size(F.array_except("tokens", "other_tokens")) == 0
    x, y = _by_tokens(a, b, ranks, 0.0).where(inside), _by_tokens(b, a, ranks, 0.0).where(inside)
    return x.select(F.col("name").alias("candidate"), F.col("other").alias("match")).unionByName(y.select(F.col("other").alias("candidate"), F.col("name").alias("match")))


def fuzzy_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(candidate, match) of two sides of `_named` names: every pair that can reach the similarity `least`, and some more.

    Two ways lead to a similarity. Either the common tokens make up nearly all of one side: then one of that side's rarest tokens
    is common. Or the names differ by few inserted and deleted characters, a share `e` of both lengths at most: then most
    3-grams of the padded tokens stay, since a deletion breaks three and an insertion two, and one of the rarest is common
    (a prefix filter on both sides). Names too short for that are paired by length."""
    e = 1 - least / 100
    spare, tokens, grams = 2 * e / (1 + e), _ranks(a, b, "tokens"), _ranks(a, b, "grams")
    # most 3-grams that a partner of any fitting length leaves broken
    low, high = (1 - e) / (1 + e), (1 + e) / max(1e-9, 1 - e)
    share = max((2.5 * e + 0.5) + (2.5 * e - 0.5) * m for m in (low, high))
    broken = F.floor(F.col("size") * share + 1e-9)

    def by_grams(df: DataFrame, own: str) -> DataFrame:
        rare = _rare_first(df.select("name", "size", F.explode("grams").alias("grams")), grams, "grams")
        return rare.select(F.col("name").alias(own), F.col("size").alias(f"{own}_size"), F.explode(F.slice("items", 1, F.least(F.size("items"), broken + 1).cast("int"))["item"]).alias("g"))

    # the rarest broken + 1 grams hold a common one if there are more grams than that can break
    short = lambda df, own: df.where(F.size("grams") <= broken).select(F.col("name").alias(own), F.col("size").alias(f"{own}_size"))
    x, y = F.col("candidate_size"), F.col("match_size")
    near = 2 * F.least(x, y) + 1e-9 >= (1 - e) * (x + y)
    close = by_grams(a, "candidate").join(by_grams(b, "match"), "g").where(near)
    lengths = F.sequence(F.ceil(x * low - 1e-9).cast("int"), F.floor(x * high + 1e-9).cast("int"))
    both_short = short(a, "candidate").withColumn("match_size", F.explode(lengths)).join(short(b, "match"), "match_size")
    found = [_by_tokens(a, b, tokens, spare).select(F.col("name").alias("candidate"), F.col("other").alias("match")), _by_tokens(b, a, tokens, spare).select(F.col("other").alias("candidate"), F.col("name").alias("match")), close, both_short]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more.select("candidate", "match"))
    return out.distinct()


def fuzzy_match(candidates: DataFrame, companies: DataFrame, least: float = 90.0) -> DataFrame:
    """(candidate, match, score, how): the company of the same domain, else the best name at or above `least`; ties by name.

    Names of which one holds the other's tokens score 100; only candidates without such a match are compared by `fuzzy_pairs`, and
    each pair is scored once. Names without tokens match nothing."""
    c = candidates.select(F.col("name").alias("candidate"), lowered("domain").alias("_d")).distinct()
    known = companies.select(F.col("name").alias("match"), lowered("domain").alias("_d")).distinct()
    best_of = lambda df, score, how: df.groupBy("candidate").agg(F.min("match").alias("match")).select("candidate", "match", F.lit(score).alias("score"), F.lit(how).alias("how"))
    by_domain = best_of(c.join(known, "_d"), 100.0, "domain")
    names = _named(known.select(F.col("match").alias("name")))
    rest = c.select("candidate").distinct().join(by_domain, "candidate", "left_anti")
    by_tokens = best_of(contained_names(_named(rest.select(F.col("candidate").alias("name"))), names), 100.0, "name")
    rest = rest.join(by_tokens, "candidate", "left_anti")
    pairs = fuzzy_pairs(_named(rest.select(F.col("candidate").alias("name"))), names, least)
    scored = pairs.withColumn("score", similarity("candidate", "match")).where(F.col("score") >= least)
    best = scored.groupBy("candidate").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b"))
    by_name = best.select("candidate", F.col("b.match").alias("match"), (-F.col("b.s")).alias("score"), F.lit("name").alias("how"))
    return by_domain.unionByName(by_tokens.where(F.lit(least <= 100))).unionByName(by_name)


#: How far each way to a board is to be trusted.
CONFIDENCE = {"url": 0.95, "redirect": 0.95, "probe": 0.8, "home": 0.7, "careers": 0.7}


def match_tier(score: Column) -> Column:
    return F.when(score > 95, "merge").when(score >= 85, "review").otherwise("new")


def overlap_report(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(name, domain, reason) of extra rows that the base has already: by domain, else by name."""
    d = base.select(lowered("domain").alias("_d")).distinct().withColumn("_by_domain", F.lit(True))
    n = base.select(lowered("name").alias("_n")).distinct().withColumn("_by_name", F.lit(True))
    out = extra.withColumn("_d", lowered("domain")).withColumn("_n", lowered("name")).join(d, "_d", "left").join(n, "_n", "left")
    return out.withColumn("reason", F.when(F.col("_by_domain"), "domain").when(F.col("_by_name"), "name")).where(F.col("reason").isNotNull()).select("name", "domain", "reason")


def canonicalise(adds: DataFrame, companies: DataFrame, tag: str = "User Favorite") -> DataFrame:
    """Added companies under their canonical name, with board fields filled where the stored ones are null; unknown ones as tagged stubs."""
    known = companies.select(lowered("name").alias("_k"), F.col("name").alias("_name"), F.col("ats_url").alias("_url"), F.col("ats_type").alias("_type"))
    out = adds.withColumn("_k", lowered("name")).join(known, "_k", "left")
    return out.select(
        F.coalesce("_name", "name").alias("name"), F.coalesce("_url", "ats_url").alias("ats_url"), F.coalesce("_type", "ats_type").alias("ats_type"),
        F.col("_name").isNull().alias("is_stub"), F.when(F.col("_name").isNull(), F.lit(tag)).alias("tag"),
    )


def attach_scores(jobs: DataFrame, scores: DataFrame, default: float = 3.0, reason: str = "Not scored") -> DataFrame:
    return jobs.join(scores, "job_id", "left").withColumns({"score": F.coalesce("score", F.lit(default)), "reason": F.coalesce("reason", F.lit(reason))})


def due(frequency: Column, last_sent: Column, as_of: Column) -> Column:
    """Never sent, or daily after 23 hours, or weekly after 6 whole days."""
    s = (F.unix_micros(as_of) - F.unix_micros(last_sent)) / F.lit(1e6)
    return last_sent.isNull() | F.coalesce(((frequency == "daily") & (s >= 23 * 3600)) | ((frequency == "weekly") & (F.floor(s / 86400) >= 6)), F.lit(False))


def lookback_days(frequency: Column) -> Column:
    return F.when(frequency == "daily", 1).otherwise(7)


def digest_windows(subscribers: DataFrame, jobs: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """((user_email, days) of due subscribers, (days, job_id, posted_date) of the windows). Subscribers only differ in two windows, so a
    digest is a window's jobs: this is what `due_digests` lists, without its pairs."""
    now = F.lit(as_of).cast("timestamp")
    ready = subscribers.where("is_active").where(due(F.coalesce("frequency", F.lit("daily")), F.col("last_sent_at"), now)).select("user_email", lookback_days(F.coalesce("frequency", F.lit("daily"))).alias("days"))
    recent = jobs.where("is_active").where(F.col("posted_date") >= now - F.expr("INTERVAL 7 DAYS")).select("job_id", "posted_date")
    windows = recent.withColumn("days", F.explode(F.when(F.col("posted_date") >= now - F.expr("INTERVAL 1 DAY"), F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(7)))))
    return ready, windows


def due_digests(subscribers: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(user_email, job_id, posted_date) of every due subscriber's digest window.

    Due subscribers are sent out in blocks of checked size; jobs stay where they are."""
    ready, windows = digest_windows(subscribers, jobs, as_of)
    return blocks.over_blocks(ready, "user_email", lambda some: windows.join(F.broadcast(some), "days").select("user_email", "job_id", "posted_date"))


def digest_sizes(subscribers: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(user_email, n): how many jobs each row of `due_digests` would list, counted once a window and not once a user; users without any are left out."""
    now, days = F.lit(as_of).cast("timestamp"), lookback_days(F.coalesce("frequency", F.lit("daily")))
    ready = subscribers.where("is_active").where(due(F.coalesce("frequency", F.lit("daily")), F.col("last_sent_at"), now)).select("user_email", days.alias("days"))
    age = lambda n: F.count_if(F.col("posted_date") >= now - F.expr(f"INTERVAL {n} DAYS"))
    sizes = jobs.where("is_active").agg(F.explode(F.array(*[F.struct(F.lit(n).alias("days"), age(n).alias("n")) for n in (1, 7)])).alias("x")).select("x.*")
    return ready.join(F.broadcast(sizes), "days").where("n > 0").groupBy("user_email").agg(F.sum("n").alias("n"))


def valid_requests(requests: DataFrame, companies: DataFrame, pending: DataFrame) -> DataFrame:
    """Requests whose name is neither a company nor already pending, whatever the case."""
    out = requests
    for names in (companies, pending):
        out = out.join(names.select(lowered("name").alias("_k")).distinct(), lowered("name") == F.col("_k"), "left_anti")
    return out


def apply_discovery(companies: DataFrame, found: DataFrame, resettable: Sequence[str] = ("workable", "custom", "unknown")) -> DataFrame:
    """Companies after a new look: found boards are set (FIXED if the type changed, else CONFIRMED); others of doubtful type are RESET."""
    f = found.select("name", F.col("ats_type").alias("_type"), F.col("ats_url").alias("_url"), F.lit(True).alias("_hit"))
    out = companies.join(f, "name", "left")
    hit, doubtful = F.col("_hit").isNotNull(), F.coalesce(F.col("ats_type").isin(list(resettable)), F.lit(False))
    outcome = F.when(hit & ~F.col("_type").eqNullSafe(F.col("ats_type")), "FIXED").when(hit, "CONFIRMED").when(doubtful, "RESET").otherwise("KEPT")
    out = out.withColumn("outcome", outcome)
    reset = F.col("outcome") == "RESET"
    return out.withColumns({
        "ats_type": F.when(hit, F.col("_type")).when(reset, "unknown").otherwise(F.col("ats_type")),
        "ats_url": F.when(hit, F.col("_url")).when(~reset, F.col("ats_url")),
        "is_active": F.when(hit, True).when(reset, False).otherwise(F.col("is_active")),
        "confidence": F.when(hit, 1.0),
    }).drop("_type", "_url", "_hit")


def set_ops(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each distinct key with where it stands: both, left or right."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def discover_vendor(companies: DataFrame, pages: DataFrame, probes: DataFrame) -> DataFrame:
    """(name, vendor, url, how, confidence): from the company's URL, its landed home page, its landed careers page, or the first valid probe.

    pages: url, final_url, html. probes: name, order, url, vendor, body, total; valid if the body doesn't say that there is no board and the total is positive."""
    home = pages.select(F.col("url").alias("website"), F.col("html").alias("_home"))
    c = companies.join(home, "website", "left")
    on_home = vendor_link(F.col("_home"), F.col("website"))
    c = c.withColumns({"_direct": vendor_of(F.col("website")), "_home_hit": on_home, "_careers": careers_link(F.col("_home"), F.col("website"))})
    second = pages.select(F.col("url").alias("_careers"), F.col("final_url").alias("_final"), F.col("html").alias("_page"))
    c = c.join(second, "_careers", "left").withColumns({"_final_type": vendor_of(F.col("_final")), "_page_hit": vendor_link(F.col("_page"), F.coalesce("_final", "_careers"))})
    valid = probes.where(~F.contains(empty_if_null(F.col("body")), F.lit('"jobBoard":null')) & (F.coalesce("total", F.lit(0)) > 0))
    first = valid.groupBy("name").agg(F.min_by(F.struct("vendor", "url"), "order").alias("_probe"))
    c = c.join(first, "name", "left")
    tiers = [("url", F.col("_direct"), F.col("website")), ("home", F.col("_home_hit.vendor"), F.col("_home_hit.url")), ("redirect", F.col("_final_type"), F.col("_final")), ("careers", F.col("_page_hit.vendor"), F.col("_page_hit.url")), ("probe", F.col("_probe.vendor"), F.col("_probe.url"))]
    pick = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("vendor"), u.alias("url"), F.lit(how).alias("how"))) for how, v, u in tiers])
    trust = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return c.select("name", pick.alias("_p")).select("name", "_p.vendor", "_p.url", "_p.how", F.coalesce(F.try_element_at(trust, F.col("_p.how")), F.lit(0.0)).alias("confidence"))
