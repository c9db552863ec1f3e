r"""Saved searches met by new postings through an inverted index over the searches.

Searches of one query, place and category are one pattern, however many users saved it. From a pattern's regular expressions come literals
that every match must contain, one for each alternative; their 3-grams (shorter literals as they are) are counted in the postings,
and the pattern is listed under the rarest of them, one for each alternative of its most selective expression. Postings probe the
list with their own grams, and only what is found runs the expressions. Patterns without such a literal meet postings by day.

A pattern's newest k hits hold those of all of its searches, whose cutoffs only take off old ones; so users join hits, not postings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyboard.operators import blocks
from tallyboard.operators.filters import settled

GRAM = 3
#: Beyond so many patterns their grams are counted in the postings, which is a pass of its own.
COUNTED = 1000
EXPRESSIONS = ("q", "location", "category")
#: Escapes that match no fixed character, or none that is worth to know; what follows them stands for itself.
OPAQUE = "bBAzZGdDwWsShHvVRXtnrfae"


def required_literals(pattern: str) -> list[list[str]] | None:
    """For each alternative of a regular expression (case-insensitive, Unicode) the lower-case ASCII literals that each of its matches contains;
    None if one has none, or where the expression holds what isn't looked into (inline flags, look-arounds, quoted parts, coded characters)."""
    if "(?" in pattern or "\\Q" in pattern:
        return None
    found, runs, run, depth, i = [], [], "", 0, 0
    while i <= len(pattern):
        c = pattern[i : i + 1]
        step, literal, ends = 1, "", True
        if c == "\\":
            step, after = 2, pattern[i + 1 : i + 2]
            if not after or after.isalnum() and after not in OPAQUE:
                return None
            literal = "" if after.isalnum() else after
        elif c == "[":
            close = re.compile(r"\[\^?[^\]\[\\&]+\]").match(pattern, i)
            if not close:
                return None
            step = close.end() - i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c in ("*", "?", "+", "{") and c:
            times = re.compile(r"\*|\?|\+|\{(\d+)(?:,\d*)?\}").match(pattern, i)
            if not times:
                return None
            if c in "*?" or times[1] and int(times[1]) == 0:
                run = run[:-1]
            step = times.end() - i
            step += pattern[i + step : i + step + 1] in ("?", "+") and pattern[i + step : i + step + 1] != ""
        elif c and c not in ".^$|":
            literal = c
        if literal and depth == 0 and literal.isascii():
            run, ends = run + literal.lower(), False
        if ends and run:
            runs.append(run)
            run = ""
        if c == "|" and depth == 0 or not c:
            if not runs:
                return None
            found.append(runs)
            runs = []
        i += step
    return found if depth == 0 else None


def _grams_of(literals: list[str]) -> list[str]:
    """All 3-grams of the literals; if none is that long, the longest ones as they are."""
    grams = {x[k : k + GRAM] for x in literals for k in range(len(x) - GRAM + 1)}
    return sorted(grams) or sorted(x for x in set(literals) if len(x) == max(map(len, literals)))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _alternatives(patterns: pd.Series) -> pd.Series:
    return pd.Series([[_grams_of(x) for x in found] if (found := p and required_literals(p)) else None for p in patterns], dtype=object)


def folded(text: Column) -> Column:
    """Lower case such that what equals an ASCII letter without regard to case becomes it: also the long s, the Kelvin sign, and i with or without its dot."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of a text: one pass of a pattern that looks ahead at every place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def alert_condition(job: str = "j", search: str = "s") -> Column:
    """What makes a saved search meet a posting; the query, place and category are regular expressions."""
    j, s = (lambda c: F.col(f"{job}.{c}")), (lambda c: F.col(f"{search}.{c}"))
    pattern = lambda c: F.concat(F.lit("(?iu)"), c)
    off = lambda c: F.coalesce(c, F.lit("")) == ""
    found = lambda c, p: F.coalesce(F.regexp_like(c, pattern(p)), F.lit(False))
    in_skills = lambda p: F.coalesce(F.regexp_like(F.array_join(j("skills"), "\n"), pattern(p)), F.lit(False))
    q = off(s("q")) | found(j("title"), s("q")) | found(j("company"), s("q")) | in_skills(s("q"))
    remote = F.lower(s("location")) == "remote"
    place = off(s("location")) | F.when(remote, found(j("location"), F.lit("remote")) | F.coalesce(j("remote_type") == "Remote", F.lit(False))).otherwise(found(j("location"), s("location")))
    category = off(s("category")) | found(j("title"), s("category")) | in_skills(s("category"))
    return (j("posted_date") > s("cutoff")) & q & place & category


def _probes(jobs: DataFrame, sizes: list[int]) -> DataFrame:
    """`jobs` with their folded texts, and `probe`: each gram (of the given sizes) with the space it is from, 1 for texts and 2 for places."""
    text = folded(F.concat_ws("\n", "title", "company", F.array_join(F.coalesce("skills", F.array().cast("array<string>")), "\n")))
    place = folded(F.concat_ws("\n", "location", F.when(F.col("remote_type") == "Remote", "remote")))
    df = settled(jobs, {"_text": text, "_place": place})
    spaced = lambda c, n: F.transform(grams(F.col(c), sizes), lambda g: F.struct(F.lit(n).alias("space"), g.alias("gram")))
    return df.withColumn("probe", F.explode(F.concat(spaced("_text", 1), spaced("_place", 2))))


def search_index(patterns: DataFrame, jobs: DataFrame) -> DataFrame:
    """`patterns` (p, q, location, category, cutoff) with `space` and `grams`, under which each is listed: null where it has no literal."""
    each = None
    for name in EXPRESSIONS:
        one = patterns.where(F.coalesce(name, F.lit("")) != "").select("p", F.lit(name).alias("expression"), F.lit(2 if name == "location" else 1).alias("space"), _alternatives(name).alias("alternatives"))
        each = one if each is None else each.unionByName(one)
    each = each.where("alternatives IS NOT NULL").select("p", "expression", "space", F.posexplode("alternatives").alias("alternative", "grams"))
    each = blocks.cut(each.select("p", "expression", "space", "alternative", F.explode("grams").alias("gram")))
    wanted = each.select("space", "gram").distinct()
    sizes = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())
    if not sizes:
        return patterns.withColumns({"space": F.lit(None).cast("int"), "grams": F.lit(None).cast("array<string>")})
    # of few patterns any gram will do
    counted = patterns.limit(COUNTED + 1).count() > COUNTED
    if counted:
        counts = _probes(jobs, sizes).groupBy("probe").agg(F.count(F.lit(1)).alias("n")).select("probe.space", "probe.gram", "n").join(wanted, ["space", "gram"])
        each = each.join(counts, ["space", "gram"], "left")
    else:
        each = each.withColumn("n", F.lit(0))
    rare = each.groupBy("p", "expression", "space", "alternative").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    ways = rare.groupBy("p", "expression", "space").agg(F.sum("x.n").alias("cost"), F.array_sort(F.collect_set("x.gram")).alias("grams"))
    best = ways.groupBy("p").agg(F.min(F.struct("cost", F.array_position(F.array(*[F.lit(x) for x in ("q", "category", "location")]), F.col("expression")).alias("place"), "space", "grams")).alias("x"))
    return patterns.join(best.select("p", "x.space", "x.grams"), "p", "left")


def _met(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """(p, job_id, posted_date) of the patterns of `index` that postings meet, by probing it."""
    sizes = sorted(r[0] for r in index.select(F.explode("grams").alias("g")).select(F.length("g")).distinct().collect())
    listed = index.withColumn("probe", F.explode(F.transform("grams", lambda g: F.struct(F.col("space"), g.alias("gram")))))
    probes = _probes(jobs, sizes)

    def probed(some: DataFrame) -> DataFrame:
        both = probes.alias("j").join(F.broadcast(some).alias("s"), F.col("j.probe") == F.col("s.probe"))
        # several grams may lead to one pattern: the first one counts
        text = F.when(F.col("s.space") == 1, F.col("j._text")).otherwise(F.col("j._place"))
        first = F.try_element_at(F.filter("s.grams", lambda g: F.contains(text, g)), F.lit(1)) == F.col("s.probe.gram")
        return both.where((F.size("s.grams") == 1) | first).where(alert_condition()).select("s.p", "j.job_id", "j.posted_date")

    return blocks.over_blocks(listed, "p", probed)


def _met_by_day(jobs: DataFrame, rest: DataFrame) -> DataFrame:
    """(p, job_id, posted_date) of the patterns without literals: each lists the days since its cutoff, and postings meet them there."""
    newest = jobs.agg(F.max("posted_date").cast("date")).first()[0]
    last = F.greatest(F.lit(newest).cast("date"), F.col("cutoff").cast("date"))
    daily = rest.withColumn("day", F.explode(F.sequence(F.col("cutoff").cast("date"), last)))
    both = jobs.withColumn("day", F.col("posted_date").cast("date")).alias("j").join(daily.alias("s"), (F.col("j.day") == F.col("s.day")) & alert_condition())
    return both.select("s.p", "j.job_id", "j.posted_date")


def _alerting(searches: DataFrame, as_of: str) -> DataFrame:
    """(search_id, user_email, p, q, location, category, cutoff) of the searches that are on; p tells their patterns apart."""
    cutoff = F.coalesce("last_emailed_at", F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY"))
    key = F.to_json(F.struct(*[F.coalesce(f"criteria.{c}", F.lit("")).alias(c) for c in EXPRESSIONS]))
    return searches.where("email_alert").select("search_id", "user_email", key.alias("p"), *[F.col(f"criteria.{c}").alias(c) for c in EXPRESSIONS], cutoff.alias("cutoff"))


def _sides(jobs: DataFrame, patterns: DataFrame) -> DataFrame:
    return jobs.where("is_active").where(F.col("posted_date") > F.lit(patterns.agg(F.min("cutoff")).first()[0])).select("job_id", "title", "company", "location", "remote_type", "skills", "posted_date")


def alert_hits(searches: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(search_id, user_email, job_id, posted_date): every hit of every alerting search, without an index: patterns and postings meet by
    day, so each posting runs the expressions of all patterns. For few patterns, or many that nearly everything meets."""
    alerts = _alerting(searches, as_of)
    patterns = blocks.cut(alerts.groupBy("p").agg(*[F.max(c).alias(c) for c in EXPRESSIONS], F.min("cutoff").alias("cutoff")))
    hits = _met_by_day(_sides(jobs, patterns), patterns)
    return alerts.select("search_id", "user_email", "p", "cutoff").join(hits, "p").where("posted_date > cutoff").select("search_id", "user_email", "job_id", "posted_date")


def match_alerts(searches: DataFrame, jobs: DataFrame, as_of: str, k: int | None = 10) -> DataFrame:
    """The newest k active postings (None: all) of each alerting search since it was last mailed (or the last day).

    The index of patterns is sent out in blocks of checked size; postings stay where they are. Null dates never match; a search
    that asks for nothing meets every newer posting."""
    alerts = _alerting(searches, as_of)
    patterns = blocks.cut(alerts.groupBy("p").agg(*[F.max(c).alias(c) for c in EXPRESSIONS], F.min("cutoff").alias("cutoff")))
    active = _sides(jobs, patterns)
    index = blocks.cut(search_index(patterns, active))
    sides = [side(active, own) for side, own in ((_met, index.where("grams IS NOT NULL")), (_met_by_day, index.where("grams IS NULL"))) if not own.isEmpty()]
    hits = sides[0].unionByName(sides[1]) if len(sides) > 1 else sides[0] if sides else active.select(F.lit("").alias("p"), "job_id", "posted_date").limit(0)
    order = (F.col("posted_date").desc(), F.col("job_id"))
    if k is not None:
        hits = hits.withColumn("_n", F.row_number().over(W.partitionBy("p").orderBy(*order))).where(F.col("_n") <= k)
    own = alerts.select("search_id", "user_email", "p", "cutoff").join(hits.select("p", "job_id", "posted_date"), "p").where("posted_date > cutoff")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("search_id").orderBy(*order)))
    return ranked.where(F.lit(k is None) | (F.col("rank") <= (k or 0))).select("search_id", "user_email", "job_id", "posted_date", "rank")
