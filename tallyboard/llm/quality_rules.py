r"""Quality rules as a short-circuit cascade; DataFrame functions only.

A rule is a boolean column that is true when a text is to be rejected. `rank_rules` times every rule and counts its
rejections on a bounded sample and orders the rules by rejections per cost; `cascade` strings them into one CASE, so a
text that an early rule rejects never reaches the later ones. The verdict (all rules passed) doesn't depend on the order.

Words are ``[^\x20\x09-\x0D]+``. A null or blank text has no words. Nothing leaves its row: there is no shuffle, and a very
long text costs n log n only if one of its 8-word windows really repeats.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import filled, unused
from tallyboard.operators.filters import settled

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows on which the rules' cost and selectivity are estimated, and how often each row is evaluated to be timed.
SAMPLE_ROWS, SAMPLE_REPEATS = 1000, 8


#: Columns that judging adds, and those that it works with.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]
HELPERS = ["_text", "_trimmed", "_words", "_hashes", "_windows", "_repeats", "_sorted", "_starts", "_lines", "_again"]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (and helper columns that start with ``_``)."""
    df = docs.withColumn("_text", filled(text))
    df = df.withColumn("_trimmed", F.btrim("_text", F.lit(BLANKS)))
    df = df.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", BLANK_RUN)))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    df = df.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))))
    # most texts repeat no window: only the others are sorted
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = lambda k: F.get(F.col("_sorted"), k)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(F.when(k > 0, beside(k - 1) == x["h"]), F.lit(False)) | F.coalesce(beside(k + 1) == x["h"], F.lit(False)))
    df = df.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # words covered by windows that start at the given places
    covered = F.aggregate("_starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return settled(df, {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", BLANK_RUN, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the measures and the text; thresholds are shares of words, characters or lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    capitals = F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))
    shouted = F.length("_text") - F.length(F.regexp_replace("_text", "!", ""))
    return [
        Rule("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("capitals", 100 * capitals > 35 * F.greatest(F.col("word_chars"), F.lit(1))),
        Rule("exclamations", 10 * shouted > 3 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size("_lines")),
        Rule("vocabulary", 20 * F.size(F.array_distinct("_hashes")) < n),
    ]


def cost_class(seconds: float, noise: float) -> int:
    """How often the noise of the clock doubles within the time: rules of one class cost the same as far as can be told."""
    return max(0, round(math.log2(max(seconds, noise) / noise)))


def rank_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, repeats: int = SAMPLE_REPEATS, text: str = "text") -> list[tuple[Rule, float, float]]:
    """The rules with their rejected share and cost on a sample, most rejections per cost first; ties by name.

    The sample has about `sample_rows` rows, drawn inside the tasks without a shuffle, with their measures; each row is judged
    `repeats` times. A rule's cost is a power of two: its time beyond that of a rule that does nothing, in steps that the spread
    of that one's times can't make. So runs agree on the order unless a cost lies between two steps; the verdict never depends
    on it. An empty sample keeps the given order."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = with_measures(docs.sample(fraction=share, seed=0) if share < 1 else docs, text).cache()
    sample = drawn.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    try:
        total = sample.count()
        if not total:
            return [(r, 0.0, 0.0) for r in rules]

        def timed(rejects: Column, times: int) -> tuple[list[float], float]:
            took, found = [], 0
            # a rule that refers to the row number can't be computed once for all repetitions
            query = sample.agg(F.count_if(rejects & (F.col("_again") > 0)))
            for _ in range(times):
                began = time.perf_counter()
                found = query.first()[0] or 0
                took.append(time.perf_counter() - began)
            return took, found / total

        idle = sorted(timed(F.lit(False), 4)[0][1:])
        noise = max(0.02, idle[-1] - idle[0])
        found = []
        for r in rules:
            took, rejected = timed(r.rejects, 2)
            found.append((r, rejected, float(2 ** cost_class(min(took) - idle[0], noise))))
    finally:
        drawn.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """`docs` with the measures, base_failed, rejected_by (first rejecting rule of the cascade; null if none or base_failed) and kept.

    Columns of `docs` named like one of these are replaced, all others stay as they are, whatever their names; rules see the
    helper columns of `with_measures` under `HELPERS`. Null, empty and blank texts fail the base; very long ones are judged whole;
    repeated rows are judged alike; no rows give none."""
    names = [c for c in docs.columns if c not in ADDED]
    aside = {c: new for c in names if c.lower() in HELPERS for new in unused(docs, f"own{c}")}
    docs = docs.drop(*ADDED).withColumnsRenamed(aside)
    measured = with_measures(docs, aside.get(text, text))
    order = [r for r, _, _ in rank_rules(docs, rules if rules is not None else default_rules(), text=aside.get(text, text))]
    df = settled(measured, {"base_failed": base_failed(), "rejected_by": F.when(~base_failed(), cascade(order))})
    df = settled(df, {"kept": ~F.col("base_failed") & F.col("rejected_by").isNull()})
    return df.select(*[F.col(aside.get(c, c)).alias(c) for c in names], *ADDED)
