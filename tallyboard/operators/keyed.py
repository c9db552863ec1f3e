"""Rows that meet sets of words by what the words require, not by pairs.

A set (a user's preferences, a list of criteria) consists of parts, a part of words: texts, places or skills. Parts of which a row must
fit one to reach a score are the set's way; a set is listed under a few keys of its cheapest way, and rows probe the list with their
own keys. A word of a text or place is keyed by the rarest of its 3-grams, a shorter one by itself, a skill by itself, and so are the
words of texts where all sets together have few of them. Only what is found
is scored; sets without a way are left to the caller."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.operators import blocks
from tallyboard.operators.alerts import COUNTED, GRAM, grams

#: Where a key is looked for: within texts, within places, among skills, at the head of places.
TEXT, PLACE, SKILL, HEAD = 1, 2, 3, 4
#: Slots of the filter that a row's keys pass before they are told apart; its size doesn't grow with the sets.
SLOTS = 1 << 15
KEY = "array<struct<space:int,key:string>>"
#: Up to so many different words of texts are looked for in each text one by one, once for all sets; more are found by 3-grams.
WORDS = 1000
#: A list of up to so many bytes of sets is a literal of the plan.
LITERAL_BYTES = 1 << 20


def vocabulary(words: DataFrame) -> list[str] | None:
    """The different words of a column `w`, or null if there are more than `WORDS`."""
    found = [r[0] for r in words.where("w IS NOT NULL").select("w").distinct().limit(WORDS + 1).collect()]
    return None if len(found) > WORDS else sorted(found)


def held(rows: DataFrame, words: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns to keep, with `_held`: which of the words `_text` holds. Computed once, as what is made of it is read more than once.

    A column expression takes some ten times as long for hundreds of words in a text as Python's search does."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [w for w in words if w in text])

    return blocks.cut(rows.select(*keep, found("_text").alias("_held")))


def items(space: int, words: Column) -> Column:
    """Words as items of a part; null words fit nothing and are left out."""
    return F.transform(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull()), lambda w: F.struct(F.lit(space).alias("space"), w.alias("key"))).cast(KEY)


def places(words: Column) -> Column:
    """Items of places that hold a word, are held by it, or are remote where a word asks for that. What is held begins with a part of the word."""
    held = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.concat(F.array(F.lit("")), grams(w, [1, 2, 3])))))
    remote = F.when(F.exists(words, lambda w: F.contains(w, F.lit("remote"))), F.array(F.lit("remote"))).otherwise(F.array().cast("array<string>"))
    return F.concat(items(PLACE, F.concat(words, remote)), items(HEAD, held))


def part(number: Column, open_: Column, required: Column, take: Column, words: Column) -> Column:
    """One part: a row that fits it holds one of any `take` of its items. An open part is fitted by every row."""
    return F.struct(number.cast("int").alias("part"), F.coalesce(open_, F.lit(False)).alias("open"), required.alias("required"), take.cast("int").alias("take"), words.alias("items"))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key["space"], key["key"]), F.lit(SLOTS)).cast("int")


def _probes(rows: DataFrame, near: Column, wanted: DataFrame) -> DataFrame:
    """`rows` with `_probes`: the keys that some set may want, once each."""
    known = "_held" in rows.columns
    sizes = {s: sorted(r["n"] for r in found) for s, found in ((s, wanted.where(F.col("space") == s).select(F.length("key").alias("n")).where("n > 0").distinct().collect()) for s in ((PLACE,) if known else (TEXT, PLACE)))}
    slot = _slot(F.struct("space", "key"))
    taken = [0] * (SLOTS // 64)
    for row in wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)))).alias("bits")).collect():
        taken[row["word"]] = row["bits"]
    filled = F.split(F.lit(",".join(map(str, taken))), ",").cast("array<long>")  # one literal keeps plans small
    sure = F.array(*[F.struct(F.lit(s).alias("space"), k.alias("key")) for s, k in ((TEXT, F.lit("")), (PLACE, F.lit("")), (HEAD, F.substring("_place", 1, GRAM)))]).cast(KEY)
    of = lambda space, text: items(space, grams(text, sizes[space])) if sizes[space] else F.array().cast(KEY)
    texts = items(TEXT, F.col("_held")) if known else of(TEXT, F.col("_text"))
    keys = F.concat(sure if not known else F.slice(sure, 2, 2), texts, of(PLACE, near), items(SKILL, F.array_distinct("_skills")))
    return rows.withColumn("_probes", F.filter(keys, lambda k: F.getbit(F.get(filled, F.shiftright(_slot(k), 6)), F.pmod(_slot(k), F.lit(64))) == 1))


def listed(sets: DataFrame, parts: Column, way: Callable[[Column], Column], rows: DataFrame, near: Column) -> tuple[DataFrame, DataFrame]:
    """(`sets` with `_id` and `_keys`, null where there is no way; `rows` with `_probes`).

    parts: an array of `part`. way: from an array of (part, open, required, cost, keys) to the chosen (cost, keys), or null; it may use
    the columns of `sets`. rows hold the lower-case `_text`, `_place` and `_skills` (skills), or instead of `_text` which words of all sets it
    holds (`_held`), which are then keys themselves; near is the text that places are looked for in.
    Beyond `COUNTED` sets the keys are counted in the rows, so that the rarest are chosen; of few sets any will do."""
    name = "_id"
    sets = sets.withColumn(name, F.md5(F.to_json(F.struct("*"))))
    each = sets.select(name, F.explode(parts).alias("p")).select(name, "p.*")
    whole = F.col("w.space").isin(SKILL, HEAD, *([TEXT] if "_held" in rows.columns else [])) | (F.length("w.key") < GRAM)
    split = each.select(name, "part", "open", "required", "take", F.posexplode_outer("items").alias("place", "w"))
    cut = blocks.cut(split.select(name, "part", "open", "required", "take", "place", F.col("w.space").alias("space"), F.explode_outer(F.when(whole, F.array("w.key")).otherwise(grams(F.col("w.key"), [GRAM]))).alias("key")))
    wanted = blocks.cut(cut.where("key IS NOT NULL").select("space", "key").distinct())
    probing = _probes(rows, near, wanted)
    if sets.limit(COUNTED + 1).count() > COUNTED:
        counts = probing.select(F.explode("_probes").alias("k")).select("k.space", "k.key").groupBy("space", "key").agg(F.count(F.lit(1)).alias("n"))
        cut = cut.join(wanted.join(counts, ["space", "key"], "left"), ["space", "key"], "left")
    else:
        cut = cut.withColumn("n", F.lit(None).cast("long"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    rare = cut.groupBy(name, "part", "open", "required", "take", "place").agg(F.min(F.when(F.col("key").isNotNull(), F.struct(n.alias("n"), "space", "key"))).alias("x"))
    best = rare.groupBy(name, "part", "open", "required", "take").agg(F.sort_array(F.collect_list("x")).alias("xs")).withColumn("xs", F.slice("xs", 1, F.greatest("take", F.lit(0))))
    cost = F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    keyed = best.select(name, F.struct("part", "open", "required", cost.alias("cost"), F.transform("xs", lambda x: F.struct(x["space"].alias("space"), x["key"].alias("key"))).alias("keys")).alias("p"))
    whole_sets = sets.join(keyed.groupBy(name).agg(F.collect_list("p").alias("_parts")), name, "left")
    return blocks.cut(whole_sets.withColumn("_keys", F.array_distinct(way(F.col("_parts"))["keys"])).drop("_parts")), probing


def _listed_once(rows: DataFrame, index: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(rows that meet sets) for a list that is one literal: a row's sets are told apart before it meets any, however many keys lead to them."""
    found = index.select("_id", "_keys").collect()
    by_key: dict[str, list[int]] = {}
    for k, r in enumerate(found):
        for x in r["_keys"]:
            by_key.setdefault(f"{x['space']}:{x['key']}", []).append(k)
    sets_of = F.from_json(F.lit(json.dumps(by_key)), "map<string,array<int>>")
    ids = F.from_json(F.lit(json.dumps([r["_id"] for r in found])), "array<string>")
    own = F.transform("_probes", lambda k: F.coalesce(F.try_element_at(sets_of, F.concat(k["space"].cast("string"), F.lit(":"), k["key"])), F.array().cast("array<int>")))
    left = rows.withColumn("_set", F.explode(F.array_distinct(F.flatten(own)))).drop("_probes")
    return run(left.join(F.broadcast(index.drop("_keys").withColumn("_set", (F.array_position(ids, F.col("_id")) - 1).cast("int"))), "_set").drop("_set"))


def met(probing: DataFrame, index: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(rows that meet sets): each pair once, found by the first of the set's keys that the row has. Sets are sent out in blocks of
    checked size, rows stay where they are; sets without keys meet every row."""
    some, rest = index.where("_keys IS NOT NULL"), index.where("_keys IS NULL").drop("_keys")
    found = []
    if not some.isEmpty() and some.limit(COUNTED + 1).count() <= COUNTED and blocks.size_of(some) <= min(LITERAL_BYTES, blocks.SENT_BYTES):
        found.append(_listed_once(probing, some, run))
    elif not some.isEmpty():
        left = probing.withColumn("_probe", F.explode("_probes"))

        def probed(block: DataFrame) -> DataFrame:
            # the list is about as large as the keys of the block's sets, which are measured with them
            both = left.join(F.broadcast(block.select("_id", F.explode("_keys").alias("_key"))), F.col("_probe") == F.col("_key")).join(F.broadcast(block), "_id")
            first = F.try_element_at(F.filter("_keys", lambda k: F.array_contains(F.col("_probes"), k)), F.lit(1)) == F.col("_probe")
            return run(both.where((F.size("_keys") == 1) | first).drop("_probe", "_key", "_keys", "_probes"))

        found.append(blocks.over_blocks(some, "_id", probed))
    if not rest.isEmpty() or not found:
        found.append(blocks.over_blocks(rest, "_id", lambda block: run(probing.drop("_probes").join(F.broadcast(block)))))
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def cheapest(ways: Sequence[tuple[Column, Column, Column]]) -> Column:
    """The cheapest of (possible, cost, keys); null if none is possible."""
    return F.array_min(F.array_compact(F.array(*[F.when(ok, F.struct(cost.alias("cost"), keys.alias("keys"))) for ok, cost, keys in ways])))
