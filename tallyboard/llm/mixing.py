r"""Mixing sources to target weights by temperature; DataFrame functions only.

Token shares p of the sources are raised to an exponent and normalised. The exponent is bisected to the value nearest to 1
... 0 at which a limit holds: a repetition limit (no source is repeated more often than that when every source is used at
least once), or a target entropy. The weights become token quotas of a budget, and each source's quota is realised as whole
epochs plus a part of one, each a permutation of the source's blocks. The block at which the quota ends is cut once more, into
parts by hash, so a source falls short of its quota by a 65536th of its tokens or a document, about; `realised` tells by how much.

A source may hold a third of all rows: it is split into `BLOCKS` hash blocks, all ordering and adding up is done on the tables
of blocks and of the last blocks' parts, and documents meet them by (source, block). Only sums per source, block and part are
shuffled before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, filled, hashed, unused

#: Blocks of a source, and parts of a block.
BLOCKS, PARTS = 256, 256
REPETITION = 1.5
STEPS = 50
#: The schedule is sent to every task up to this size; beyond, documents and schedule are joined by a shuffle.
PLAN_BYTES = 32 << 20


def exponent(shares: Column, repetition: float | None, entropy: float | None, steps: int = STEPS) -> Column:
    """The largest exponent's flattening that the limit allows: bisection between 0 (uniform) and 1 (as the data is).

    `shares` is an array with one positive token share per source, a number that grows with the sources, not with the rows."""

    def too_flat(a: Column) -> Column:
        if entropy is not None:
            z = F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))
            h = F.log(z) - a * F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a) * F.log(p)) / z
            return h > F.lit(float(entropy))
        times = F.transform(shares, lambda p: F.pow(p, a - 1))
        return F.array_max(times) / F.array_min(times) > F.lit(float(repetition))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(s["lo"]).alias("lo"), F.when(flat, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    return F.round(found["hi"], 9)


def source_quotas(blocks: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source_key, tokens, weight, quota) from the block table. Without a budget, the smallest one is taken that uses every source once."""
    totals = blocks.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))
    all_shares = totals.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("each"))
    bent = all_shares.select("total", "most", "each", F.coalesce(exponent(F.transform("each", lambda t: t / F.col("total")), repetition, entropy), F.lit(1.0)).alias("a"))
    bent = bent.withColumn("z", F.aggregate("each", F.lit(0.0), lambda s, t: s + F.pow(t / F.col("total"), F.col("a"))))
    # one row joins every source
    rows = totals.withColumn("_one", F.lit(1)).join(F.broadcast(bent.withColumn("_one", F.lit(1))), "_one")
    share = F.col("tokens") / F.col("total")
    rows = rows.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(share, F.col("a")) / F.col("z")).otherwise(0.0))
    once = F.col("tokens") * F.pow(F.col("tokens") / F.col("most"), F.col("a") - 1)
    quota = F.when(F.col("tokens") > 0, F.floor(F.round(once, 3))).otherwise(0) if budget is None else F.floor(F.round(F.col("weight") * budget, 3))
    return rows.select("source_key", "tokens", "weight", quota.cast("long").alias("quota"), F.col("a").alias("exponent"))


def schedule(blocks: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """(source_key, block, epoch, block_rank, tokens, room): which blocks are emitted in which epoch, and where in its permutation.

    Whole epochs take every block; the last one takes blocks in its permuted order while they fit the rest of the quota. The
    block after those has room, the tokens that are left for it; all others have none. A source without tokens is emitted once, whole."""
    rows = blocks.join(quotas.withColumnRenamed("tokens", "source_tokens"), "source_key")
    whole = F.when(F.col("source_tokens") > 0, F.expr("quota DIV source_tokens")).otherwise(1).cast("int")
    rows = rows.withColumn("epochs", whole).withColumn("rest", F.when(F.col("source_tokens") > 0, F.col("quota") % F.col("source_tokens")).otherwise(0))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    rows = rows.withColumn("_order", hashed(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("source_key"), F.col("block").cast("string"))))
    own = W.partitionBy("source_key", "epoch").orderBy("_order", "block")
    rows = rows.withColumn("block_rank", F.row_number().over(own) - 1).withColumn("_filled", F.sum("tokens").over(own.rowsBetween(W.unboundedPreceding, 0)))
    left = F.col("rest") - (F.col("_filled") - F.col("tokens"))
    takes = (F.col("epoch") < F.col("epochs")) | ((F.col("rest") > 0) & (left >= F.col("tokens")))
    cut_here = (F.col("epoch") == F.col("epochs")) & (left > 0) & (left < F.col("tokens"))
    return rows.where(takes | cut_here).select("source_key", "block", "epoch", "block_rank", "tokens", F.when(~takes, left).alias("room"))


def place(column: str = "doc_id") -> tuple[Column, Column]:
    """A document's block, and its part of the block."""
    number = hashed(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return (number % BLOCKS).cast("int"), (F.floor(number / BLOCKS) % PARTS).cast("int")


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def n_words() -> Column:
    return F.regexp_count(filled(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def planned(docs: DataFrame, repetition: float | None, entropy: float | None, budget: int | None, seed: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(quotas, schedule with the parts of cut blocks and the tokens that are emitted), both cut from their lineage."""
    block, part = place()
    rows = docs.select(source_key(source).alias("source_key"), block.alias("block"), part.alias("part"), F.col("text"))
    blocks = rows.groupBy("source_key", "block").agg(F.sum(n_words()).alias("tokens"))
    quotas = cut(source_quotas(blocks, repetition, entropy, budget))
    plan = cut(schedule(blocks, quotas, seed))
    # one cut block a source at most: its parts are taken in permuted order while they fit
    last = plan.where("room IS NOT NULL").select("source_key", "block", "epoch", "room")
    parts = rows.join(_sent(last), ["source_key", "block"]).groupBy("source_key", "block", "epoch", "room", "part").agg(F.sum(n_words()).alias("tokens"))
    order = hashed(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("source_key"), F.col("block").cast("string"), F.col("part").cast("string")))
    own = W.partitionBy("source_key").orderBy("_order", "part")
    parts = parts.withColumn("_order", order).withColumn("_filled", F.sum("tokens").over(own.rowsBetween(W.unboundedPreceding, 0)))
    taken = parts.where("_filled <= room").groupBy("source_key", "block", "epoch").agg(F.collect_list("part").alias("parts"), F.sum("tokens").alias("taken"))
    both = plan.join(taken, ["source_key", "block", "epoch"], "left").where("room IS NULL OR parts IS NOT NULL")
    return quotas, cut(both.select("source_key", "block", "epoch", "block_rank", "parts", F.coalesce("taken", "tokens").alias("tokens")))


def _sent(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if its size allows it."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("source_key") + 64), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= PLAN_BYTES else table


def _emitted(docs: DataFrame, names: list[str], repetition: float | None, entropy: float | None, budget: int | None, seed: str, source: str) -> DataFrame:
    """`docs` once per epoch that emits it, with more columns called `names`: source key, tokens, block, epoch, block rank, part, parts."""
    key, tokens, block, epoch, rank, part, parts = names
    _, plan = planned(docs, repetition, entropy, budget, seed, source)
    own_block, own_part = place()
    rows = docs.withColumns({key: source_key(source), tokens: n_words(), block: own_block, part: own_part})
    emitted = rows.join(_sent(plan.drop("tokens")).toDF(key, block, epoch, rank, parts), [key, block])
    return emitted.where(F.col(parts).isNull() | F.array_contains(parts, F.col(part)))


def realised(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, seed: str = "mix", source: str = "source") -> DataFrame:
    """(source_key, tokens, weight, quota, realised, realised_weight) of what `mixed` emits with the same arguments."""
    quotas, plan = planned(docs, repetition, entropy, budget, seed, source)
    got = plan.groupBy("source_key").agg(F.sum("tokens").alias("realised"))
    rows = quotas.join(got, "source_key", "left").withColumn("realised", F.coalesce("realised", F.lit(0)))
    total = rows.agg(F.sum("realised").alias("_all"))
    # one row joins every source
    return rows.join(F.broadcast(total)).select("source_key", "tokens", "weight", "quota", "realised", F.coalesce(F.col("realised") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("realised_weight"))


def mixed(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, seed: str = "mix", source: str = "source") -> DataFrame:
    r"""The rows of `docs`, all columns, once per epoch that emits them, with n_tokens (words ``[^\x20\x09-\x0D]+``), block, epoch, block_rank.

    Input columns of these names are replaced. A null source is a source of its own; null and empty texts have no tokens and are
    emitted with their block; blocks follow from doc_id alone (null ids share one), so repeated rows stay together; blocks of
    equal hashes are taken by number. A text of any length counts whole. No rows give none."""
    added = ["n_tokens", "block", "epoch", "block_rank"]
    docs = docs.drop(*added)
    names = unused(docs, "source_key", *added, "part", "parts")
    return _emitted(docs, names, repetition, entropy, budget, seed, source).select(*docs.columns, *[F.col(n).alias(a) for n, a in zip(names[1:5], added)])


def repeated(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, seed: str = "mix", source: str = "source") -> DataFrame:
    """As `mixed`, with the columns of `docs` alone, whatever they are called."""
    names = unused(docs, "source_key", "n_tokens", "block", "epoch", "block_rank", "part", "parts")
    return _emitted(docs, names, repetition, entropy, budget, seed, source).select(*docs.columns)
