r"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity at or above a threshold, as components.

Equal texts are one node. Shingles are ordered from rare to frequent by the number of distinct texts that hold them (counted
over all texts, capped), then by hash; so the prefix of a text that shares little consists of shingles nobody else has, and
the text needs no further look. For the others, with n shingles and a least overlap o(n) with any partner:

* the first common shingle of a linked pair is among the first n - o + 1 of both. If it is rare (held by at most `RARE`
  texts), the pair meets on that single shingle;
* if it is frequent, so are all later common ones. With g classes of shingles by hash, two of the first g + 1 common ones are in
  one class, and the first g + 1 are among the first n - o + g + 1 of both (the extended prefix): the pair meets on a
  combination of two of one class. g follows the set's size in steps of four, so combinations stay in proportion to the set;
  a set is indexed under every g that a partner's size within the similarity's reach may have;
* a second common shingle need not exist where o(n) is 1 (texts of one shingle, say). Such sets index frequent shingles singly
  too, under tokens of their own, so that they meet one another and not the large sets that hold the shingle.

The order among frequent shingles is that of their hashes: they are told from rare ones by a count that stops above `RARE`.

Candidates pass length and positional filters and are verified by exact intersection. Only links between components are
looked for: first each posting list is compared with its earliest member, which connects large groups of copies in linear
time; what the lists still hold of different components is compared pair by pair, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import LOWER, NO_ID, Words, cut, filled, key_order, mix, ordered_id, packed_rows, translated, unused
from tallyboard.llm.components import components
from tallyboard.llm.exchange import KEY_BITS, KEY_MASK, MARK, shared_keys

SHINGLE = 5
PERCENT = 80
RARE = 30

NODES = "node long, n int, vals binary"
POSTINGS = "token long, node long, n int, room int"


def shingle_keys(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, set size per text): distinct shingles of each text; a text of fewer words is one shingle as a whole."""
    words = Words(translated(texts, LOWER))
    h, n = words.hashes(), words.counts
    ends = np.cumsum(n)
    own = words.owners()
    keys, owners = [], []
    if len(h) >= size:
        g = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        inside = ends[own[: len(g)]] - np.arange(len(g)) >= size
        keys.append(mix(g[inside]))
        owners.append(own[: len(g)][inside])
    for few in range(1, size):
        short = np.flatnonzero(n == few)
        start = (ends - n)[short]
        g = np.full(len(short), few, np.uint64)
        for k in range(few):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[start + k]
        keys.append(mix(g))
        owners.append(short)
    key, own = np.concatenate(keys) & KEY_MASK, np.concatenate(owners)
    order = key_order(key, KEY_BITS)
    key, own = key[order], own[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        key, own = key[new], own[new]
    return key, own, np.bincount(own, minlength=len(n))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any partner at least."""
    return -(-(n * percent) // 100)


def text_nodes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, vals) per distinct text; vals (count << 58 | key, rare first) only where the prefix reaches shared shingles."""

    def records(chunk):
        node = chunk.column(0).to_numpy()
        _, first = np.unique(node, return_index=True)
        node = node[first]
        key, own, n = shingle_keys(chunk.column(1).take(pa.array(first)), size)
        return key, own, node, node, (np.uint64(MARK) << np.uint64(KEY_BITS)) | n.astype(np.uint64)

    def finish(ids, counts, vals):
        ends = np.cumsum(counts, dtype=np.int64)
        n = (vals[ends - 1] & KEY_MASK).astype(np.int64)
        shared = counts.astype(np.int64) - 1
        reaches = n - least_overlap(n, percent) + 1 > n - shared
        keep = np.repeat(reaches & (shared > 0), counts)
        keep[ends - 1] = False
        sizes = np.where(reaches & (shared > 0), shared, 0)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int32)), packed_rows(vals[keep], np.cumsum(sizes))], names=["node", "n", "vals"])

    return shared_keys(texts, records, RARE, finish, NODES)


def classes(n: int, percent: int) -> int:
    """Classes of shingles of a set of n: a power of four, about as many as the set's prefix has shingles."""
    g, room = 1, min(n * (100 - percent) // 100, least_overlap(n, percent) - 1)
    while 4 * g <= room:
        g *= 4
    return g


def levels(n: int, percent: int) -> list[int]:
    """The numbers of classes that partners of a set of n may have, its own included."""
    g, last = classes(least_overlap(n, percent), percent), classes(100 * n // percent, percent)
    return [g * 4**k for k in range(20) if g * 4**k <= last]


def combinations(keys: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of `keys` (in order) that are in one of g classes, and the second one's rank in its class."""
    own = (mix(keys + np.uint64(g)) >> np.uint64(20)) % np.uint64(g)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.searchsorted(own, own, "left")
    rank = np.arange(len(own)) - first
    # each place with all before it in its class
    b = np.repeat(np.arange(len(own)), rank)
    a = np.arange(len(b)) - np.repeat(np.cumsum(rank) - rank, rank) + first[b]
    return order[a], order[b], rank[b]


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, room): what each set is indexed under; room bounds the overlap of a pair that first meets there."""

    def run(batches):
        for batch in batches:
            tokens, node, size, room = [], [], [], []
            for i, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                vals = np.frombuffer(raw.as_buffer(), np.uint64)
                alone = n - len(vals)
                reach = int(n - least_overlap(n, percent) + 1 - alone)
                often = np.flatnonzero(vals >> np.uint64(KEY_BITS) > RARE)
                single = np.setdiff1d(np.arange(min(reach, len(vals))), often)
                found = [(mix(vals[single] & KEY_MASK), n - alone - single)]
                if least_overlap(n, percent) < 2:
                    own = often[often < reach]
                    found.append((mix((vals[own] & KEY_MASK) | np.uint64(1 << KEY_BITS)), n - alone - own))
                for g in levels(n, percent):
                    head = vals[often[often < reach + g]] & KEY_MASK
                    a, b, rank = combinations(head, g)
                    # no rare shingle is common to a pair that needs this, nor are those of the class before b, but for a
                    found.append((mix(head[a] * np.uint64(0x9E3779B97F4A7C15) + head[b] + np.uint64(g)), len(often) - rank + 1))
                for t, r in found:
                    tokens.append(t)
                    room.append(r)
                    node.append(np.full(len(t), i))
                    size.append(np.full(len(t), n))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(node), pa.int64()), pa.array(np.concatenate(size), pa.int32()), pa.array(np.concatenate(room), pa.int32())], names=["token", "node", "n", "room"])

    return nodes.where(F.length("vals") > 0).mapInArrow(run, POSTINGS)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Shingles of one text alone can't be common, so vals suffice."""
    sets = nodes.where(F.length("vals") > 0)

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (na, nb, va, vb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5))):
                x, y = np.frombuffer(va.as_buffer(), np.uint64), np.frombuffer(vb.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= percent * (na + nb - common)
            yield batch.select([0, 1]).filter(pa.array(good))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vals").alias("vb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vals").alias("va")), "a")
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, first_ids: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that connect every pair of nodes at or above the similarity."""
    rows = postings(nodes, percent).join(first_ids, "node")

    def fits(na, ra, nb, rb):
        need = percent * (na + nb)
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(ra, rb) >= need)

    hubs = rows.groupBy("token").agg(F.min(F.struct("first_id", "node", "n", "room")).alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    c = F.col
    near_hub = rows.join(hubs, "token").where((c("node") != c("hub.node")) & fits(c("n"), c("room"), c("hub.n"), c("hub.room")))
    links = cut(verified(near_hub.select(c("hub.node").alias("a"), c("node").alias("b")).distinct(), nodes, percent))

    # lists that still hold different components: members of others than the hub's component against all
    labelled = rows.join(components(links).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = labelled.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(F.struct("first_id", "part"))["part"].alias("main")).where("lo < hi").select("token", "main")
    left = cut(labelled.join(mixed, "token").select("token", "node", "n", "room", "part", "main"))
    x = left.where("part <> main").select("token", *[c(k).alias(f"x_{k}") for k in ("node", "n", "room", "part", "main")])
    apart = (c("part") != c("x_part")) & ((c("part") == c("main")) | (c("node") > c("x_node")))
    pairs = left.join(x, (left["token"] == x["token"]) & apart & fits(c("n"), c("room"), c("x_n"), c("x_room")))
    more = verified(pairs.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct(), nodes, percent)
    return links.unionByName(more)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ordered_id().alias("order_id"), filled().alias("text")).withColumn("node", F.xxhash64("text"))


def labelled_nodes(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, least_id, least_node) per distinct text: the smallest id of its component, and the text that stands for the component."""
    nodes = cut(text_nodes(rows.select("node", "text"), size, percent))
    first_ids = cut(rows.groupBy("node").agg(F.min("order_id").alias("first_id")))
    roots = components(near_links(nodes, first_ids, percent))
    least = roots.join(first_ids, "node").groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("least"))
    known = nodes.select("node", "n").join(first_ids, "node").join(roots, "node", "left").join(least, "root", "left")
    return cut(known.select("node", "n", F.coalesce("least.first_id", "first_id").alias("least_id"), F.coalesce("least.node", "node").alias("least_node")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    r"""doc_id, n_shingles, component_id for every row of `docs`.

    Words are ``[^\x20\x09-\x0D]+`` after A-Z became lower case. component_id is the smallest doc_id that links reach, the
    row's own included. Texts without words (null, empty, blank) link with nothing, equal ones included; a null doc_id
    sorts last and stays null if nothing else is in its component. Very long texts count whole; repeated rows get the same answer
    each; no rows give none; other columns are ignored."""
    rows = _rows(docs)
    known = labelled_nodes(rows, size, percent).drop("least_node")
    answer = rows.select("doc_id", "order_id", "node").join(known, "node")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("least_id") < NO_ID, F.col("least_id")))
    return answer.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of `docs`, all columns, for each component: one with its smallest doc_id (null sorts last).

    Components are told apart by their texts, so those that share a doc_id, or have none, keep a row each; of several texts
    with that id in one component the one with the smallest hash stays, of repeated rows any one. Texts without words are no
    duplicates of anything and all stay. No rows give none; columns may be called anything."""
    known, (own_id, own_node) = labelled_nodes(_rows(docs), size, percent), unused(docs, "_id", "_node")
    keep = known.where("n > 0 AND node = least_node").select(F.col("least_id").alias(own_id), F.col("node").alias(own_node))
    worded = filled().rlike(r"[^\x20\x09-\x0D]")
    found = docs.where(worded).withColumns({own_id: ordered_id(), own_node: F.xxhash64(filled())}).join(keep, [own_id, own_node])
    return found.dropDuplicates([own_id, own_node]).select(*docs.columns).unionByName(docs.where(~worded))
