r"""Conversation repair: the cheapest edits that give a conversation its turn structure, by an auction shortest-path algorithm.

A conversation of n rows is a lattice of n + 1 layers with four nodes each: nothing said yet, a system turn, a user turn, an assistant turn as the
last one. Deleting, keeping and giving another role lead one layer on, inserting stays in the layer; costs are integers. The
auction grows a path from the start: every node has a price, never more than the cost of an arc plus the price at its end. At the
path's last node, if no arc attains the price, the price rises to the least of them and the path contracts by that node; else
it extends along the first such (tight) arc in the order of the edits' initials. When it arrives, every price on it is the true
distance, and an arc that was passed over wasn't tight, so the path is the ASCII-least of the cheapest ones: from any node an
initial leads to one node only.

Prices start from the least that each row costs whatever the roles are, and are settled in blocks of `BLOCK` rows from the end, which
keeps the auction linear in the rows.

Rows are dealt by range of (conversation, turn), so a task sees whole conversations in order. A conversation that is longer than a
task's range is cut there (and any at the ends of a range may be): its repeats are found by the first part that has them, each part gives its distances between the four
nodes at both ends, and from the chain of these (one small row for each part) every part is traced on its own. Only the
digest of such a conversation's text is summed in sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, shuffle_width

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows whose prices are settled together.
BLOCK = 32
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
#: From a node: where roles lead, by their initial.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: From a node: the turn that may be inserted or made of another.
WANTED = ("u", "u", "a", "u")
#: From a node behind the last row: what must still be inserted, and at what cost.
TAILS = ("", "II", "I", "")
TAIL_COSTS = [INSERT * len(x) for x in TAILS]
#: From a node: the exits that any edits may lead to.
REACHES = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
SPACE = " \t\n\x0b\x0c\r"

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
EDGE = "conv_id long, part int, seq long, turn long, role string, text string, present boolean, fault int, again boolean, same binary"
#: Rows of a conversation at the end of a range that go into one batch.
PIECE = 1000


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the query's contract damages them. A dropped row stays with `present` false, so that its conversation isn't lost."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_kind"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), F.explode(F.sequence(F.lit(1), copies)).alias("_n")).drop("_n")


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each of the four nodes (initial of the edit, cost, nodes ahead) of a row's arcs, in ASCII order of the initials."""
    out = []
    for x in range(4):
        to = LEADS[x][WANTED[x]]
        arcs = [("D", DELETE, 4), ("I", INSERT, to - x)]
        if fault not in (BLANK, DUPLICATE):
            more = MEND if fault == TRUNCATED else 0
            if initial in LEADS[x]:
                arcs.append(("K", KEEP + more, 4 + LEADS[x][initial] - x))
            arcs.append(("R", REROLE + more, 4 + to - x))
        out.append(arcs)
    return out


ARCS = {(r, f): _arcs(r, f) for r in "sua?" for f in range(4)}
#: What a row costs at least, whatever the path.
LEAST = (min(KEEP, DELETE), DELETE, DELETE, min(KEEP + MEND, DELETE))


def coded(initials: str, faults: list[int]) -> list[tuple[str, int]]:
    return [(r if r in "sua" else "?", f) for r, f in zip(initials, faults)]


def auction(arcs: list, price: list[int], origin: int) -> tuple[str, int] | None:
    """(initials of the edits, exit node) of the cheapest path from a node of the first layer to the last one, whose prices are exact; None if
    there is none. `price` must not exceed any arc's cost plus the price at its end; it is raised in place and stays valid."""
    end, path, letters = 4 * len(arcs), [origin], []
    while True:
        i = path[-1]
        if i >= end:
            return "".join(letters), i - end
        best, pick = NEVER, None
        for arc in arcs[i >> 2][i & 3]:
            cost = arc[1] + price[i + arc[2]]
            if cost < best:
                best, pick = cost, arc
        if pick is None or price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
                letters.pop()
            elif pick is None:
                return None
        else:
            path.append(i + pick[2])
            letters.append(pick[0])


def settled_prices(codes: list[tuple[str, int]], exits: list[int]) -> tuple[list, list[int]]:
    """(blocks of (arcs, prices), distances from the four first nodes) towards exits of the given distances."""
    blocks = []
    for at in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        own = codes[at : at + BLOCK]
        arcs, floor = [ARCS[c] for c in own], [min(exits)]
        for _, fault in reversed(own):
            floor.append(floor[-1] + LEAST[fault])
        # where no exit is in reach, user and assistant turns would raise each other's prices for ever
        lost = [all(exits[y] >= NEVER for y in reach) for reach in REACHES]
        price = [NEVER if gone else h for h in reversed(floor[1:]) for gone in lost] + list(exits)
        for x in range(4):
            auction(arcs, price, x)
        blocks.append((arcs, price))
        exits = price[:4]
    return blocks[::-1], exits


def traced(blocks: list, node: int) -> tuple[str, int]:
    """(audit, exit node) from a node of the first layer along tight arcs."""
    out = []
    for arcs, price in blocks:
        letters, node = auction(arcs, price, node)
        out.append(letters)
    return "".join(out), node


def steps(audit: str, initials: str, node: int = 0) -> list[tuple[str, str, str]]:
    """(initials of inserted turns, edit, its turn's initial if the role changes) for each row, and what is inserted at the end."""
    out, before, row = [], "", 0
    for edit in audit:
        if edit == "I":
            before += WANTED[node]
            node = LEADS[node][WANTED[node]]
            continue
        to = WANTED[node] if edit == "R" else ""
        if edit != "D":
            node = LEADS[node][to or initials[row]]
        out.append((before, edit, to))
        before, row = "", row + 1
    return [*out, (before, "", "")]


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def turns_of(steps_: list[tuple[str, str, str]], roles: list[str], texts: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """(row, number in it, edit, role, text) of the turns that are left."""
    for k, (before, edit, to) in enumerate(steps_):
        for n, x in enumerate(before):
            yield k, n, "I", ROLES[x], ""
        if edit in ("K", "R"):
            yield k, len(before), edit, ROLES[to] if to else roles[k], texts[k]


def _prepared(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in order within ranges of (conversation, turn), with what faults need. Rows that agree in all of the order are interchangeable;
    the row's own number lets even those go to several ranges."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), F.coalesce(present, F.lit(True)).alias("present"))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    same = F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    own = own.withColumns({"fault": fault, "same": same, "_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_h", "_row"]
    return own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present", "fault", "same")


class _Run:
    """The rows of a conversation that a task has, and which of them repeat an earlier one."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults, self.same, self.seen, self.gone = [], [], [], [], [], set(), 0

    def add(self, turn, role, text, fault, same) -> None:
        again = same in self.seen
        self.seen.add(same)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.same.append(same)
        self.faults.append(DUPLICATE if again and fault != BLANK else fault)

    def initials(self) -> str:
        return "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r in self.roles)

    def pieces(self) -> Iterator[list[tuple]]:
        """(turn, role, text, present, fault, again, same) of the rows; one that isn't present stands for all such."""
        if self.gone:
            yield [(None, "", "", False, BLANK, False, b"")]
        for at in range(0, len(self.turns), PIECE):
            own = slice(at, at + PIECE)
            yield [(t, r, x, True, f, f == DUPLICATE, h) for t, r, x, f, h in zip(self.turns[own], self.roles[own], self.texts[own], self.faults[own], self.same[own])]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, _Run, bool]]:
    """(conv_id, rows, is it the last one) of the conversations of a partition, one after the other."""
    conv, run = None, None
    for batch in batches:
        for i, turn, role, text, present, fault, same in zip(*(c.to_pylist() for c in batch.columns)):
            if run is None or i != conv:
                if run is not None:
                    yield conv, run, False
                conv, run = i, _Run()
            if present:
                run.add(turn, role, text, fault, same)
            else:
                run.gone += 1
    if run is not None:
        yield conv, run, True


def _mend(run: _Run) -> tuple[int, str, list]:
    """(cost, audit, steps) of a whole conversation."""
    initials = run.initials()
    blocks, first = settled_prices(coded(initials, run.faults), TAIL_COSTS)
    audit, node = traced(blocks, 0)
    audit += TAILS[node]
    return first[0], audit, steps(audit, initials)


def _digest(turns: Iterator[tuple]) -> str:
    out, between = hashlib.sha256(), b""
    for *_, role, text in turns:
        out.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return out.hexdigest()


def _arrow(schema: str) -> pa.StructType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.struct([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _first_pass(rows: DataFrame, turns: bool) -> DataFrame:
    """(done, row): reports (or turns) of the conversations inside a task's range, and the rows of those at its two ends, which
    other tasks may have too. This is the only pass over the ranges, so it doesn't matter that a range is drawn anew when a task is."""
    made, kept = _arrow(TURNS if turns else REPORT), _arrow(EDGE)
    names = ([f.name for f in made], [f.name for f in kept])

    def out(done: list[tuple], some: list[tuple]) -> pa.RecordBatch:
        done_, some_ = [dict(zip(names[0], x)) for x in done], [dict(zip(names[1], x)) for x in some]
        return pa.RecordBatch.from_arrays([pa.array(done_ + [None] * len(some_), made), pa.array([None] * len(done_) + some_, kept)], names=["done", "row"])

    def report(batches):
        part, done, size = TaskContext.get().partitionId(), [], 0
        runs = _runs(batches)
        for first, (conv, run, is_last) in enumerate(runs):
            if first == 0 or is_last:
                at = 0
                for some in run.pieces():
                    yield out([], [(conv, part, at + k, *x) for k, x in enumerate(some)])
                    at += len(some)
                continue
            cost, audit, each = _mend(run)
            if turns:
                done += [(conv, k << 2 | n, *rest) for k, n, *rest in turns_of(each, run.roles, run.texts)]
            else:
                known = [t for t in run.turns if t is not None]
                gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
                done.append((conv, gaps, *(run.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(run.initials()), cost, audit, _digest(turns_of(each, run.roles, run.texts))))
            size += sum(len(t) for t in run.texts) if turns else len(audit) + 200
            if size > 1 << 20:
                yield out(done, [])
                done, size = [], 0
        if done:
            yield out(done, [])

    fields = lambda schema: ", ".join(x.replace(" ", ": ") for x in schema.split(", "))
    return rows.mapInArrow(report, f"done struct<{fields(TURNS if turns else REPORT)}>, row struct<{fields(EDGE)}>")


def _parts(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For conversations at the ends of ranges: (their rows by (own, part, seq), their parts with codes, the plan of each part)."""
    new = tagged.where(f"present AND NOT again AND fault <> {BLANK}").select("own", "same", "part", "seq")
    earlier = new.groupBy("own", "same").agg(F.min("part").alias("first_part"))
    repeats = new.join(earlier, ["own", "same"]).where("part > first_part").select("own", "part", "seq", F.lit(True).alias("_again"))
    rows_ = tagged.where("present").join(repeats, ["own", "part", "seq"], "left")
    rows_ = cut(rows_.select("own", "part", "seq", "turn", "role", "text", F.when((F.col("again") | F.col("_again")) & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault")))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("?")
    codes = rows_.groupBy("own", "part").agg(F.sort_array(F.collect_list(F.struct("seq", initial.alias("initial"), F.col("fault").cast("int").alias("fault")))).alias("codes"))
    codes = cut(codes.select("own", "part", F.array_join("codes.initial", "").alias("initials"), F.col("codes.fault").alias("faults")))

    def distances(batches):
        for batch in batches:
            for own, part, initials, faults in zip(*(c.to_pylist() for c in batch.columns)):
                to = [settled_prices(coded(initials, faults), [0 if x == y else NEVER for x in range(4)])[1] for y in range(4)]
                flat = [to[y][x] for x in range(4) for y in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([part], pa.int32()), pa.array([flat], pa.list_(pa.int64())), pa.array([initials[0] + initials[-1]]), pa.array([illegal_pairs(initials)], pa.int64())], names=["own", "part", "between", "ends", "illegal"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, exits, out = pdf.sort_values("part"), list(TAIL_COSTS), []
        for between in reversed(pdf["between"].tolist()):
            out.append(list(exits))
            exits = [min(between[4 * x + y] + exits[y] for y in range(4)) for x in range(4)]
        ends = pdf["ends"].tolist()
        across = sum(illegal_pairs(a[1] + b[0]) for a, b in zip(ends, ends[1:]))
        return pd.DataFrame({"own": pdf["own"], "part": pdf["part"], "exits": out[::-1], "cost": exits[0], "illegal": int(pdf["illegal"].sum()) + across})

    plan = codes.repartition("own", "part").mapInArrow(distances, "own string, part int, between array<long>, ends string, illegal long").groupBy("own").applyInPandas(chain, "own string, part int, exits array<long>, cost long, illegal long")
    return rows_, codes, cut(plan)


def _traced_parts(codes: DataFrame, plan: DataFrame) -> DataFrame:
    """(own, part, audit, node): each part's edits, from the node at which the parts before it end."""

    def trace(batches):
        for batch in batches:
            for own, part, initials, faults, exits in zip(*(c.to_pylist() for c in batch.columns)):
                blocks, first = settled_prices(coded(initials, faults), exits)
                found = [traced(blocks, x) if first[x] < NEVER else ("", 0) for x in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([part], pa.int32()), pa.array([[a for a, _ in found]], pa.list_(pa.string())), pa.array([[x for _, x in found]], pa.list_(pa.int32()))], names=["own", "part", "audits", "nodes"])

    each = cut(codes.join(plan.select("own", "part", "exits"), ["own", "part"]).mapInArrow(trace, "own string, part int, audits array<string>, nodes array<int>"))
    # only the parts' four exits are chained, one small row for each part
    so_far = W.partitionBy("own").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    chained = each.select("own", "part", "nodes").withColumn("_before", F.collect_list("nodes").over(so_far))
    node = F.aggregate("_before", F.lit(0), lambda x, m: F.element_at(m, x + 1))
    last = F.row_number().over(W.partitionBy("own").orderBy(F.col("part").desc())) == 1
    entered = chained.select("own", "part", node.alias("node"), last.alias("last"))
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), F.element_at("nodes", F.col("node") + 1) + 1)
    return each.join(entered, ["own", "part"]).select("own", "part", "node", F.concat(F.element_at("audits", F.col("node") + 1), F.when(F.col("last"), tail).otherwise("")).alias("audit"))


def _long(edges: DataFrame, turns: bool) -> DataFrame:
    """Reports (or turns) of the conversations of these rows (`EDGE`)."""
    edges = edges.withColumn("own", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    ids = edges.select("own", "conv_id").distinct()
    rows_, codes, plan = _parts(edges)
    audits = cut(_traced_parts(codes, plan))

    def explained(batches):
        for batch in batches:
            for own, part, initials, node, audit in zip(*(c.to_pylist() for c in batch.columns)):
                each = steps(audit, initials, node)
                before, edit, to = zip(*each)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(each), pa.string()), pa.array([part] * len(each), pa.int32()), pa.array(range(len(each)), pa.int64()), pa.array(before), pa.array(edit), pa.array(to)], names=["own", "part", "step", "before", "edit", "to"])

    each = codes.select("own", "part", "initials").join(audits, ["own", "part"]).select("own", "part", "initials", "node", "audit").mapInArrow(explained, "own string, part int, step long, before string, edit string, to string")
    step = F.row_number().over(W.partitionBy("own", "part").orderBy("seq")) - 1
    met = each.join(rows_.select("own", "part", step.cast("long").alias("step"), "role", "text"), ["own", "part", "step"], "left")
    name = lambda x: F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"])
    turn = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    inserted = F.transform(F.filter(F.split("before", ""), lambda x: x != ""), lambda x: turn(F.lit("I"), name(x), F.lit("")))
    kept = F.when(F.col("edit").isin("K", "R"), F.array(turn(F.col("edit"), F.when(F.col("to") != "", name(F.col("to"))).otherwise(F.col("role")), F.col("text"))))
    made = met.select("own", "part", "step", F.posexplode(F.concat(inserted, F.coalesce(kept, F.slice(F.array(turn(F.lit(""), F.lit(""), F.lit(""))), 1, 0)))).alias("n", "x")).select("own", "part", "step", "n", "x.edit", "x.role", "x.text")
    if turns:
        place = F.shiftleft(F.col("part").cast("long"), 42) + F.shiftleft("step", 2) + F.col("n")
        return made.join(ids, "own").select("conv_id", place.alias("place"), "edit", "role", "text")

    def summed(batches):
        own, digest, out = None, None, []
        for batch in batches:
            for i, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if i != own:
                    if digest:
                        out.append((own, digest.hexdigest()))
                    own, digest, between = i, hashlib.sha256(), b""
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        if digest:
            out.append((own, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string()))], names=["own", "sha"])

    sums = made.repartition("own").sortWithinPartitions("own", "part", "step", "n").select("own", "role", "text").mapInArrow(summed, "own string, sha string")
    count: dict[str, Column] = {name: F.count_if(F.col("fault") == f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    facts = rows_.groupBy("own").agg(*[x.alias(k) for k, x in count.items()], F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    distinct = rows_.where("turn IS NOT NULL").select("own", "turn").distinct().groupBy("own").agg(F.count(F.lit(1)).alias("known"))
    costs = plan.groupBy("own").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    audit = audits.groupBy("own").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = ids
    for more in (facts, distinct, costs, audit, sums):
        out = out.join(more, "own", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("known"), F.lit(0).cast("long")).alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _mended(rows: DataFrame, turns: bool, parts: int | None) -> DataFrame:
    both = cut(_first_pass(_prepared(rows, parts or shuffle_width(rows.sparkSession)), turns))
    return both.where("done IS NOT NULL").select("done.*").unionByName(_long(both.where("row IS NOT NULL").select("row.*"), turns))


def repair_reports(rows: DataFrame, parts: int | None = None) -> DataFrame:
    r"""One row for each conversation of `rows` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows count in the order of turn (nulls first), role and a hash of the text; null roles and texts are one blank, rows without a conv_id
    are a conversation together. A row's first fault counts: blank, duplicate of an earlier role and text, truncated. gaps counts
    turns that are missing between the first and the last (none without turns), illegal the neighbours that aren't su, ua or au by
    their initials. The audit has the initials of the cheapest edits (Keep, Rerole, Delete, Insert) to ``(s?(ua)+)?``, ASCII-least
    among equals. Rows whose optional column `present` is false only name their conversation; one without other rows gets
    zeros, an empty audit and the digest of nothing. Long texts count whole; other columns are ignored; no rows give none. `parts`: tasks to
    which rows are dealt (default: the session's)."""
    return _mended(rows, False, parts)


def repaired_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, place (increasing within a conversation), edit, role and text of the turns that are left or inserted; `rows` as in `repair_reports`."""
    return _mended(rows, True, parts)
