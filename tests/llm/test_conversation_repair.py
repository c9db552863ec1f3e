"""Conversation repair against an exhaustive search, for conversations within a task and across tasks."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from compare import SF, check, connect
from pyspark.sql import functions as F

from tallyboard.llm import conversation_repair as cr
from tallyboard.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, own string, part int, seq long, fault int, same string"
ROLES = {"u": "user", "a": "assistant"}
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault), by all edits at every place; at most two insertions in a row are ever of use."""

    @functools.lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for r in "ua":
            if r in STATES[state] and inserts < 2 and (more := best(i, STATES[state][r], inserts + 1)):
                found.append((more[0] + 3, "I" + more[1], ((ROLES[r], ""), *more[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            if more := best(i + 1, state, 0):
                found.append((more[0] + 4, "D" + more[1], more[2]))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for edit, r, name, cost in [("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)]:
                    if r and r in STATES[state] and (more := best(i + 1, STATES[state][r], 0)):
                        found.append((more[0] + cost + extra, edit + more[1], ((name, text), *more[2])))
        return min(found, key=lambda x: x[:2]) if found else None

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def report(conv, rows):
    """rows: (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    found = faults([r[1:] for r in rows])
    cost, audit, turns = cheapest(tuple((r, x, f) for (_, r, x), f in zip(rows, found)))
    known = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "o", 1, 2, 3, "s") for r in rows], SCHEMA)


def talk(rng, n):
    """Turns in their order, each with its own number: the order of equal turns is then no matter of choice."""
    texts = ["Yes.", "No", "", " \n", "Why?", "Well!  ", "long " * 50, "ü日本.", None]
    return [(k if rng.random() < 0.9 else k + n, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for k in range(n)]


def rows_of(seed, long=0):
    rng, out = random.Random(seed), {}
    for conv in range(60):
        out[conv] = talk(rng, rng.randrange(1, 12))
    out[None] = [(0, "user", "Hello."), (1, "assistant", "Hi.")]
    out[100] = [(None, "user", "Only one.")]
    if long:
        out[30] = talk(rng, long)
        out[31] = [(k, "system" if k == 0 else "user" if rng.random() < 0.6 else "assistant", f"t {k % 50}.") for k in range(long // 2)]
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("long", [0, 300])
def test_reports(spark, parts, long):
    convs = rows_of(parts + long, long)
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    random.Random(0).shuffle(rows)
    found = {r[0]: tuple(r) for r in cr.repair_reports(frame(spark, rows), parts).collect()}
    for conv, own in convs.items():
        assert found[conv] == report(conv, own), conv
    assert len(found) == len(convs)


@pytest.mark.parametrize("parts", [1, 7])
def test_turns(spark, parts):
    convs = rows_of(9, 120)
    turns = {}
    for r in sorted(cr.repaired_turns(frame(spark, [(c, *r) for c, rs in convs.items() for r in rs]), parts).collect(), key=lambda r: (str(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for conv, own in convs.items():
        mine = turns.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == report(conv, own)[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))


def test_one_conversation_of_equal_rows(spark):
    """A hot conversation without turns, of one text: its rows go to several tasks all the same."""
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    rows = cr._prepared(df, 8)
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 5000 / 8
    r = cr.repair_reports(df, 8).first()
    assert r.audit == "K" + "D" * 4999 + "I" and (r.cost, r.duplicate, r.illegal, r.gaps) == (4 * 4999 + 3, 4999, 4999, 0)


def test_no_rows(spark):
    assert cr.repair_reports(frame(spark, [])).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "x", False), (None, 1, "user", "x", False)], "conv_id long, turn long, role string, text string, present boolean")
    nothing = hashlib.sha256().hexdigest()
    assert sorted(map(tuple, cr.repair_reports(gone).collect()), key=str) == [(7, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t in [*range(4), None] for r, x in [("assistant", "A. b! c?")]]
    wanted = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else "A b c" if k == 2 else x
        wanted += [(c, t, "user" if k == 4 else r, x, k != 0)] * (2 if k == 3 else 1)
    assert sorted(map(str, map(tuple, cr.damaged(frame(spark, rows)).collect()))) == sorted(map(str, wanted))


@pytest.mark.parametrize("seed", range(5))
def test_auction(seed):
    rng = random.Random(seed)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(150):
        rows = tuple((rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.choice(names)) for k in range(rng.choice([0, 1, 2, 5, 9, 33, 70])))
        codes = cr.coded("".join(r[0][0] for r in rows), [names.index(r[2]) for r in rows])
        blocks, first = cr.settled_prices(codes, cr.TAIL_COSTS)
        audit, node = cr.traced(blocks, 0)
        assert (first[0], audit + cr.TAILS[node]) == cheapest(rows)[:2]
        for arcs, price in blocks:
            # prices that a path may be traced by never exceed an arc's cost plus the price at its end
            assert all(price[4 * i + x] <= cost + price[4 * i + x + ahead] for i, row in enumerate(arcs) for x in range(4) for _, cost, ahead in row[x])


def test_query(spark):
    check(QUERIES["op12_conversation_repair"](spark, SF), connect(SF), ORACLE_SQL["op12_conversation_repair"])
