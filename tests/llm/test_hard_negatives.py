"""Hard negatives against plain sums over all pairs."""

import math
import random

import numpy as np
import pytest
from compare import SF, check, connect

from tallyboard.llm import hard_negatives as hn
from tallyboard.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>, anchor int, window int, score long, id long, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    rows = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda i: (i is None, i or 0)
    out = []
    for n, (i, lab, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), place(j), j, other) for m, (j, other, w) in enumerate(rows) if m != n), key=lambda x: x[:2])
        for s, _, j, _ in [x for x in scored if x[3] == lab][:positives]:
            own = [x for x in scored if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, k + 1, x[2], -s, -x[0]) for k, x in enumerate(own)]
    return sorted(out, key=str)


def vectors(seed, n, dims=16, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    rows = [(k, rng.randrange(4), [x + rng.gauss(0, spread / 2) for x in rng.choice(centres)]) for k in range(n)]
    return rows


def odd():
    rows = vectors(3, 60)
    rows += [(100, 1, rows[0][2]), (100, 1, rows[0][2]), (100, 2, rows[0][2]), (None, 1, rows[1][2]), (None, 1, rows[1][2]), (None, 3, rows[2][2]), (200, None, rows[1][2]), (300, 1, None), (400, 1, [math.nan] * 16), (500, 1, [math.inf] + [0.0] * 15), (600, 1, [None] + [0.0] * 15)]
    rows += [(700, 2, []), (800, 3, rows[3][2][:5]), (900, 0, rows[4][2] + [0.5, 0.5]), (1000, 9, rows[5][2]), (1001, 2, [0.0] * 16)]
    return rows + [(2000 + k, 2, rows[6][2]) for k in range(30)] + [(3000 + k, 3, rows[6][2]) for k in range(30)]


@pytest.mark.parametrize("rows", [vectors(0, 400), vectors(1, 300, 64), odd(), [], [(1, 1, [1.0])], [(0, 1, [1.0, 2.0])]], ids=["some", "wide", "odd", "none", "no anchor", "alone"])
@pytest.mark.parametrize("block_bytes", [1, hn.ANCHOR_BYTES])
def test_brute_force(spark, rows, block_bytes):
    if block_bytes == 1:
        rows = [r for r in rows if r[0] is None or r[0] < 300 or r[0] > 900]
        block_bytes = 2000
    found = sorted(map(tuple, hn.hard_negatives(frame(spark, rows).repartition(3), block_bytes=block_bytes).collect()), key=str)
    assert found == brute(rows)


@pytest.mark.parametrize("dims", [1, 15, 16, 17, 40])
def test_scan_is_exact(dims):
    """Whatever the bounds leave out can't be among the best, and what they leave has its exact score."""
    rng = np.random.default_rng(dims)
    rows = rng.integers(-90, 90, (500, dims)).astype(float)
    chunk = hn.Chunk(np.arange(500), np.zeros(500), rows, dims, 90)
    for _ in range(20):
        anchor = rng.integers(-90, 90, dims).astype(float)
        truth = rows @ anchor
        high = int(np.quantile(truth, 0.9))
        for windows in ([(None, None, 5)], [(high // 2, high, 10), (0, high // 3, 3)]):
            best = hn.Best(windows)
            for part in np.array_split(np.arange(500), 4):
                found, scores = chunk.scan(anchor, part, best.windows)
                assert (truth[found] == scores).all()
                best.add(found, scores)
            for k, (low, top, n) in enumerate(windows):
                own = [i for i in np.lexsort((np.arange(500), -truth)) if top is None or low <= truth[i] <= top][:n]
                assert best.ids[k].tolist() == own


def test_bounds_prune():
    """Rows that lie apart from the anchor are left before all dimensions are read."""
    rows = np.concatenate((np.full((5, 64), 50.0), np.random.default_rng(0).integers(-3, 3, (5000, 64))))
    chunk = hn.Chunk(np.arange(len(rows)), np.zeros(len(rows)), rows, 64, 50)
    found, _ = chunk.scan(np.full(64, 50.0), np.arange(len(rows)), hn.Best([(None, None, 5)]).windows)
    assert found.tolist() == list(range(5))


def test_large_numbers(spark):
    """Sums beyond 2**53 are exact too."""
    rows = [(k * 50, k % 2, [float(2**20 + k), float(2**21 - k)]) for k in range(8)]
    found = sorted(map(tuple, hn.hard_negatives(frame(spark, rows)).collect()), key=str)
    assert found == brute(rows)


def test_query(spark):
    check(QUERIES["op13_hard_negatives"](spark, SF), connect(SF), ORACLE_SQL["op13_hard_negatives"])
