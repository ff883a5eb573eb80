"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, a long, slot string, p int"


def plain(rows, positives=5, negatives_each=10):
    """The contract on lists of (vec_id, vector, label), without repeats."""
    kept = []
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [int(v) * 256 if abs(v) > 2**60 else math.floor(256 * v) for v in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    near = lambda v: max(-(2**63) + 1, min(2**63 - 1, v))
    dot = lambda a, b: near(sum(x * y for x, y in zip(a, b, strict=False)))
    best = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    out = []
    for a, x, own in kept:
        if a is None or a % 100:
            continue
        every = [(dot(x, y), i, label) for i, y, label in kept]
        for ps, p, _ in best(f for f in every if f[2] == own and f[1] != a)[:positives]:
            fit = [f for f in every if f[2] != own and 30 * ps <= 100 * f[0] <= 90 * ps]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(best(fit)[:negatives_each])]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = negatives.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()), key=repr)


def test_packed_products_are_exact():
    rng = random.Random(3)
    for top in (1, 300, 2**20, 2**40, 2**70):
        comps = np.array([[rng.randint(-top, top) for _ in range(9)] for _ in range(40)], dtype=np.int64 if top < 2**60 else object)
        anchors = np.array([[rng.randint(-top, top) for _ in range(7)] for _ in range(5)], dtype=np.int64 if top < 2**60 else object)
        for row, got in zip(anchors.tolist(), negatives.Packed(comps).products(anchors), strict=True):
            want = [sum(a * b for a, b in zip(row, c, strict=False)) for c in comps.tolist()]
            assert got.tolist() == [max(-(2**63) + 1, min(2**63 - 1, v)) for v in want]


def test_scaled_rounds_down():
    x = pa.array([[0.5, -0.001], [], [1e300], [-0.0, 1 / 3, 2.0]], pa.list_(pa.float64()))
    assert negatives.scaled(x).tolist() == [[128, -1, 0], [0, 0, 0], [int(1e300) * 256, 0, 0], [0, 85, 512]]


def test_equals_plain_search(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.2, 0.6) for _ in range(6)], rng.randrange(4)) for i in range(420)]
    rows += [(1000 + i, [0.25] * 6, i % 3) for i in range(40)]  # ties
    rows += [(2000, [0.25] * 6, 1), (2100, [0.0] * 6, 1), (2200, [-1.0, 0.5], 2), (2201, [], 2)]
    rows += [(2300, None, 1), (2301, [0.1, None], 1), (2302, [0.1, float("nan")], 1), (2303, [0.1], None), (2304, [float("inf")], 1), (2305, [float("-inf")], 1)]
    want = plain(rows)
    assert len(want) > 100 and found(spark, rows) == want
    # Many groups, a label that most rows have.
    rows = [(i, x, 1 if i is not None and i % 3 else label) for i, x, label in rows]
    assert found(spark, rows, group_rows=16) == plain(rows)


def test_odd_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [0.5], 1)]) == []
    rows = [(100, [1.0, 1e200], 1), (101, [1.0, 1e200], 1), (3, [0.5, 0.5], 2), (None, [0.5, 0.5], 1), (None, [0.2, 1.0], 3)]
    assert found(spark, rows) == plain(rows)
    # A repeated candidate counts twice, a repeated anchor once.
    rows = [(100, [1.0], 1), (100, [1.0], 1), (101, [1.0], 1), (3, [0.5], 2), (3, [0.5], 2)]
    assert found(spark, rows) == [(100, 101, 1, 3, 65536, 32768), (100, 101, 2, 3, 65536, 32768)]


@pytest.mark.parametrize("positive", [-7, 0, 1, 9, 10, 12345])
def test_bounds(positive):
    lo, hi = negatives.bounds(positive)
    fit = [s for s in range(-20000, 20000) if 30 * positive <= 100 * s <= 90 * positive]
    assert fit == list(range(lo, hi + 1))
