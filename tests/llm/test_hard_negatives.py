"""Hard negatives against scoring everything."""

import math
import random

import numpy as np
import pytest

from glossmill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    used = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        used.append((i, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], -math.inf if x[1] is None else x[1])
    for a, label, q in used:
        if a is None or a % 100:
            continue
        near = sorted(((dot(q, v), i) for i, l, v in used if i != a and l == label), key=order)[:5]
        far = sorted(((dot(q, v), i) for i, l, v in used if l != label), key=order)
        for p, i in near:
            window = [x for x in far if 30 * p <= 100 * x[0] <= 90 * p][:10]
            out += [(a, i, k, n, p, s) for k, (s, n) in enumerate(window, 1)]
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def made(n, dims=6, labels=4, seed=1, shift=0.05):
    rng = random.Random(seed)
    return [(i, [rng.gauss(shift, 0.2) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_against_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rows = made(900)
    got = told(hn.mine(spark.createDataFrame(rows, SCHEMA), block_anchors=4))
    assert got == brute(rows) and len(got) > 300


def test_ties_and_copies(spark):
    """Many equal vectors: the smaller vec_id comes first."""
    rows = made(400, dims=2) + [(1000 + i, [0.5, 0.5], i % 2) for i in range(300)]
    random.Random(2).shuffle(rows)
    assert told(hn.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = made(120) + [
        (200, None, 1), (300, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 2), (600, [0.1] * 6, None),
        (None, [0.3] * 6, 1), (None, [0.3] * 6, 2), (700, [], 1), (800, [0.4, 0.4], 2), (-100, [0.2] * 6, 3), (-7, [0.2] * 6, 9), (901, [0.3] * 8, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "cells", "anchor", "rank", "key", "row"):
        df = df.withColumn(name, df["label"])
    assert told(hn.mine(df)) == brute(rows)


def test_repeated_anchors_are_mined_each(spark):
    rows = made(60) + [(100, [0.3] * 6, 1), (100, [0.3] * 6, 1)]
    once, twice = brute(rows[:-1]), told(hn.mine(spark.createDataFrame(rows, SCHEMA)))
    assert twice == sorted(once + [r for r in once if r[0] == 100], key=str)


def test_large_components(spark):
    """Beyond 64-bit products Python's whole numbers take over; scores that don't fit are told as the nearest that does."""
    rows = [(i, [x * 1e12 for x in v], label) for i, v, label in made(130, dims=3, labels=2)]
    top = (1 << 63) - 1
    got = told(hn.mine(spark.createDataFrame(rows, SCHEMA)))
    assert all(abs(r[4]) <= top and abs(r[5]) <= top for r in got)
    wanted = [r for r in brute(rows) if r[4] <= top]
    assert [r for r in got if r[4] < top] == wanted


def test_empty_and_useless_tables(spark):
    assert told(hn.mine(spark.createDataFrame([], SCHEMA))) == []
    assert told(hn.mine(spark.createDataFrame([(0, None, 1), (1, [0.1], None)], SCHEMA))) == []
    assert told(hn.mine(spark.createDataFrame([(1, [0.1], 2), (2, [0.1], 2)], SCHEMA))) == []
    assert told(hn.mine(spark.createDataFrame([(0, [], 2), (1, [], 2), (2, [], 3)], SCHEMA))) == [(0, 2, 1, 1, 0, 0)]  # 0 is divisible by 7


@pytest.mark.parametrize("scale", [1, 10_000_000])
def test_bounds_hold(scale):
    rng = np.random.default_rng(5)
    floors = np.floor(rng.normal(0, 40 * scale, (300, 7)))
    grid = hn.Grid([int(min(0, x)) for x in floors.min(0)], [max(1, -(-int(max(0, b) - min(0, a) + 1) // hn.CELLS)) for a, b in zip(floors.min(0), floors.max(0), strict=True)])
    exact = hn.whole(floors, grid.largest())
    bounds = hn.Bounds(grid, exact[:20])
    lower = bounds.lower(grid.cells(floors))
    scores = exact @ exact[:20].T
    assert (lower <= scores).all() and (scores <= lower + bounds.gap).all()


def test_most_rows_are_not_scored(spark, monkeypatch):
    """The approximations rule out nearly all rows."""
    rng = np.random.default_rng(4)
    floors = np.floor(rng.normal(0, 32, (20_000, 64)))
    grid = hn.Grid([int(x) for x in floors.min(0)], [max(1, -(-int(b - a + 1) // hn.CELLS)) for a, b in zip(floors.min(0), floors.max(0), strict=True)])
    exact = hn.whole(floors, grid.largest())
    bounds = hn.Bounds(grid, exact[:1])
    lower = bounds.lower(grid.cells(floors))[:, 0]
    tenth = np.sort(exact @ exact[0])[-11]
    assert (lower >= tenth - bounds.gap[0]).mean() < 0.02
