"""Hard negatives and the tree below them against plain loops."""

import math
import random

import numpy as np
import pytest

from tagloom.llm import hard_negatives as hn
from tagloom.llm.gnat import Tree

SCHEMA = "vec_id long, embedding array<float>, label int, n int, leaf int, score double"


def brute(rows, every):
    good = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        good.append((hn.MOST if vec_id is None else vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    anchors = {(i, label, tuple(x)) for i, label, x in good if i != hn.MOST and i % every == 0}
    for i, label, x in anchors:
        scored = sorted((-max(hn.LEAST, min(hn.MOST, sum(a * b for a, b in zip(x, y)))), j, other) for j, other, y in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            window = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, j, k, r[1], -s, -r[0]) for k, r in enumerate(window, 1)]
    return sorted(out)


def clustered(rng, n, dims=8):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[rng.randrange(6)]
        out.append((i, [x + rng.gauss(0, 0.05) for x in c], rng.randrange(4)))
    return out


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], SCHEMA)
    got = hn.hard_negatives(frame, **how)
    return sorted(tuple(hn.MOST if v is None else v for v in r) for r in got.collect())


def test_against_loop(spark):
    rng = random.Random(3)
    rows = clustered(rng, 400)
    rows += [(1000 + i, list(rows[10][1]), i % 3) for i in range(60)]  # copies of one vector: ties
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (10, rows[10][1], rows[10][2]), (11, rows[10][1], 2), (11, rows[10][1], 2)]
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (2004, rows[0][1], None), (2005, [], 3), (2006, [0.5], 1), (2010, [0.1] * 11, 2), (2020, [0.0] * 8, 2)]
    assert run(spark, rows, every=10, block_rows=16, fanout=4) == brute(rows, 10)
    assert run(spark, rows, every=10) == brute(rows, 10)
    assert run(spark, [], every=10) == []
    assert run(spark, [(0, [1.0], 1)], every=10) == []


def test_huge_numbers_and_ties_at_the_ends(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [1e38, 5.0], 2), (3, [-1.0, 2.0], 2), (10, [1e7, 1e7], 1), (11, [1e7 + 8, 1e7], 1), (12, [5e6, 5e6], 3)]
    assert run(spark, rows, every=10) == brute(rows, 10)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_leaves_out_only_what_cannot_match(seed):
    rng = random.Random(seed)
    x = np.floor(256 * np.array([r[1] for r in clustered(rng, 600)]))
    tree = Tree(x[:200], 10, 4, seed)
    leaf = tree.leaf_of(x)
    low, high = {}, {}
    for f in np.unique(leaf):
        low[f], high[f] = tree.ranges(int(f), x[leaf == f])
    tree.set_ranges(low, high)
    q = x[::7]
    s = q @ x.T
    hi = np.stack([np.partition(s, -4, axis=1)[:, -4] * 9 // 10, s.max(1)], axis=1).astype(np.int64)
    lo = np.stack([hi[:, 0] - 2000, hi[:, 1] - 500], axis=1)
    visits, asked = tree.visits(q, lo, hi), 0
    for f in np.unique(leaf):
        needed = ((s[:, None, leaf == f] >= lo[:, :, None]) & (s[:, None, leaf == f] <= hi[:, :, None])).any((1, 2))
        assert set(np.flatnonzero(needed)) <= set(visits.get(int(f), []))
        asked += len(visits.get(int(f), []))
    assert asked < 0.6 * len(q) * len(low)  # the ranges do rule out leaves
