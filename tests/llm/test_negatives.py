"""Hard negatives against a search of all rows."""

import math

import numpy as np
import pytest

from layerflow.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, anchor_id string"


def mined(rows, every):
    """The contract, row by row; rows are (vec_id, label, vector)."""
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * x) for x in v])
        ok[i] = min(ok.get(i, r), r)
    out = []
    for a, (own, v) in ok.items():
        if a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), i, label) for i, (label, w) in ok.items() if i != a and len(w) == len(v)
        )
        for p, i, _ in [s for s in scored if s[2] == own][: negatives.POSITIVES]:
            fit = [(-n, j) for n, j, label in scored if label != own and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, i, k + 1, j, -p, n) for k, (n, j) in enumerate(fit[: negatives.NEGATIVES])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)


def same(spark, rows, every=5):
    df = negatives.mine(table(spark, rows), f"vec_id % {every} = 0")
    got = sorted(tuple(r) for r in df.collect())
    assert got == mined(rows, every)
    return got


def vectors(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, dim))
    label = rng.integers(0, labels, n)
    x = centre[label] + rng.standard_normal((n, dim)) * 1.2
    return [(int(k), int(c), [float(y) for y in v.astype(np.float32)]) for k, (c, v) in enumerate(zip(label, x))]


def test_as_a_search_of_all_rows(spark):
    assert same(spark, vectors(700, 8, 1))


def test_ties_and_copies(spark):
    """Many equal vectors, so that ids decide; and one label that holds most rows."""
    rng = np.random.default_rng(2)
    rows = [(k, 0 if k % 3 else k % 2, [1.0, 0.5]) if k % 4 else (k, k % 3, [float(x) for x in rng.integers(-2, 3, 2)]) for k in range(600)]
    rows += [(700 + k, 5, [0.9, 0.45]) for k in range(9)]
    assert same(spark, rows)


def test_odd_rows(spark):
    """Rows that take no part, repeated ids, lengths that differ, scores below zero."""
    good = vectors(60, 3, 3)
    odd = [
        (None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (105, 1, None), (110, 1, []), (115, 1, [1.0, None, 2.0]),
        (120, 1, [float("nan"), 1.0, 1.0]), (125, 1, [float("inf"), 1.0, 1.0]), (130, 1, [0.0, 0.0, 0.0]), (135, 1, [1.0, 2.0]),
        (136, 1, [1.0, 2.0]), (137, 2, [0.8, 1.5]), (10, 0, [9.0, 9.0, 9.0]), (10, 0, [9.0, 9.0, 9.0]), (-5, 1, [-1.0, -1.0, -1.0]),
    ]
    same(spark, good + odd)


def test_nothing_to_find(spark):
    assert same(spark, []) == []
    assert same(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []  # no anchor
    assert same(spark, [(5, 1, [1.0]), (6, 2, [1.0])]) == []  # no positive
    assert same(spark, [(5, 1, [1.0]), (10, 1, [1.0])]) == []  # no negative


def test_great_components_stay_exact(spark):
    rows = [(5 * k, k % 2, [30000.0 + k, -20000.0 + k / 7, 1.0]) for k in range(40)]
    same(spark, rows)


@pytest.mark.parametrize("same_label", [True, False])
def test_search_opens_few_boxes(same_label):
    """Boxes outside the windows or below the kth row stay shut."""
    rng = np.random.default_rng(4)
    n, dim = 20_000, 3
    x = rng.integers(-500, 500, (n, dim)).astype(np.int64)
    tree = negatives.pack(np.arange(n), rng.integers(0, 4, n), x)
    for level, starts in enumerate(tree.starts):
        below = (tree.x, tree.x) if level == 0 else (tree.low[level - 1], tree.high[level - 1])
        for k in range(len(tree.low[level])):
            assert (tree.low[level][k] <= below[0][starts[k] : starts[k + 1]]).all()
            assert (tree.high[level][k] >= below[1][starts[k] : starts[k + 1]]).all()
    q = x[:50]
    floor = np.full((50, 2), 100_000)
    ceiling = np.tile([200_000, 400_000], (50, 1))
    search = negatives.Search(tree, np.arange(50), np.full(50, 1), q, floor, ceiling, 3, same_label)
    search.run()
    assert search.opened < 0.25 * 50 * sum(len(low) for low in tree.low)
    score = q @ tree.x.T
    for k in range(50):
        own = (tree.labels == 1) & (tree.ids != k) if same_label else tree.labels != 1
        for w in range(2):
            fit = np.flatnonzero(own & (score[k] >= floor[k, w]) & (score[k] <= ceiling[k, w]))
            want = sorted((-score[k, i], tree.ids[i]) for i in fit)[:3]
            held = search.score[k, w] > negatives.NONE
            assert [(-s, i) for s, i in zip(search.score[k, w][held], search.found[k, w][held])] == want


def test_shards_and_parts_change_nothing(spark, monkeypatch):
    rows = vectors(400, 4, 5)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 30)
    monkeypatch.setattr(negatives, "PART_ROWS", 17)
    assert same(spark, rows)
