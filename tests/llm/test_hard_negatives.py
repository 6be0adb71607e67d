import math

import numpy as np
import pytest

from gridspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, who string, `x.y` int, tile int"


def frame(spark, rows):
    floats = lambda v: v and [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), label, "a", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows, positives=5, negatives=10, every=10, window=(30, 90)):
    whole = {
        (i, label, tuple(math.floor(256 * float(np.float32(c))) for c in v))
        for i, v, label in rows
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []
    for a, label, x in (r for r in whole if r[0] % every == 0):
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scored = sorted(((-clip(sum(p * q for p, q in zip(x, y))), i, other) for i, other, y in whole if i != a), key=lambda r: r[:2])
        for p, i, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and window[0] * -p <= 100 * -r[0] <= window[1] * -p]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fits[:negatives])]
    return sorted(out)


def rows_of(seed, n=400, width=6, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, width))
    label = rng.integers(0, labels, n)
    v = middle[label] * spread + rng.normal(size=(n, width))
    return [(k, [float(np.float32(c)) for c in v[k]], int(label[k])) for k in range(n)]


@pytest.mark.parametrize("seed, tile", [(1, 32), (2, 64), (3, 1000)])
def test_equals_brute_force(spark, seed, tile):
    rows = rows_of(seed)
    hot = [(1000 + k, rows[5][1], rows[5][2]) for k in range(150)]  # one vector of many rows, ties by id
    ties = [(2000 + k, [1.0, 0, 0, 0, 0, 0], k % 4) for k in range(40)]
    bad = [(3000, None, 1), (3010, [None, 0, 0, 0, 0, 0.0], 1), (3020, [float("nan"), 0, 0, 0, 0, 0], 1), (3030, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += hot + ties
    given = rows + bad + rows[:7] + [(3040, [1.0, 2.0], 1)]  # repeated rows, and another length
    got = H.hard_negatives(frame(spark, given), every=10, tile=tile).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_ids_shared_by_different_rows(spark):
    rows = rows_of(4, 120)
    rows += [(i, [-c for c in v], (label + 1) % 4) for i, v, label in rows[:40]]
    got = H.hard_negatives(frame(spark, rows), every=10, tile=32).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_few_rows_and_none(spark):
    assert H.hard_negatives(frame(spark, [])).collect() == []
    assert H.hard_negatives(frame(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (3, [5.0, 0.0], 2), (4, [-1.0, 0.0], 1)]
    got = H.hard_negatives(frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]


def test_numbers_that_floats_do_not_hold(spark):
    large = [(k, [1e9 * (k % 7 - 3), 3.0 * k, -1e9], k % 2) for k in range(60)]  # products beyond a long
    got = H.hard_negatives(frame(spark, large), every=10, tile=16, window=(0, 100)).collect()
    assert got and sorted(tuple(r) for r in got) == brute(large, window=(0, 100))
    small = [(k, [float(2**16 + k), 3.0 * k, -1.0], k % 2) for k in range(60)]  # products beyond 2^53
    small = [(k, [v[0] * 64, v[1], v[2]], label) for k, v, label in small]
    got = H.hard_negatives(frame(spark, small), every=10, tile=16, window=(0, 100)).collect()
    assert sorted(tuple(r) for r in got) == brute(small, window=(0, 100))


def test_tree_finds_what_a_scan_finds_and_skips_boxes():
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(20, 4)) * 500
    x = (middle[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 4)) * 5).astype(np.int64)
    ids, labels = rng.permutation(3000), rng.integers(0, 3, 3000)
    order = H.Tree.order(ids, labels, x)
    assert sorted(order.tolist()) == list(range(3000))
    tree = H.Tree(ids[order], labels[order], x[order])
    assert len(tree.levels[-1][0]) == 1
    q = x[:20]
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ other

    plain = H.exact
    H.exact = lambda a, b: [plain(a, b)[0].view(Counted), plain(a, b)[1]]
    try:
        got = tree.search(q, ids[:20], labels[:20], [[H.ANYTHING]] * 20, 5, True)
    finally:
        H.exact = plain
    for n in range(20):
        score = x @ q[n]
        may = np.flatnonzero((labels == labels[n]) & (ids != ids[n]))
        best = sorted(((int(score[k]), int(ids[k])) for k in may), key=lambda p: (-p[0], p[1]))[:5]
        assert got[n][0] == best
    assert sum(scored) < 20 * 3000 / 2


def test_windows_that_decide_by_id():
    x = np.array([[10, 0]] * 100 + [[9, 0]] * 100)
    ids, labels = np.arange(200)[::-1].copy(), np.zeros(200, np.int64)
    order = H.Tree.order(ids, labels, x)
    tree = H.Tree(ids[order], labels[order], x[order])
    find = lambda want: tree.search(np.array([[1, 0]]), np.array([999]), np.array([1]), [[want]], 3, False)[0][0]
    assert find(H.Want(0, 0, 100, None)) == [(10, 100), (10, 101), (10, 102)]
    assert find(H.Want(0, 0, 9, None)) == [(9, 0), (9, 1), (9, 2)]
    assert find(H.Want(0, 0, 100, (10, 101))) == [(10, 100), (10, 101), (10, 102)]
    assert find(H.Want(0, 0, 100, (10, 5))) == []
    assert find(H.Want(0, 11, 100, None)) == []
