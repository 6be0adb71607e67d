import math

import numpy as np
import pytest

from gridspark.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, at string, `x.y` int, values string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", 1, "b") for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    """numpy on the whole table: kept ids, x, n, deviations, whitened, explained."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in good], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    white = (x - total / n) @ vectors[:, order] / np.sqrt(values[order])
    return [i for i, _ in good], n, ((n * x - total) ** 2).sum(1), white, values[order] / values.sum()


def table(seed, size=300, width=12):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(size, width)) * np.linspace(1, 3, width)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(vectors)]
    hot = rows[7][1]
    rows += [(size + k, hot) for k in range(size // 2)]  # a third of all rows
    bad = [None, [None] + hot[1:], [float("nan")] + hot[1:], [float("inf")] + hot[1:], hot[:-1], []]
    return rows, rows + [(10_000 + k, v) for k, v in enumerate(bad)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_numpy(spark, seed):
    clean, rows = table(seed)
    got = whiten(frame(spark, rows)).collect()
    ids, n, deviation, white, explained = brute(clean)
    assert len(got) == 4 * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        column = np.array([by[i, k + 1].whitened for i in ids])
        sign = np.sign(column @ white[:, k])
        assert np.abs(column - sign * white[:, k]).max() < 1e-9
        assert abs(by[ids[0], k + 1].explained - explained[k]) < 1e-9
    assert all(by[i, 1].deviation == d and by[i, 1].n == n for i, d in zip(ids, deviation.tolist()))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_repeated_and_null_ids_are_all_returned(spark):
    rows, _ = table(3, 40, 5)
    got = whiten(frame(spark, rows + rows[:3] + [(None, rows[0][1])])).collect()
    assert len(got) == 4 * (len(rows) + 4)
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == rows[0][0] for r in got) == 8
    assert got[0].n == 40


def test_without_variance(spark):
    got = whiten(frame(spark, [(k, [0.5, 0.25]) for k in range(6)])).collect()
    assert len(got) == 12 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    got = whiten(frame(spark, [(k, [float(k), 0.25, 1.0]) for k in range(6)])).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True}
    assert {round(r.explained, 12) for r in got if r.component == 1} == {1.0} and got[0].identity_error < 1e-9


def test_empty_tables(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whiten(frame(spark, [(1, []), (2, [])])).collect() == []


def test_large_entries_keep_deviations_exact_or_null(spark):
    near = [(k, [float(k) * 2**20, 1.0]) for k in range(50)]
    got = {r.vec_id: r.deviation for r in whiten(frame(spark, near)).collect()}
    total = sum(k * 2**28 for k in range(50))
    assert all(got[k] == (50 * k * 2**28 - total) ** 2 if (50 * k * 2**28 - total) ** 2 < 2**63 else got[k] is None for k in range(50))
    far = whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])])).collect()
    assert {r.deviation for r in far} == {None} and len(far) == 6
