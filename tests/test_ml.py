"""The model layer on prices that do depend on the hour and the wind."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.ml import features as fe
from gridspark.ml import linear as li
from gridspark.ml import models as mo
from gridspark.ml import trees as tr
from gridspark.operators.feeds import wind_power


@pytest.fixture(scope="module")
def hours(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1200):
        ts = datetime(2024, 1, 1) + timedelta(hours=k)
        wind, nuclear, temp = rng.uniform(0, 100), rng.uniform(50, 60), rng.uniform(-10, 20)
        price = 50 + 20 * math.sin(2 * math.pi * ts.hour / 24) - 0.3 * wind - 0.5 * temp + rng.gauss(0, 1)
        rows.append((ts, price, wind, nuclear, temp, temp + rng.uniform(-1, 1), 200.0))
    df = spark.createDataFrame(rows, "ts timestamp, price double, wind double, nuclear double, t_1 double, t_2 double, cap double")
    return df.cache()


@pytest.fixture(scope="module")
def price_rows(hours):
    rows, features = fe.price_features(hours, "price", ["wind", "nuclear"], ["t_1", "t_2"], clip=None)
    return rows.cache(), features


@pytest.fixture(scope="module")
def trained(price_rows):
    rows, features = price_rows
    return mo.train_price_model(rows, features, "price", ["ts"], max_iter=30, eta=0.2)


def test_temperatures_are_features(price_rows):
    assert price_rows[1] == [*fe.CALENDAR, "wind", "nuclear", "t_1", "t_2", "temp_mean", "temp_variance"]


def test_price_model_explains_the_price(trained, price_rows):
    ev = trained.evaluation.first()
    held = fe.random_split(price_rows[0], ["ts"], 0.1).where("is_test")
    assert ev.n == held.count() and ev.r2 > 0.8
    assert 1 <= trained.trees <= mo.ROUNDS == mo.fit_boosted.__kwdefaults__["max_iter"]
    assert len(trained.model.trees) == trained.trees


def wave(spark, n=400):
    rng = random.Random(1)
    rows = [(k, rng.uniform(0, 1), rng.random() < 0.3) for k in range(n)]
    return spark.createDataFrame([(k, x, math.sin(12 * x) + rng.gauss(0, 0.3), v) for k, x, v in rows], "k int, x double, y double, v boolean")


def test_patience_stops_early_with_the_best_of_all_rounds(spark):
    df = wave(spark)
    args = {"validation": "v", "depth": 3, "eta": 0.3}
    short = mo.fit_boosted(df, ["x"], "y", max_iter=40, patience=6, **args)
    whole = mo.fit_boosted(df, ["x"], "y", max_iter=40, patience=None, **args)
    assert len(whole.errors) == 41 and len(short.errors) < 41
    assert short.errors == whole.errors[: len(short.errors)]
    assert short.trees == whole.trees == whole.errors.index(min(whole.errors))
    assert len(short.errors) - 1 - short.trees >= 6
    assert short.evaluation.first().mse == pytest.approx(min(whole.errors), rel=1e-6)
    assert len(short.model.trees) == short.trees


def by_hand(rows, splits, fit, rounds):
    """Second-order boosting of squared loss, node by node."""
    x, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    bins = np.array([[sum(s < v for s in cut) for v, cut in zip(row, splits)] for row in x])
    margin = np.full(len(y), y.mean())
    shrink = lambda g: math.copysign(max(abs(g) - fit.l1, 0), g)

    def grow(at, depth):
        g, h = float((margin - y)[at].sum()), float(len(at))
        leaf = -fit.eta * shrink(g) / (h + fit.l2)
        best = (1e-9, None)
        if depth < fit.depth:
            for f in range(bins.shape[1]):
                for b in range(len(splits[f])):
                    left, right = at[bins[at, f] <= b], at[bins[at, f] > b]
                    if min(len(left), len(right)) >= fit.min_child:
                        gl, gr = float((margin - y)[left].sum()), float((margin - y)[right].sum())
                        gain = (shrink(gl) ** 2 / (len(left) + fit.l2) + shrink(gr) ** 2 / (len(right) + fit.l2) - shrink(g) ** 2 / (h + fit.l2)) / 2 - fit.gamma
                        if gain > best[0] + 1e-9:
                            best = (gain, left, right)
        if best[1] is None:
            return [(at, leaf)]
        return grow(best[1], depth + 1) + grow(best[2], depth + 1)

    for _ in range(rounds):
        step = np.zeros(len(y))
        for at, leaf in grow(np.arange(len(y)), 0):
            step[at] = leaf
        margin = margin + step
    return margin


def test_boosting_equals_a_search_node_by_node(spark):
    rng = random.Random(5)
    rows = [((rng.uniform(0, 9), rng.choice([1.0, 2.0, 5.0]), rng.uniform(-1, 1)), rng.gauss(0, 3)) for _ in range(150)]
    rows = [((a, b, c), a * b + 4 * (c > 0) + e) for (a, b, c), e in rows]
    splits = [[1.5 * k for k in range(1, 6)], [1.0, 2.0], [-0.5, 0.0, 0.5]]
    df = spark.createDataFrame([(k, *x, y) for k, (x, y) in enumerate(rows)], "k int, a double, b double, c double, y double")
    for fit in (tr.Fit(rounds=4, depth=3, eta=0.5, l1=1.0, l2=2.0), tr.Fit(rounds=3, depth=4, gamma=5.0, min_child=8)):
        for parts in (1, 5):
            model = tr.fit_trees(df.repartition(parts), ["a", "b", "c"], "y", "k", [fit], splits)[0]
            got = {r.k: r.prediction for r in model.transform(df).select("k", "prediction").collect()}
            want = by_hand(rows, splits, fit, fit.rounds)
            assert max(abs(got[k] - w) for k, w in enumerate(want)) < 1e-6


def test_fits_grow_together_as_they_do_alone(spark):
    df = wave(spark, 300).withColumn("fold", F.col("k") % 3)
    fits = [tr.Fit(train=f"fold <> {k}", held=f"fold = {k}", rounds=12, depth=3, rows=0.7) for k in range(3)]
    fits += [tr.Fit(rounds=5, depth=4, forest=True, l2=0.0), tr.Fit(rounds=11, depth=5, leaves=6)]
    together = tr.fit_trees(df, ["x"], "y", "k", fits)
    for fit, model in zip(fits, together):
        alone = tr.fit_trees(df.repartition(3), ["x"], "y", "k", [fit], model.splits)[0]
        assert [t.value.tolist() for t in alone.trees] == [t.value.tolist() for t in model.trees]
        assert alone.errors == pytest.approx(model.errors, rel=1e-9) and len(model.trees) == fit.rounds
    assert all(int((t.feature >= 0).sum()) <= 5 for t in together[4].trees)
    assert together[0].errors[-1] < together[0].errors[0] / 2


def test_logistic_loss_ranks(spark):
    df = wave(spark, 300).withColumn("y", (F.col("y") > 0).cast("double"))
    model = tr.fit_trees(df, ["x"], "y", "k", [tr.Fit(train="not v", held="v", loss="logistic", rounds=15, depth=3, eta=0.3)])[0]
    assert model.errors[-1] < 0.6 * model.errors[0]
    got = model.transform(df.where("v")).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")), F.min("likelihood"), F.max("likelihood")).first()
    assert got[0] > 0.8 and 0 <= got[1] < got[2] <= 1


def test_bins_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 3.0), (3, float("nan"), 1.0), (4, 2.0, 3.0), (5, 0.0, None)], "k int, x double, y double")
    model = tr.fit_trees(df, ["x"], "y", "k", [tr.Fit(rounds=1, depth=1, eta=1.0, l2=0.0)], [[1.5, 2.5]])[0]
    assert {r.k: round(r.prediction, 6) for r in model.transform(df).collect()} == {1: 1.0, 2: 3.0, 3: 1.0, 4: 3.0, 5: 3.0}
    assert tr.fit_trees(df.where("k > 9"), ["x"], "y", "k", [tr.Fit(rounds=2)], [[1.5]])[0].transform(df).count() == 5


def test_linear_model_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [0, 2000, 5, 0]
    x[:, 3] = 7.0  # constant
    y = x @ [1.0, -0.5, 20.0, 0.0] + rng.normal(size=300)
    df = spark.createDataFrame([(k, *map(float, row), float(v), int(k % 4)) for k, (row, v) in enumerate(zip(x, y))], "k int, a double, b double, c double, d double, y double, fold int")
    names = ["a", "b", "c", "d"]
    sums = li.sums_of_products(df.repartition(5), names, "y", ["fold"])
    model = li.solve(sums, sums.of(lambda g: g[0] != 2), l2=0.0)
    part = np.arange(300) % 4 != 2
    want = np.linalg.lstsq(np.column_stack([np.ones(part.sum()), x[part, :3]]), y[part], rcond=None)[0]
    assert model.coefficients == pytest.approx([*want[1:], 0.0], abs=1e-6) and model.intercept == pytest.approx(want[0], abs=1e-4)
    held = df.where("fold = 2").withColumn("e", F.col("y") - model.column()).agg(F.avg(F.col("e") * F.col("e"))).first()[0]
    assert li.mean_squared_error(sums, sums.of(lambda g: g[0] == 2), model) == pytest.approx(held, rel=1e-9)
    strong = li.solve(sums, sums.of(lambda g: True), l2=0.0, l1=0.3)
    assert (strong.coefficients == 0).any() and (np.abs(strong.coefficients) <= np.abs(li.solve(sums, sums.of(lambda g: True)).coefficients) + 1e-9).all()
    near = li.solve(sums, sums.of(lambda g: True), l2=0.1, l1=1e-12)
    assert near.coefficients == pytest.approx(li.solve(sums, sums.of(lambda g: True), l2=0.1).coefficients, rel=1e-6)


def test_models_are_stored_and_checked(spark, trained, hours, price_rows, tmp_path):
    rows, features = price_rows
    volatile = rows.withColumns({"date": F.date_format("ts", "yyyyMMddHH"), "label": (F.col("price") > 50).cast("double")})
    models = [trained, mo.Trained(mo.fit_linear(rows, features, "price"), features, 0), mo.train_volatility(volatile, ["wind", "t_1"], kind="logistic")]
    for n, model in enumerate(models):
        path = f"{tmp_path}/{n}"
        mo.save_model(spark, model, path)
        back = mo.load_model(spark, path, volatile)
        assert back.features == list(model.features) and back.trees == getattr(model, "trees", 0)
        a, b = (m.transform(volatile).select("ts", "prediction").orderBy("ts").limit(50).collect() for m in (model.model, back.model))
        assert a == b
    with pytest.raises(ValueError):
        mo.load_model(spark, f"{tmp_path}/0", hours)
    with pytest.raises(ValueError):
        mo.load_model(spark, f"{tmp_path}/0", rows.withColumn("wind", F.lit("x")))
    with pytest.raises(Exception):
        mo.save_model(spark, trained, f"{tmp_path}/0")


def test_importances(trained, spark):
    got = {r.feature: r.importance for r in mo.importances(trained, spark).collect()}
    assert sum(got.values()) == pytest.approx(1) and set(got) == set(trained.features)
    assert got["hour_sin"] + got["hour_cos"] + got["wind"] > 0.6 > 0.05 > got["nuclear"]


def test_comparison_and_cross_validation(price_rows):
    rows, features = price_rows
    models = {r.model: r for r in mo.compare_models(rows, features, "price", ["ts"]).collect()}
    assert set(models) == set(mo.COMPARED) and all(r.r2 > 0.5 for r in models.values())
    assert models["second_order"].r2 > 0.9 and models["leaf_limited"].r2 > 0.9
    folds = mo.cross_validate(rows, features, "price", ["ts"])
    assert folds.count() == 5 and folds.agg(F.sum("n")).first()[0] == 1200 and mo.mean_over_folds(folds).first().r2 > 0.9
    late = mo.cross_validate(rows, features, "price", ["ts"], folds=3, expanding=True).collect()
    assert sorted(r.fold for r in late) == [1, 2, 3] and all(r.r2 > 0.8 for r in late)
    trees = mo.cross_validate(rows, features, "price", ["ts"], folds=3, expanding=True, model="second_order", rounds=15, eta=0.3).collect()
    assert sorted((r.fold, r.n) for r in trees) == sorted((r.fold, r.n) for r in late) and all(r.r2 > 0.7 for r in trees)


def test_searches(price_rows):
    rows, features = price_rows
    found = mo.grid_search(rows, features, "price", ["ts"], [{"rounds": 2, "depth": 1}, {"rounds": 8, "depth": 4, "eta": 0.3}]).collect()
    assert [r.trial for r in found] == [1, 0] and found[0].rmse < found[1].rmse
    grids = {"second_order": [{"rounds": 3, "depth": 1}, {"rounds": 8, "depth": 4, "eta": 0.3}], "forest": [{"rounds": 4, "depth": 1}, {"rounds": 4, "depth": 6}], "linear": [{"l2": 50.0}, {"l2": 0.001}]}
    for model, grid in grids.items():
        nested = mo.nested_search(rows, features, "price", ["ts"], grid, outer=3, inner=2, model=model).collect()
        assert sorted(r.outer_fold for r in nested) == [0, 1, 2] and sum(r.n for r in nested) == 1200
        assert all(r.trial == 1 and r.params == str(grid[1]) and r.r2 > 0.6 for r in nested)
        assert all(r.trees is None if model == "linear" else 1 <= r.trees <= grid[1]["rounds"] for r in nested)


def test_share_model_fills_gaps_and_serves_wind_power(hours):
    frame = hours.withColumn("wind", (60 + 40 * F.sin(F.hour("ts") * (2 * math.pi / 24))) * F.lit(1.0))
    rows, features = fe.wind_features(frame, "wind", "cap", ["nuclear", "t_1"])
    model = mo.train_wind_model(rows, features)
    assert model.evaluation.first().r2 > 0.9
    holes = rows.select("ts", *features, "cap", F.when(F.hour("ts") != 6, F.col("wind")).alias("wind"))
    filled = mo.impute_with_model(holes, model, "wind", capacity="cap").where("hour(ts) = 6")
    assert filled.count() == 50 and filled.agg(F.max(F.abs(F.col("wind") - 100))).first()[0] < 10
    shares = mo.share_predictor(model)(rows.limit(5))
    assert "share" in shares.columns


@pytest.mark.parametrize("kind", ["trees", "logistic"])
def test_volatility(spark, kind):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        wild = k % 4 == 0
        rows.append((f"2024-{k:03d}", float(wild), (5.0 if wild else 0.0) + rng.gauss(0, 0.5), rng.random(), None if k % 9 else 1.0))
    df = spark.createDataFrame(rows, "date string, label double, x double, noise double, empty double")
    got = mo.train_volatility(df, ["x", "noise", "empty"], kind=kind)
    assert got.features == ["x", "noise"] and got.evaluation.first().auc > 0.95
    likely = {r.date: r.likelihood for r in mo.predict_volatility(got, df).collect()}
    assert len(likely) == 300 and all(0 <= p <= 1 for p in likely.values()) and likely["2024-000"] > likely["2024-001"]


def test_feature_map_sees_correlation(hours):
    got = {r.feature: r for r in mo.feature_map(hours, ["wind", "nuclear", "t_1", "t_2"], "price").collect()}
    far = lambda a, b: math.dist(*[(got[f].x, got[f].y, got[f].z) for f in (a, b)])
    assert far("t_1", "t_2") < 0.3 < far("t_1", "wind") and far("t_1", "t_2") < far("nuclear", "wind")
    assert all(0 <= v <= 1 for r in got.values() for v in (r.x, r.y, r.z))
    with pytest.raises(ValueError):
        mo.feature_map(hours, ["wind", "nuclear"], "price")


def test_missing_features_are_refused(trained, hours):
    with pytest.raises(ValueError):
        mo.predict(trained.model, hours, trained.features)
