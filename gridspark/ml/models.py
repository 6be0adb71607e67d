"""Fitted models: price regression, wind share, daily volatility, comparison, search, storage."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import class_weight, classifier_metrics, forecast_evaluation
from ..operators.serving import feature_profile
from ..session import materialize
from .features import chronological_split, random_folds, random_split, screen_features, stratified_split, time_folds
from .linear import Linear, fold_predictions, mean_squared_error, solve, sums_of_products
from .trees import Ensemble, Fit, best_round, bin_splits, fit_trees

SEED = 42
ROUNDS, PATIENCE, INNER_PATIENCE = 100, 10, 5


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


@dataclass(frozen=True)
class Trained:
    model: Ensemble | Linear | PipelineModel
    features: list[str]
    trees: int
    evaluation: DataFrame | None = None
    errors: list[float] = field(default_factory=list)  # held-out error after 0, 1, … trees


def _require(df: DataFrame, features: Sequence[str]) -> None:
    if gone := [c for c in features if c not in df.columns]:
        raise ValueError(f"missing feature columns: {gone}")


def fit_boosted(
    train: DataFrame, features: Sequence[str], target: str, *, validation: str, max_iter: int = ROUNDS, depth: int = 5, patience: int | None = PATIENCE, **params
) -> Trained:
    """Second-order boosted trees.  Trees are added on the rows that `validation` does not mark,
    until the error on the marked rows has not improved for `patience` rounds (None: all
    `max_iter`).  The number of trees with the least error is kept; its metrics on the marked rows
    are returned with a model of that many trees on all rows, which grows beside the first one."""
    fit = Fit(train=f"not {validation}", held=validation, rounds=max_iter, depth=depth, patience=patience, seed=SEED, **params)
    probe, whole = fit_trees(train, features, target, features, [fit, replace(fit, train="true", held="false", follow=(0,))])
    trees = best_round(probe.errors)
    held = predict(probe.first(trees), train.where(F.col(validation)), features)
    return Trained(whole.first(trees), list(features), trees, evaluate(held, target), probe.errors)


def train_price_model(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], **kw) -> Trained:
    """Random tenth held out by a hash of the key."""
    return fit_boosted(random_split(df, key, 0.1), features, target, validation="is_test", **kw)


def train_wind_model(df: DataFrame, features: Sequence[str], target: str = "share", ts: str = "ts", **kw) -> Trained:
    """Last tenth by time held out."""
    return fit_boosted(chronological_split(df, 0.1, ts), features, target, validation="is_test", **kw)


def predict(model: Ensemble | Linear | PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    _require(df, features)
    return model.transform(df).drop("features", "rawPrediction")


def share_predictor(trained: Trained) -> Callable[[DataFrame], DataFrame]:
    """For `operators.feeds.wind_power`: predicts the capacity share of the rows it gets."""
    return lambda rows: predict(trained.model, rows, trained.features).withColumnRenamed("prediction", "share")


def impute_with_model(df: DataFrame, trained: Trained, value: str, capacity: str | None = None) -> DataFrame:
    """Predict only where the value is missing, scaled back by the capacity."""
    known, gaps = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    scale = F.col(capacity) if capacity else F.lit(1.0)
    filled = predict(trained.model, gaps, trained.features).withColumn(value, F.col("prediction") * scale)
    return known.unionByName(filled.select(*df.columns))


@dataclass(frozen=True)
class Volatility:
    model: PipelineModel
    features: list[str]
    evaluation: DataFrame


def _likelihood(scored: DataFrame) -> DataFrame:
    return scored.withColumn("likelihood", vector_to_array("probability")[1])


def train_volatility(df: DataFrame, features: Sequence[str], *, key: str = "date", kind: str = "trees", max_iter: int = 20) -> Volatility:
    """Daily classifier: features with few nulls, nulls to the median, stratified split,
    standardised, weighted by class; boosted trees or logistic regression with an L2
    penalty.  The transformations are fitted on the training rows and travel with the model."""
    from pyspark.ml.feature import Imputer

    kept = screen_features(df, features)
    typed = df.select(key, "label", *[F.col(c).cast("double").alias(c) for c in kept])
    # Written once: every iteration of the learners reads the rows again.
    split = materialize(stratified_split(typed, "label", key, 0.2), "split")
    train = class_weight(split.where(~F.col("is_test")), "label")
    filled = [f"{c}_filled" for c in kept]
    imputer = Imputer(strategy="median", relativeError=0.0001, inputCols=kept, outputCols=filled)
    raw = VectorAssembler(inputCols=filled, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    if kind == "trees":
        learner = GBTClassifier(labelCol="label", weightCol="weight", maxIter=max_iter, maxDepth=3, seed=SEED)
    else:
        learner = LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, elasticNetParam=0.0, maxIter=200)
    model = Pipeline(stages=[imputer, raw, scaler, learner]).fit(train)
    scored = _likelihood(model.transform(split.where("is_test")))
    return Volatility(model, kept, classifier_metrics(scored, "label", "likelihood"))


def predict_volatility(trained: Volatility, daily: DataFrame) -> DataFrame:
    """(date, likelihood)."""
    _require(daily, trained.features)
    rows = daily.withColumns({c: F.col(c).cast("double") for c in trained.features})
    return _likelihood(trained.model.transform(rows)).select("date", "likelihood")


#: Learners by name.  The sets are parameters of `linear.solve`, of `trees.Fit` or of MLlib.
TREES: dict[str, dict] = {
    "second_order": {"rounds": 40, "depth": 5},
    "leaf_limited": {"rounds": 40, "depth": 7, "leaves": 24},
    "forest": {"rounds": 30, "depth": 6, "l2": 0.0, "forest": True},
}
MLLIB: dict[str, Callable[..., object]] = {
    "random_forest": lambda target: RandomForestRegressor(labelCol=target, numTrees=100, maxDepth=5, seed=SEED),
    "boosted_trees": lambda target: GBTRegressor(labelCol=target, maxIter=40, maxDepth=5, seed=SEED),
}
COMPARED = ("linear", "random_forest", "boosted_trees", "second_order", "leaf_limited")


def evaluate(predictions: DataFrame, target: str, groups: Sequence[str] = ()) -> DataFrame:
    rows = predictions if "ts" in predictions.columns else predictions.withColumn("ts", F.lit(None).cast("timestamp"))
    return forecast_evaluation(rows, target, "prediction", groups).drop("first_ts", "last_ts")


def fit_linear(train: DataFrame, features: Sequence[str], target: str, **params) -> Linear:
    sums = sums_of_products(train, features, target)
    return solve(sums, sums.of(lambda group: True), **params)


def compare_models(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], models: Sequence[str] = COMPARED) -> DataFrame:
    """Held-out metrics per model, best first.  Trees of this package grow together."""
    split = random_split(df, key, 0.2)
    train, test = split.where("not is_test"), split.where("is_test")
    own = [name for name in models if name in TREES]
    fitted: dict[str, object] = dict(zip(own, fit_trees(train, features, target, key, [Fit(seed=SEED, **TREES[n]) for n in own]) if own else []))
    if mllib := [name for name in models if name in MLLIB]:
        data = assembler(features).transform(train).select(target, "features")
        fitted |= {name: PipelineModel([assembler(features), MLLIB[name](target).fit(data)]) for name in mllib}
    if "linear" in models:
        fitted["linear"] = fit_linear(train, features, target)
    scored = None
    for name in models:
        out = predict(fitted[name], test, features).select(F.lit(name).alias("model"), target, "prediction")
        scored = out if scored is None else scored.unionByName(out)
    return evaluate(scored, target, ["model"]).orderBy("mae")


def cross_validate(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], *, folds: int = 5, model: str = "linear", expanding: bool = False, ts: str = "ts", **params) -> DataFrame:
    """Metrics per fold.  Shuffled folds by a hash of the key, or expanding time folds.  `params`
    are those of `linear.solve` or of `trees.Fit`."""
    data = time_folds(df, folds, ts) if expanding else random_folds(df, key, folds)
    tested = range(1, folds + 1) if expanding else range(folds)
    if model == "linear":
        sums = sums_of_products(data, features, target, ["fold"])
        part = lambda k: sums.of(lambda group: group[0] < k if expanding else group[0] != k)
        scored = fold_predictions(data, {k: solve(sums, part(k), **params) for k in tested}, "fold")
        return evaluate(scored.select("fold", target, "prediction"), target, ["fold"])
    fits = [Fit(train=f"fold {'<' if expanding else '<>'} {k}", seed=SEED, **{**TREES[model], **params}) for k in tested]
    fitted = dict(zip(tested, fit_trees(data, features, target, key, fits)))
    return evaluate(_by_fold(data, fitted, features, target, "fold"), target, ["fold"])


def _by_fold(data: DataFrame, fitted: dict[int, Ensemble], features: Sequence[str], target: str, fold: str) -> DataFrame:
    """The rows of every fold with the prediction of its model."""
    scored = None
    for k, model in fitted.items():
        out = predict(model, data.where(F.col(fold) == k), features).select(fold, target, "prediction")
        scored = out if scored is None else scored.unionByName(out)
    return scored


def mean_over_folds(per_fold: DataFrame) -> DataFrame:
    """Means of the fold metrics; RMSE is the root of the mean MSE."""
    return per_fold.agg(
        F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.avg("r2").alias("r2"), F.avg("smape").alias("smape")
    ).withColumn("rmse", F.sqrt("mse"))


#: Parameter sets that are searched, by model; the learner's other parameters stay as in `TREES`.
GRIDS: dict[str, list[dict]] = {
    "linear": [{"l2": 0.001}, {"l2": 0.1}, {"l2": 0.001, "l1": 0.01}],
    "second_order": [{"depth": 3}, {"depth": 5, "l2": 5.0}],
    "forest": [{"depth": 4}, {"depth": 6}],
}


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], grid: Sequence[dict] | None = None, *, folds: int = 3, model: str = "second_order"
) -> DataFrame:
    """Mean fold metrics for every parameter set of the model, best first.  All sets and folds are
    fitted over the same sums or binned rows."""
    grid = GRIDS[model] if grid is None else grid
    data = random_folds(df, key, folds).select(*dict.fromkeys([*key, *features, target, "fold"]))
    cells = [(i, k) for i in range(len(grid)) for k in range(folds)]
    if model == "linear":
        sums = sums_of_products(data, features, target, ["fold"])
        fitted: list = [solve(sums, sums.of(lambda group: group[0] != k), **grid[i]) for i, k in cells]
    else:
        fits = [Fit(train=f"fold <> {k}", seed=SEED, **{**TREES[model], **grid[i]}) for i, k in cells]
        fitted = fit_trees(data, features, target, key, fits)
    scored = None
    for i in range(len(grid)):
        own = {k: m for (j, k), m in zip(cells, fitted) if j == i}
        out = fold_predictions(data, own, "fold") if model == "linear" else _by_fold(data, own, features, target, "fold")
        out = out.select("fold", target, "prediction").withColumn("trial", F.lit(i))
        scored = out if scored is None else scored.unionByName(out)
    means = evaluate(scored, target, ["trial", "fold"]).groupBy("trial").agg(*(F.avg(c).alias(c) for c in ("mae", "mse", "r2", "smape")))
    names = F.array(*(F.lit(str(g)) for g in grid))
    return means.select("trial", F.get(names, F.col("trial")).alias("params"), "mae", "mse", "r2", "smape", F.sqrt("mse").alias("rmse")).orderBy("rmse", "trial")


def nested_search(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], grid: Sequence[dict] | None = None, *, outer: int = 5, inner: int = 3, model: str = "second_order"
) -> DataFrame:
    """Search inside each outer training part: per outer fold the chosen parameter set (`trial`,
    `params`), its number of trees (boosting: the mean of the best inner rounds), and its metrics.

    Every inner and outer fit of every set grows over the same binned rows, or is solved from the
    same sums by (outer fold, inner fold).  Inner boosting stops after `INNER_PATIENCE` rounds
    without gain, and the outer fit of the set with the last of its inner ones."""
    grid = GRIDS[model] if grid is None else grid
    data = random_folds(random_folds(df, key, outer, seed=7, name="outer_fold"), key, inner, name="inner_fold")
    data = data.select(*dict.fromkeys([*key, *features, target, "outer_fold", "inner_fold"]))
    chosen: dict[int, int] = {}
    trees: dict[int, int | None] = {}
    best: dict[int, Ensemble | Linear] = {}
    if model == "linear":
        sums = sums_of_products(data, features, target, ["outer_fold", "inner_fold"])

        def loss(k: int, i: int, j: int) -> float:
            fitted = solve(sums, sums.of(lambda g: g[0] != k and g[1] != j), **grid[i])
            return mean_squared_error(sums, sums.of(lambda g: g[0] != k and g[1] == j), fitted)

        for k in range(outer):
            chosen[k] = int(np.argmin([np.mean([loss(k, i, j) for j in range(inner)]) for i in range(len(grid))]))
            best[k], trees[k] = solve(sums, sums.of(lambda g: g[0] != k), **grid[chosen[k]]), None
        scored = fold_predictions(data, best, "outer_fold")
    else:
        cells = [(k, i, j) for k in range(outer) for i in range(len(grid)) for j in (*range(inner), None)]
        fits = []
        for k, i, j in cells:
            where = f"outer_fold <> {k}"
            held = "false" if j is None else f"{where} and inner_fold = {j}"
            more = {"follow": tuple(range(len(fits) - inner, len(fits)))} if j is None else {"patience": INNER_PATIENCE}
            fits.append(Fit(train=where if j is None else f"{where} and inner_fold <> {j}", held=held, seed=SEED, **{**TREES[model], **more, **grid[i]}))
        fitted = dict(zip(cells, fit_trees(data, features, target, key, fits)))
        for k in range(outer):
            found = [[fitted[k, i, j].errors for j in range(inner)] for i in range(len(grid))]
            chosen[k] = int(np.argmin([np.mean([min(e) for e in errors]) for errors in found]))
            whole = fitted[k, chosen[k], None]
            rounds = len(whole.trees)
            if not TREES[model].get("forest"):
                rounds = max(1, min(rounds, round(float(np.mean([best_round(e) for e in found[chosen[k]]])))))
            best[k], trees[k] = whole.first(rounds), rounds
        scored = _by_fold(data, best, features, target, "outer_fold")
    metrics = evaluate(scored.select("outer_fold", target, "prediction"), target, ["outer_fold"])
    rows = [(k, chosen[k], str(grid[chosen[k]]), trees[k]) for k in range(outer)]
    picked = df.sparkSession.createDataFrame(rows, "outer_fold int, trial int, params string, trees int")
    return metrics.join(F.broadcast(picked), "outer_fold")


def save_model(spark: SparkSession, trained: Trained | Volatility, path: str) -> None:
    """The model and a manifest of its kind and features under `path`, which must not exist yet, in
    a folder that all executors share.  The manifest comes last: without it there is no model."""
    model = trained.model
    text = None
    if isinstance(model, PipelineModel):
        model.write().save(f"{path}/pipeline")
    elif isinstance(model, Ensemble):
        text = model.described()
    else:
        text = json.dumps({"coefficients": list(map(float, model.coefficients)), "intercept": float(model.intercept)})
    row = (type(model).__name__, list(trained.features), getattr(trained, "trees", 0), text)
    spark.createDataFrame([row], "kind string, features array<string>, trees int, model string").coalesce(1).write.parquet(f"{path}/manifest")


def load_model(spark: SparkSession, path: str, frame: DataFrame | None = None) -> Trained:
    """What `save_model` wrote; with a `frame`, its columns are checked against the manifest."""
    row = spark.read.schema("kind string, features array<string>, trees int, model string").parquet(f"{path}/manifest").first()
    if row["kind"] == "PipelineModel":
        model: Ensemble | Linear | PipelineModel = PipelineModel.load(f"{path}/pipeline")
    elif row["kind"] == "Ensemble":
        model = Ensemble.read(row["model"])
    else:
        found = json.loads(row["model"])
        model = Linear(list(row["features"]), np.array(found["coefficients"]), found["intercept"])
    if frame is not None:
        _require(frame, row["features"])
        types = dict(frame.dtypes)
        if wrong := [c for c in row["features"] if types[c].split("(")[0] not in NUMERIC]:
            raise ValueError(f"feature columns that are not numbers: {wrong}")
    return Trained(model, list(row["features"]), row["trees"])


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def importances(trained: Trained, spark) -> DataFrame:
    """Feature names with their importance, largest first; one row per feature."""
    model = trained.model
    values = model.importances() if isinstance(model, Ensemble) else model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(trained.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def feature_map(df: DataFrame, features: Sequence[str], target: str, ts: str = "ts") -> DataFrame:
    """Three coordinates in [0, 1] per non-constant feature, near for correlated ones.

    The correlation matrix is one distributed aggregate; only that matrix, features by
    features, is decomposed on the driver.
    """
    profile = feature_profile(df, features, target, ts)
    names = [r["feature"] for r in profile.select("feature").collect()]
    if len(names) < 3:
        raise ValueError("a feature map needs at least three varying features")
    rows = df.select(*[F.col(c).try_cast("double").alias(c) for c in [*features, target]]).dropna("any")
    corr = Correlation.corr(assembler(names).transform(rows), "features").first()[0].toArray()
    vals, vecs = np.linalg.eigh(corr)
    top = np.argsort(vals)[::-1][:3]
    xyz = vecs[:, top] * np.sqrt(np.clip(vals[top], 0.0, None))
    # The sign of an axis is arbitrary; make its largest entry positive.
    xyz = xyz * np.sign(xyz[np.abs(xyz).argmax(axis=0), range(3)])
    low, span = xyz.min(axis=0), np.ptp(xyz, axis=0)
    unit = (xyz - low) / np.where(span > 0, span, 1.0)
    coords = df.sparkSession.createDataFrame(
        [(n, *map(float, p)) for n, p in zip(names, unit)], "feature string, x double, y double, z double"
    )
    return profile.join(coords, "feature")
