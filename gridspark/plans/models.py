"""Model queries.  Splits, folds and preparation have SQL counterparts; fitted models do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import features as fe
from ..ml import models as mo
from ..operators import feeds, metrics
from ..session import materialize, scratch_path
from .inputs import SHIP, ship, with_sql
from .registry import query
from .sources import HOLIDAYS

HASH = "CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"
LINE = "(l_orderkey || '|' || l_linenumber)"


def hourly_frame(t):
    """Seven years of hours: price, wind, nuclear from the three return flags."""
    w = ship(t).groupBy("ts").pivot("series_id", ["A", "N", "R"]).agg(F.first("value"))
    return w.withColumnsRenamed({"A": "price", "N": "wind", "R": "nuclear"})


FRAME = """frame AS (SELECT ts, max(value) FILTER (WHERE series_id = 'A') AS price, max(value) FILTER (WHERE series_id = 'N') AS wind,
    max(value) FILTER (WHERE series_id = 'R') AS nuclear FROM ship GROUP BY 1)"""


def price_rows(t):
    """Rows of the price model: calendar, two drivers, and two stations' temperatures with
    their mean and variance."""
    stations = {"t_1": F.coalesce("wind", F.lit(0.0)) / 10, "t_2": F.coalesce("nuclear", F.lit(0.0)) / 10}
    rows, features = fe.price_features(hourly_frame(t).withColumns(stations), "price", ["wind", "nuclear"], list(stations), carry=True)
    # Written once: fitting reads the rows again for every tree level.
    return materialize(rows.select("ts", "price", *features), "features"), features


# What SQL can say of a fitted model: the rows it is held to, the errors of a constant on
# them, and that the model's are not much larger.  The synthetic prices hardly depend on
# anything; tests/test_ml.py fits prices that do.
TRAINING = """q AS (SELECT quantile_cont(price, 0.0008) AS lo, quantile_cont(price, 0.9995) AS hi FROM frame),
    carried AS (SELECT ts, price, last_value(wind IGNORE NULLS) OVER (ORDER BY ts) AS wind, last_value(nuclear IGNORE NULLS) OVER (ORDER BY ts) AS nuclear,
        coalesce(wind, 0) / 10 AS t_1, coalesce(nuclear, 0) / 10 AS t_2 FROM frame),
    training AS (SELECT ts, least(greatest(price, lo), hi) AS price, wind, nuclear, t_1, t_2 FROM carried, q
        WHERE price IS NOT NULL AND wind IS NOT NULL AND nuclear IS NOT NULL)"""


def baseline_sql(rows: str, target: str, test: str) -> str:
    return f""", s AS (SELECT {target} AS y, {test} AS is_test FROM {rows}), m AS (SELECT avg(y) AS mean FROM s WHERE NOT is_test)
        SELECT count(*) AS n, round(avg(abs(y - mean)), 6) AS baseline_mae, round(avg((y - mean) * (y - mean)), 6) AS baseline_mse, TRUE AS sound
        FROM s, m WHERE is_test"""


def against_mean(trained, split, target: str):
    """Held-out rows, the errors of the training mean on them, and whether the model's stay near or below."""
    mean = split.where("NOT is_test").agg(F.avg(target)).scalar()
    error = F.col(target) - mean
    held = split.where("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("baseline_mae"), F.avg(error * error).alias("baseline_mse")
    )
    own = trained.evaluation.select(F.struct("n", "mse")).scalar()
    return held.withColumn("sound", (own["mse"] < 1.25 * F.col("baseline_mse")) & (own["n"] == F.col("n")))


@query("m1_price_regressor", with_sql(baseline_sql("training", "price", HASH.format(seed=42, key="ts") + " < 0.1"), SHIP, FRAME, TRAINING))
def m1(t):
    """The boosted price model beside a constant."""
    rows, features = price_rows(t)
    trained = mo.train_price_model(rows, features, "price", ["ts"])
    return against_mean(trained, fe.random_split(rows, ["ts"], 0.1), "price")


PRICE_FEATURES = fe.feature_list(fe.CALENDAR, ["wind", "nuclear"], ["t_1", "t_2"], ["temp_mean", "temp_variance"])
CYCLIC = """{name} AS (SELECT *, CAST(year(ts) AS BIGINT) AS year, sin(2 * pi() * isodow(ts) / 7) AS day_of_week_sin, cos(2 * pi() * isodow(ts) / 7) AS day_of_week_cos,
    sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos{more} FROM {rows})"""
ENCODED = CYCLIC.format(name="encoded", rows="training", more=", (t_1 + t_2) / 2 AS temp_mean, pow(t_1 - t_2, 2) / 2 AS temp_variance")


def ridge_sql(rows: str, fits: str, train: str, name: str = "") -> list[str]:
    """Expressions that end in `solved{name}`(g, mu, sd, w): for each row (g, l2) of `fits` the
    weights of the standardised features of those `rows` (columns v, the features and then the
    target) that `train` takes, by elimination in a recursive query."""
    d = len(PRICE_FEATURES)
    means = ", ".join(f"avg(v[{i}])" for i in range(1, d + 2))
    pairs = ", ".join("[" + ", ".join(f"covar_pop(v[{i}], v[{j}])" for j in range(1, d + 2)) + "]" for i in range(1, d + 2))
    inner = f"[CASE WHEN i = step THEN m[step][j] / m[step][step] ELSE m[i][j] - m[i][step] * m[step][j] / m[step][step] END for j in range(1, {d + 2})]"
    return [
        f"moments{name} AS (SELECT g, l2, [{means}] AS mu, [{pairs}] AS c FROM {rows} x JOIN {fits} f ON {train} GROUP BY g, l2)",
        f"spread{name} AS (SELECT *, [sqrt(c[i][i]) for i in range(1, {d + 2})] AS sd FROM moments{name})",
        f"""gauss{name}(g, step, m) AS (
            SELECT g, 1, [list_append([c[i][j] / (sd[i] * sd[j]) + CASE WHEN i = j THEN l2 ELSE 0 END for j in range(1, {d + 1})], c[i][{d + 1}] / (sd[i] * sd[{d + 1}])) for i in range(1, {d + 1})] FROM spread{name}
            UNION ALL SELECT g, step + 1, [{inner} for i in range(1, {d + 1})] FROM gauss{name} WHERE step <= {d})""",
        f"solved{name} AS (SELECT g, mu, sd, [m[i][{d + 1}] for i in range(1, {d + 1})] AS w FROM gauss{name} JOIN spread{name} USING (g) WHERE step = {d + 1})",
    ]


PREDICTED = f"mu[{len(PRICE_FEATURES) + 1}] + sd[{len(PRICE_FEATURES) + 1}] * list_sum([w[i] * (v[i] - mu[i]) / sd[i] for i in range(1, {len(PRICE_FEATURES) + 1})])"
VECTORS = "vectors AS (SELECT ts, price AS y, [" + ", ".join(f"CAST({f} AS DOUBLE)" for f in [*PRICE_FEATURES, "price"]) + "] AS v, {more} FROM encoded{tables})"
ERRORS = """count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2"""


def recursive(body: str, *ctes: str) -> str:
    return with_sql(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


BOOST_FEATURES, BOOST_CUTS = ["wind", "nuclear", "day_of_week_sin"], 16
BOOST = {"rounds": 3, "depth": 2, "eta": 0.3, "l1": 2.0, "l2": 3.0, "gamma": 0.0}


def boost_sql() -> list[str]:
    """Expressions for three rounds of second-order boosting, every aggregate written out."""
    shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - {BOOST['l1']}, 0))"
    weight = lambda g, h: f"(-{BOOST['eta']} * {shrunk(g)} / ({h} + {BOOST['l2']}))"
    score = lambda g, h: f"({shrunk(g)} * {shrunk(g)} / ({h} + {BOOST['l2']}))"
    ends = ", ".join(f"min({f}) AS lo_{k}, max({f}) AS hi_{k}" for k, f in enumerate(BOOST_FEATURES))
    cuts = ", ".join(f"[lo_{k} + (hi_{k} - lo_{k}) * s / {BOOST_CUTS} for s in range(1, {BOOST_CUTS})] AS cuts_{k}" for k in range(len(BOOST_FEATURES)))
    bins = ", ".join(f"len([c for c in cuts_{k} if c < {f}])" for k, f in enumerate(BOOST_FEATURES))
    out = [
        f"ends AS (SELECT {ends} FROM encoded)",
        f"cuts AS (SELECT {cuts} FROM ends)",
        f"held AS (SELECT ts, price AS y, [{bins}] AS bins, {HASH.format(seed=42, key='ts')} < 0.1 AS is_test FROM encoded, cuts)",
        "state_0 AS (SELECT *, (SELECT avg(y) FROM held WHERE NOT is_test) AS p FROM held)",
    ]
    for r in range(1, BOOST["rounds"] + 1):
        out.append(f"r{r}_rows_0 AS (SELECT *, 0 AS node, CAST(0 AS DOUBLE) AS value FROM state_{r - 1})")
        for level in range(BOOST["depth"]):
            at = f"r{r}_rows_{level}"
            out += [
                f"r{r}_sums_{level} AS (SELECT node, f, b, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h FROM (SELECT node, p - y AS g, unnest(range({len(BOOST_FEATURES)})) AS f, unnest(bins) AS b FROM {at} WHERE NOT is_test) GROUP BY ALL)",
                f"r{r}_left_{level} AS (SELECT node, f, b, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER (PARTITION BY node, f) AS gt, sum(h) OVER (PARTITION BY node, f) AS ht FROM r{r}_sums_{level} WINDOW o AS (PARTITION BY node, f ORDER BY b))",
                f"r{r}_gain_{level} AS (SELECT *, ({score('gl', 'hl')} + {score('(gt - gl)', '(ht - hl)')} - {score('gt', 'ht')}) / 2 AS gain FROM r{r}_left_{level} WHERE ht - hl >= 1)",
                f"r{r}_best_{level} AS (SELECT node, f, b, gain, {weight('gl', 'hl')} AS lw, {weight('(gt - gl)', '(ht - hl)')} AS rw FROM r{r}_gain_{level} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round_even(gain, 7) DESC, f, b) = 1)",
                f"""r{r}_rows_{level + 1} AS (SELECT x.* EXCLUDE (node, value), CASE WHEN b.f IS NULL THEN -1 WHEN x.bins[b.f + 1] > b.b THEN 2 * x.node + 2 ELSE 2 * x.node + 1 END AS node,
                    CASE WHEN b.f IS NULL THEN x.value WHEN x.bins[b.f + 1] > b.b THEN b.rw ELSE b.lw END AS value FROM {at} x LEFT JOIN r{r}_best_{level} b ON x.node = b.node)""",
            ]
        out.append(f"state_{r} AS (SELECT ts, y, bins, is_test, p + value AS p FROM r{r}_rows_{BOOST['depth']})")
    return out


def boosted_nodes_sql() -> str:
    names = "[" + ", ".join(f"'{f}'" for f in BOOST_FEATURES) + "]"
    cuts = "CASE f " + " ".join(f"WHEN {k} THEN cuts_{k}[b + 1]" for k in range(len(BOOST_FEATURES))) + " END"
    parts = [
        f"""SELECT {r} AS round, node, {names}[f + 1] AS feature, round({cuts}, 4) AS threshold, round(gain, 4) AS gain,
            (SELECT round(avg((y - p) * (y - p)), 4) FROM state_{r} WHERE is_test) AS held_mse FROM r{r}_best_{level}, cuts"""
        for r in range(1, BOOST["rounds"] + 1)
        for level in range(BOOST["depth"])
    ]
    return " UNION ALL ".join(parts)


@query("m1_boosted_rounds", with_sql(boosted_nodes_sql(), SHIP, FRAME, TRAINING, ENCODED, *boost_sql()), digits=4)
def m1_rounds(t):
    """Every split of three rounds, and the held-out error after each round."""
    rows, _ = price_rows(t)
    ends = rows.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in BOOST_FEATURES]).first()
    splits = [[ends[c]["lo"] + (ends[c]["hi"] - ends[c]["lo"]) * k / BOOST_CUTS for k in range(1, BOOST_CUTS)] for c in BOOST_FEATURES]
    split = fe.random_split(rows, ["ts"], 0.1)
    fit = mo.Fit(train="not is_test", held="is_test", **BOOST)
    model = mo.fit_trees(split, BOOST_FEATURES, "price", ["ts"], [fit], splits)[0]
    errors = t.spark.createDataFrame([(k, e) for k, e in enumerate(model.errors)], "round int, held_mse double")
    nodes = model.nodes(t.spark).where("feature is not null").withColumn("round", F.col("tree") + 1)
    return nodes.join(F.broadcast(errors), "round").select("round", "node", "feature", "threshold", "gain", "held_mse")


SHARES = """shares AS (SELECT ts, wind / cap AS share FROM (
        SELECT ts, wind, nuclear, last_value(price IGNORE NULLS) OVER (ORDER BY ts) AS cap FROM frame) WHERE wind IS NOT NULL AND nuclear IS NOT NULL AND cap IS NOT NULL)"""
LATE = "epoch_us(ts) > (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.9) FROM {rows})"


def wind_rows(t):
    rows, features = fe.wind_features(hourly_frame(t), "wind", "price", ["nuclear", "price"])
    return materialize(rows.select("ts", "share", *features), "features"), features


@query("m2_wind_share_regressor", with_sql(baseline_sql("shares", "share", LATE.format(rows="shares")), SHIP, FRAME, SHARES))
def m2(t):
    """The share model on the newest tenth."""
    rows, features = wind_rows(t)
    return against_mean(mo.train_wind_model(rows, features), fe.chronological_split(rows, 0.1), "share")


def volatility_input(t):
    frame = hourly_frame(t).withColumn("holiday", F.when(F.col("nuclear") > 90, 1).otherwise(0))
    table, features = fe.volatility_table(frame, "price", ["nuclear"], "wind", flag="holiday")
    return materialize(table, "daily"), features


HELD_DAYS = f""", d AS (SELECT CAST(ts AS DATE) AS date, var_samp(price) AS v FROM frame GROUP BY 1),
    y AS (SELECT date, coalesce(v >= (SELECT quantile_cont(v, 0.8) FROM d), false) AS y FROM d),
    h AS (SELECT *, {HASH.format(seed=42, key='date')} AS h FROM y), c AS (SELECT y, quantile_cont(h, 0.8) AS cut FROM h GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (y) AS positives, TRUE AS ranked FROM h JOIN c USING (y) WHERE h > cut"""


def held_days(evaluation):
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return evaluation.select(n.alias("n"), (F.col("tp") + F.col("fn")).alias("positives"), F.col("auc").between(0, 1).alias("ranked"))


@query("m3_volatility_trees", with_sql(HELD_DAYS, SHIP, FRAME))
def m3(t):
    daily, features = volatility_input(t)
    return held_days(mo.train_volatility(daily, features).evaluation)


@query("m4_volatility_logistic", with_sql(HELD_DAYS, SHIP, FRAME))
def m4(t):
    daily, features = volatility_input(t)
    return held_days(mo.train_volatility(daily, features, kind="logistic").evaluation)


@query("c14_volatility_on_hours", with_sql("SELECT ts, round(price, 6) AS price, TRUE AS likely FROM frame", SHIP, FRAME))
def c14(t):
    """Likelihood of the date mapped onto its hours."""
    daily, features = volatility_input(t)
    trained = mo.train_volatility(daily, features, kind="logistic")
    likelihood = mo.predict_volatility(trained, daily)
    out = feeds.volatility_to_hours(hourly_frame(t).select("ts", "price"), likelihood, "likelihood")
    return out.select("ts", "price", F.coalesce(F.col("likelihood").between(0, 1), F.lit(False)).alias("likely"))


@query(
    "m5_model_gap_imputation",
    with_sql("SELECT ts, round(wind, 6) AS known, wind IS NULL AS imputed, TRUE AS filled FROM gaps WHERE nuclear IS NOT NULL AND cap IS NOT NULL", SHIP, FRAME,
             "gaps AS (SELECT *, last_value(price IGNORE NULLS) OVER (ORDER BY ts) AS cap FROM frame)"),
)
def m5(t):
    """Missing wind hours predicted as a share of the capacity and scaled back by it."""
    rows, features = wind_rows(t)
    trained = mo.train_wind_model(rows, features)
    frame = fe.cyclic_time(fe.forward_fill(hourly_frame(t).withColumn("_one", F.lit(0)), "price", "_one", "ts"))
    frame = frame.withColumns({"speed_mean": (F.col("nuclear") + F.col("price")) / 2, "speed_variance": F.pow(F.col("nuclear") - F.col("price"), 2) / 2})
    frame = frame.dropna("any", subset=["nuclear", "price"]).select("ts", "wind", *features)
    known = frame.select("ts", F.col("wind").alias("known"))
    out = mo.impute_with_model(frame, trained, "wind", capacity="price").join(known, "ts")
    kept = F.coalesce(F.col("wind") == F.col("known"), F.col("wind").isNotNull() & ~F.isnan("wind"))
    return out.select("ts", "known", F.col("known").isNull().alias("imputed"), kept.alias("filled"))


@query("m6_random_split", f"SELECT l_orderkey, l_linenumber, {HASH.format(seed=42, key=LINE)} < 0.1 AS is_test FROM lineitem")
def m6(t):
    return fe.random_split(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.1)


@query("m7_chronological_split", with_sql("SELECT series_id, ts, epoch_us(ts) > (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.9) FROM ship) AS is_test FROM ship", SHIP))
def m7(t):
    return fe.chronological_split(ship(t).select("series_id", "ts"), 0.1)


@query("m8_early_stopping", with_sql(f"SELECT count(*) AS n, TRUE AS chosen FROM training WHERE {HASH.format(seed=42, key='ts')} < 0.1", SHIP, FRAME, TRAINING))
def m8(t):
    """The number of trees is the best of all rounds, and the refitted model has as many."""
    rows, features = price_rows(t)
    trained = mo.train_price_model(rows, features, "price", ["ts"])
    least = min(range(len(trained.errors)), key=trained.errors.__getitem__)
    chosen = trained.trees == len(trained.model.trees) == max(1, least)
    # The rounds end after those of patience, unless all were used.
    chosen = chosen and (len(trained.errors) - 1 == mo.ROUNDS or len(trained.errors) - 1 - least >= mo.PATIENCE)
    return trained.evaluation.select("n", F.lit(chosen).alias("chosen"))


@query("m9_folds", f"SELECT l_orderkey, l_linenumber, CAST(floor({HASH.format(seed=42, key=LINE)} * 5) AS BIGINT) AS fold FROM lineitem")
def m9_folds(t):
    return fe.random_folds(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def folds_sql(fold: str, train: str, tested: str, tables: str = "") -> str:
    fits = f"fits AS (SELECT unnest({tested}) AS g, 0.001 AS l2)"
    body = f", scored AS (SELECT x.fold, y, {PREDICTED} AS p FROM vectors x JOIN solved s ON x.fold = s.g) SELECT fold, {ERRORS} FROM scored GROUP BY 1"
    vectors = VECTORS.format(more=f"{fold} AS fold", tables=tables)
    return recursive(body, SHIP, FRAME, TRAINING, ENCODED, *CUT_TIMES, vectors, fits, *ridge_sql("vectors", "fits", train))


CUT_TIMES = ["times AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), [0.25, 0.5, 0.75]) AS ends FROM training)"]
FIVE_FOLDS = f"CAST(floor({HASH.format(seed=42, key='ts')} * 5) AS BIGINT)"
TIME_FOLD = " + ".join(f"CAST(epoch_us(ts) > ends[{k}] AS BIGINT)" for k in (1, 2, 3))


@query("m9_cross_validation", folds_sql(FIVE_FOLDS, "x.fold <> f.g", "range(5)"))
def m9(t):
    """Errors of the linear model on five shuffled folds."""
    rows, features = price_rows(t)
    return mo.cross_validate(rows, features, "price", ["ts"]).select("fold", "n", "mae", "mse", "r2")


@query("m9_tree_cross_validation", with_sql(f"SELECT {FIVE_FOLDS} AS fold, count(*) AS n, TRUE AS sound FROM training GROUP BY 1", SHIP, FRAME, TRAINING))
def m9_trees(t):
    """Five shuffled folds of second-order boosting, grown together."""
    rows, features = price_rows(t)
    folds = mo.cross_validate(rows, features, "price", ["ts"], model="second_order")
    return folds.select("fold", "n", (F.col("r2") > -0.25).alias("sound"))


@query(
    "m10_time_folds",
    with_sql(
        ", q AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), [0.25, 0.5, 0.75]) AS c FROM ship) SELECT series_id, ts, CAST(epoch_us(ts) > c[1] AS BIGINT) + CAST(epoch_us(ts) > c[2] AS BIGINT) + CAST(epoch_us(ts) > c[3] AS BIGINT) AS fold FROM ship, q",
        SHIP,
    ),
)
def m10_folds(t):
    return fe.time_folds(ship(t).select("series_id", "ts"), 3)


@query("m10_time_series_cv", folds_sql(TIME_FOLD, "x.fold < f.g", "range(1, 4)", ", times"))
def m10(t):
    """Errors of the linear model on stretches after its training rows."""
    rows, features = price_rows(t)
    return mo.cross_validate(rows, features, "price", ["ts"], folds=3, expanding=True).select("fold", "n", "mae", "mse", "r2")


def trials_sql(model: str) -> str:
    rows = ", ".join(f"({i}, '{str(g).replace(chr(39), chr(39) * 2)}')" for i, g in enumerate(mo.GRIDS[model]))
    return f"SELECT trial, params, TRUE AS sound FROM (VALUES {rows}) v(trial, params)"


LINEAR_GRID = [0.001, 0.1, 10.0]


def linear_search_sql() -> str:
    trials = ", ".join(f"({i}, {v})" for i, v in enumerate(LINEAR_GRID))
    fits = f"fits AS (SELECT 3 * trial + k AS g, trial, k, l2 FROM (VALUES {trials}) t(trial, l2), range(3) r(k))"
    fold = f"CAST(floor({HASH.format(seed=42, key='ts')} * 3) AS BIGINT)"
    body = f""", scored AS (SELECT f.trial, x.fold, y, {PREDICTED} AS p FROM vectors x JOIN fits f ON x.fold = f.k JOIN solved s USING (g)),
        each AS (SELECT trial, fold, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse FROM scored GROUP BY 1, 2)
        SELECT trial, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(sqrt(avg(mse)), 6) AS rmse FROM each GROUP BY 1"""
    vectors = VECTORS.format(more=f"{fold} AS fold", tables="")
    return recursive(body, SHIP, FRAME, TRAINING, ENCODED, vectors, fits, *ridge_sql("vectors", "fits", "x.fold <> f.k"))


@query("m11_linear_search", linear_search_sql())
def m11_linear(t):
    """Mean fold errors of the linear model for three penalties."""
    rows, features = price_rows(t)
    found = mo.grid_search(rows, features, "price", ["ts"], [{"l2": v} for v in LINEAR_GRID], model="linear")
    return found.select("trial", "mae", "mse", "rmse")


@query("m11_grid_search", trials_sql("second_order"))
def m11(t):
    """Three folds for every parameter set of the second-order boosted trees."""
    rows, features = price_rows(t)
    found = mo.grid_search(rows, features, "price", ["ts"])
    return found.select("trial", "params", (F.col("r2") > -0.25).alias("sound"))


@query(
    "m11_nested_search",
    with_sql(f"SELECT CAST(floor({HASH.format(seed=7, key='ts')} * 5) AS BIGINT) AS outer_fold, count(*) AS n, TRUE AS sound FROM training GROUP BY 1", SHIP, FRAME, TRAINING),
)
def m11_nested(t):
    """Five outer by three inner folds over the parameter sets of second-order boosting."""
    rows, features = price_rows(t)
    found = mo.nested_search(rows, features, "price", ["ts"])
    sound = (F.col("r2") > -0.25) & F.col("trial").between(0, len(mo.GRIDS["second_order"]) - 1) & F.col("trees").between(1, 40)
    return found.select("outer_fold", "n", sound.alias("sound"))


def nested_linear_sql() -> str:
    outer, inner = (f"CAST(floor({HASH.format(seed=s, key='ts')} * {n}) AS BIGINT)" for s, n in ((7, 5), (42, 3)))
    trials = ", ".join(f"({i}, {v})" for i, v in enumerate(LINEAR_GRID))
    fits = f"fits AS (SELECT 9 * k + 3 * trial + j AS g, k, trial, j, l2 FROM (VALUES {trials}) t(trial, l2), range(5) a(k), range(3) b(j))"
    error = f"""errors AS (SELECT f.k, f.trial, f.j, avg((y - ({PREDICTED})) * (y - ({PREDICTED}))) AS mse
        FROM vectors x JOIN fits f ON x.fold <> f.k AND x.inner_fold = f.j JOIN solved s USING (g) GROUP BY 1, 2, 3)"""
    picked = f"""picked AS (SELECT k AS g, m.trial, t.l2 FROM (SELECT k, trial, avg(mse) AS mse FROM errors GROUP BY 1, 2) m JOIN (VALUES {trials}) t(trial, l2) ON t.trial = m.trial
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY mse, m.trial) = 1)"""
    body = f""", scored AS (SELECT x.fold, c.trial, y, {PREDICTED} AS p FROM vectors x JOIN solved_outer s ON x.fold = s.g JOIN picked c ON c.g = s.g)
        SELECT fold AS outer_fold, trial, {ERRORS} FROM scored GROUP BY 1, 2"""
    vectors = VECTORS.format(more=f"{outer} AS fold, {inner} AS inner_fold", tables="")
    first = ridge_sql("vectors", "fits", "x.fold <> f.k AND x.inner_fold <> f.j")
    return recursive(body, SHIP, FRAME, TRAINING, ENCODED, vectors, fits, *first, error, picked, *ridge_sql("vectors", "picked", "x.fold <> f.g", "_outer"))


@query("m11_nested_linear", nested_linear_sql())
def m11_nested_linear(t):
    """The penalty chosen in each outer training part, and its errors on the outer fold."""
    rows, features = price_rows(t)
    found = mo.nested_search(rows, features, "price", ["ts"], [{"l2": v} for v in LINEAR_GRID], model="linear")
    return found.select("outer_fold", "trial", "n", "mae", "mse", "r2")


@query(
    "m12_stratified_split",
    f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_returnflag, {HASH.format(seed=42, key=LINE)} AS h FROM lineitem),
             c AS (SELECT l_returnflag, quantile_cont(h, 0.8) AS cut FROM h GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_returnflag, h > cut AS is_test FROM h JOIN c USING (l_returnflag)""",
)
def m12(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return fe.stratified_split(rows, "l_returnflag", ["l_orderkey", "l_linenumber"], 0.2)


@query(
    "m13_standardize",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem",
)
def m13(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return fe.standardize(rows, ["l_quantity", "l_extendedprice"])


@query(
    "a28_median_impute",
    with_sql(
        "SELECT ts, " + ", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM frame)), 6) AS {c}" for c in ("price", "wind", "nuclear")) + " FROM frame",
        SHIP, FRAME,
    ),
)
def a28(t):
    return fe.impute_median(hourly_frame(t), ["price", "wind", "nuclear"])


@query(
    "a28_feature_screen",
    with_sql(
        " UNION ALL ".join(f"SELECT '{c}' AS feature, round(count(*) FILTER (WHERE {x} IS NULL) / count(*), 6) AS null_rate, count(*) FILTER (WHERE {x} IS NULL) / count(*) < 0.3 AS kept FROM frame"
                           for c, x in (("price", "price"), ("wind", "wind"), ("rare", "CASE WHEN nuclear > 90 THEN nuclear END"))),
        SHIP, FRAME,
    ),
)
def a28_screen(t):
    """A column that is mostly null is screened out."""
    w = hourly_frame(t).withColumn("rare", F.when(F.col("nuclear") > 90, F.col("nuclear")))
    return fe.null_rates(w, ["price", "wind", "rare"], 0.3)


def held_linear_sql(test: str, body: str) -> str:
    """`scored`(ts, y, p): the rows of `test` under the linear model of the others."""
    fits = "fits AS (SELECT 0 AS g, 0.001 AS l2)"
    scored = f"scored AS (SELECT ts, y, {PREDICTED} AS p FROM vectors x, solved s WHERE x.is_test)"
    vectors = VECTORS.format(more=f"{test} AS is_test", tables="")
    return recursive(body, SHIP, FRAME, TRAINING, ENCODED, vectors, fits, *ridge_sql("vectors", "fits", "NOT x.is_test"), scored)


@query(
    "m14_model_comparison",
    held_linear_sql(
        HASH.format(seed=42, key="ts") + " < 0.2",
        f"""SELECT model, n, CASE WHEN model = 'linear' THEN mae END AS mae, CASE WHEN model = 'linear' THEN mse END AS mse, TRUE AS sound
            FROM (SELECT {ERRORS} FROM scored), (VALUES {", ".join(f"('{m}')" for m in mo.COMPARED)}) v(model)""",
    ),
)
def m14(t):
    """Five learners on one split; the errors of the linear one are held to SQL."""
    rows, features = price_rows(t)
    found = mo.compare_models(rows, features, "price", ["ts"])
    only = lambda c: F.when(F.col("model") == "linear", F.col(c)).alias(c)
    return found.select("model", "n", only("mae"), only("mse"), (F.col("r2") > -0.25).alias("sound"))


@query("m15_feature_importance", "SELECT feature, TRUE AS a_share, 1.0::DOUBLE AS total FROM (VALUES " + ", ".join(f"('{f}')" for f in PRICE_FEATURES) + ") v(feature)")
def m15(t):
    """Shares of all features, which add up to one."""
    rows, features = price_rows(t)
    found = mo.importances(mo.train_price_model(rows, features, "price", ["ts"]), t.spark)
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("a_share"), total.alias("total"))


@query(
    "m16_single_model_evaluation",
    held_linear_sql(
        LATE.format(rows="training").replace("0.9", "0.8"),
        f""", e AS (SELECT ts, y - p AS e, lag(y - p) OVER (ORDER BY ts) AS before FROM scored),
            d AS (SELECT round(sum((e - before) * (e - before)) / sum(e * e), 6) AS durbin_watson FROM e)
            SELECT 'linear' AS model, n, mae, mse, r2, durbin_watson FROM (SELECT {ERRORS} FROM scored), d""",
    ),
)
def m16(t):
    """Held-out metrics of the linear model with the residuals' autocorrelation."""
    from ..operators.windows import autocorrelation

    rows, features = price_rows(t)
    split = fe.chronological_split(rows, 0.2)
    model = mo.fit_linear(split.where("NOT is_test"), features, "price")
    held = mo.predict(model, split.where("is_test"), features).withColumn("model", F.lit("linear"))
    resid = autocorrelation(held.withColumn("e", F.col("price") - F.col("prediction")), "e", "model")
    found = mo.evaluate(held, "price", ["model"]).join(resid.select("model", "durbin_watson"), "model")
    return found.select("model", "n", "mae", "mse", "r2", "durbin_watson")


@query(
    "m17_sampled_metrics",
    f"""WITH h AS (SELECT r.range AS replicate, l_quantity AS a, l_extendedprice / 2000 AS p, CAST(('0x' || substr(md5(r.range || '|' || l_orderkey || '|' || l_linenumber), 1, 8)) AS BIGINT) / 4294967296.0 AS h
                  FROM lineitem CROSS JOIN range(10) r),
             s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY h, a, p) AS k FROM h) WHERE k <= 500)
        SELECT CAST(replicate AS BIGINT) AS replicate, count(*) AS n, round(avg(abs(a - p)), 6) AS mae, round(avg((a - p) * (a - p)), 6) AS mse,
               round(2 * avg(abs(a - p) / (abs(a) + abs(p))) * 100, 6) AS smape, round(corr(a, p), 6) AS pearson,
               round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(1 - avg((a - p) * (a - p)) / var_pop(a), 6) AS r2 FROM s GROUP BY 1""",
)
def m17(t):
    """Ten seeded samples of five hundred rows."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 2000).alias("p"))
    return metrics.sampled_metrics(rows, "a", "p", ["l_orderkey", "l_linenumber"])


@query("m18_price_prediction", with_sql("SELECT ts, round(price, 6) AS price, TRUE AS near FROM training WHERE ts >= (SELECT max(ts) FROM training) - INTERVAL 28 DAY", SHIP, FRAME, TRAINING))
def m18(t):
    """The newest four weeks predicted with a model of all hours, stored and read back."""
    from ..operators.rollup import last_days

    rows, features = price_rows(t)
    path = scratch_path(t.spark, "price-model")
    mo.save_model(t.spark, mo.train_price_model(rows, features, "price", ["ts"]), path)
    trained = mo.load_model(t.spark, path, rows)
    low, high = (rows.agg(f("price")).scalar() for f in (F.min, F.max))
    near = F.col("prediction").between(low - (high - low), high + (high - low))
    return mo.predict(trained.model, last_days(rows, 28), features).select("ts", "price", near.alias("near"))


def mapped_sql(rows: str, features: list[str], target: str = "price") -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, {target} AS y FROM {rows}" for f in features)
    return f""", long AS ({parts}), p AS (SELECT feature, count(*) AS rows, avg(v) AS mean, stddev_pop(v) AS std, corr(v, y) AS correlation FROM long GROUP BY 1)
        SELECT feature, rows, round(mean, 5) AS mean, round(std, 5) AS std, round(coalesce(correlation, 0), 5) AS correlation, TRUE AS mapped FROM p WHERE std > 0"""


def mapped(found):
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1) & F.col("z").between(0, 1)
    return found.select("feature", "rows", "mean", "std", "correlation", inside.alias("mapped"))


@query(
    "m20_feature_map",
    with_sql(mapped_sql("e", PRICE_FEATURES), SHIP, FRAME, TRAINING,
             CYCLIC.format(name="e", rows="training", more=", (t_1 + t_2) / 2 AS temp_mean, pow(t_1 - t_2, 2) / 2 AS temp_variance")),
    digits=5,
)
def m20(t):
    """Profile of every feature; its place on the map lies in the unit cube."""
    rows, features = price_rows(t)
    return mapped(mo.feature_map(rows, features, "price"))


@query(
    "m19_feature_list",
    with_sql(
        " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS place, '{f}' AS feature, count(*) AS n FROM training" for i, f in enumerate(PRICE_FEATURES)),
        SHIP, FRAME, TRAINING,
    ),
)
def m19(t):
    """Features in their order, each once, with the rows that have them."""
    rows, features = price_rows(t)
    counts = rows.agg(*[F.count(f).alias(f) for f in features]).unpivot([], features, "feature", "n")
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    return counts.select(place.alias("place"), "feature", "n")


@query(
    "m21_training_rows",
    with_sql(
        """, f AS (SELECT ts, price, last_value(wind IGNORE NULLS) OVER (ORDER BY ts) AS wind, last_value(nuclear IGNORE NULLS) OVER (ORDER BY ts) AS nuclear FROM frame),
             q AS (SELECT quantile_cont(price, 0.0008) AS lo, quantile_cont(price, 0.9995) AS hi FROM frame)
           SELECT ts, round(least(greatest(price, lo), hi), 6) AS price, round(wind, 6) AS wind, round(nuclear, 6) AS nuclear, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin
           FROM f, q WHERE price IS NOT NULL AND wind IS NOT NULL AND nuclear IS NOT NULL""",
        SHIP, FRAME,
    ),
)
def m21(t):
    rows, _ = fe.price_features(hourly_frame(t), "price", ["wind", "nuclear"], carry=True)
    return rows.select("ts", "price", "wind", "nuclear", "hour_sin")


EMBEDDED = ["year", "day_of_week_sin", "day_of_week_cos", "hour_sin", "hour_cos", "wind", "nuclear", "holiday"]
HELD_HOLIDAYS = f"""hours AS (SELECT ts, max(kind_id) AS kind FROM (SELECT kind_id, unnest(generate_series(
        timezone('UTC', timezone('Europe/Helsinki', CAST(date AS TIMESTAMP))),
        timezone('UTC', timezone('Europe/Helsinki', CAST(date AS TIMESTAMP) + INTERVAL 1 DAY)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM days) GROUP BY 1),
    held AS (SELECT f.ts, price, last_value(wind IGNORE NULLS) OVER (ORDER BY f.ts) AS wind, last_value(nuclear IGNORE NULLS) OVER (ORDER BY f.ts) AS nuclear,
        last_value(coalesce(kind, 0)) OVER (ORDER BY f.ts) AS holiday FROM frame f LEFT JOIN hours USING (ts)),
    whole AS (SELECT * FROM held WHERE price IS NOT NULL AND wind IS NOT NULL AND nuclear IS NOT NULL)"""


@query(
    "c16_feature_embedding",
    with_sql(mapped_sql("e", EMBEDDED), SHIP, FRAME, HOLIDAYS, HELD_HOLIDAYS, CYCLIC.format(name="e", rows="whole", more="")),
    digits=5,
)
def c16(t):
    """Holidays, calendar encodings and temperature statistics profiled and mapped."""
    from ..sources.feeds import holiday_hours
    from .sources import holiday_days

    w = feeds.holidays(hourly_frame(t), holiday_hours(holiday_days(t), "Europe/Helsinki"))
    rows, features = fe.price_features(w, "price", ["wind", "nuclear", "holiday"], carry=True, clip=None)
    return mapped(mo.feature_map(materialize(rows.select("ts", "price", *features), "features"), features, "price"))
