"""Batch forecasting: every entity in one distributed job, by expressions over arrays instead of a loop of fits.

Smoothing is recursive, so a series is one array. Its parameters are fitted to each series by smoothing.fitted(), in Arrow batches of
entities; with stated parameters the recursion is an aggregate() over the array.
"""

from __future__ import annotations

from datetime import date

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.operators.series import LAGS, ROLLING, filled
from replen.operators.smoothing import SEASON, fitted

WMA_WEIGHTS = (0.5, 0.3, 0.2)
FEATURES = [f"lag_{k}" for k in LAGS] + [f"{m}_{n}" for n in ROLLING for m in ("mean", "sd")] + [
    "yoy", "yoy_percent", "calendar_month", "quarter", "month_sin", "month_cos", "type_code", "cv",
]


def choose_method(kind: Column, cv: Column, n: Column) -> Column:
    """The method for an entity's type, variation and number of months; without a variation the type decides. Seasonal methods need two years."""
    varied = F.when(cv.isNotNull(), cv >= 0.6).otherwise(F.coalesce(kind.isin("regular", "seasonal"), F.lit(False)))
    return (
        F.when((kind == "new") | (n < 12), "moving_avg")
        .when(varied & (n >= 2 * SEASON), "holt_winters")
        .otherwise("exp_smoothing")
    )


def as_arrays(series: DataFrame) -> DataFrame:
    """entity, y (quantities in order), n, last month of filled series (some hundred months an entity at most)."""
    rows = series.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("month", F.col("quantity").cast("double").alias("q")))).alias("s"))
    return rows.select("entity", F.transform("s", lambda x: x["q"]).alias("y"), F.size("s").alias("n"), F.element_at("s", -1)["month"].alias("last"))


def _ahead(rows: DataFrame, horizon: int, point: Column, spread: Column, method: Column) -> DataFrame:
    """Explode the horizon; point may use the column step."""
    out = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = out.withColumns({"point": point, "spread": spread})
    return out.select(
        "entity",
        F.add_months("last", F.col("step")).alias("month"),
        F.greatest(F.lit(0.0), "point").alias("forecast"),
        F.greatest(F.lit(0.0), F.col("point") - F.col("spread")).alias("lower"),
        F.greatest(F.lit(0.0), F.col("point") + F.col("spread")).alias("upper"),
        method.alias("method"),
    )


def weighted_mean(newest_first: bool = False) -> Column:
    """Weights over the last three values of y (oldest first by default); the mean of fewer."""
    weights = WMA_WEIGHTS[::-1] if newest_first else WMA_WEIGHTS
    last = F.slice("y", -3, 3)
    return F.when(F.col("n") >= 3, sum(w * F.get(last, i) for i, w in enumerate(weights))).otherwise(F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / F.col("n"))


def moving_average(arrays: DataFrame, horizon: int, newest_first: bool = False) -> DataFrame:
    """A flat forecast with a band of 20 percent."""
    mean = weighted_mean(newest_first)
    return _ahead(arrays, horizon, mean, 0.2 * mean, F.lit("moving_avg"))


def smoothing_fit(y: Column, alpha: float, beta: float) -> Column:
    """Additive-trend smoothing with stated parameters: struct of level, trend and squared error after the last value."""
    start = F.struct(F.get(y, 0).alias("level"), (F.get(y, 1) - F.get(y, 0)).alias("trend"), F.lit(0.0).alias("sse"))

    def step(s: Column, x: Column) -> Column:
        guess = s["level"] + s["trend"]
        level = alpha * x + (1 - alpha) * guess
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sse"] + (x - guess) * (x - guess)).alias("sse"))

    return F.aggregate(F.slice(y, F.lit(2), F.greatest(F.lit(0), F.size(y) - 1)), start, step)


def smoothing_ahead(fit: str) -> tuple[Column, Column]:
    """Point and band, `step` months on."""
    return F.col(f"{fit}.level") + F.col("step") * F.col(f"{fit}.trend"), 1.96 * F.sqrt(F.col(f"{fit}.sse") / F.greatest(F.lit(1), F.col("n") - 2))


def exponential_smoothing(arrays: DataFrame, horizon: int) -> DataFrame:
    """The fitted additive trend, with 1.96 deviations of its one-step errors as a band, for series of three months or more."""
    return _ahead(fitted(arrays.where("n >= 3"), es=F.lit(True)), horizon, *smoothing_ahead("es"), F.lit("exp_smoothing"))


def holt_winters_fit(y: Column, alpha: float, beta: float, gamma: float, damping: float) -> Column:
    """Damped additive trend and additive season of 12 months with stated parameters; the seasons are an array that turns with the months."""
    year = lambda k: F.aggregate(F.slice(y, SEASON * k + 1, SEASON), F.lit(0.0), lambda a, x: a + x) / SEASON
    start = F.struct(
        year(0).alias("level"), ((year(1) - year(0)) / SEASON).alias("trend"),
        F.transform(F.slice(y, 1, SEASON), lambda x: x - year(0)).alias("season"), F.lit(0.0).alias("sse"),
    )

    def step(s: Column, x: Column) -> Column:
        season, trend = F.get(s["season"], 0), damping * s["trend"]
        guess = s["level"] + trend + season
        level = alpha * (x - season) + (1 - alpha) * (s["level"] + trend)
        return F.struct(
            level.alias("level"),
            (beta * (level - s["level"]) + (1 - beta) * trend).alias("trend"),
            F.concat(F.slice(s["season"], 2, SEASON - 1), F.array(gamma * (x - level) + (1 - gamma) * season)).alias("season"),
            (s["sse"] + (x - guess) * (x - guess)).alias("sse"),
        )

    return F.aggregate(F.slice(y, F.lit(SEASON + 1), F.greatest(F.lit(0), F.size(y) - SEASON)), start, step)


def holt_winters_ahead(fit: str) -> tuple[Column, Column]:
    """Point and band, `step` months on."""
    by = F.col(f"{fit}.damping")
    damped = by * (1 - F.pow(by, F.col("step"))) / (1 - by)
    point = F.col(f"{fit}.level") + damped * F.col(f"{fit}.trend") + F.get(F.col(f"{fit}.season"), F.pmod(F.col("step") - 1, F.lit(SEASON)))
    return point, 1.96 * F.sqrt(F.col(f"{fit}.sse") / (F.col("n") - SEASON))


def holt_winters(arrays: DataFrame, horizon: int) -> DataFrame:
    """The fit of level, trend, season and damping for series of two years or more."""
    return _ahead(fitted(arrays.where(F.col("n") >= 2 * SEASON), hw=F.lit(True)), horizon, *holt_winters_ahead("hw"), F.lit("holt_winters"))


def forecast_all(months: DataFrame, types: DataFrame, horizon: int, least: int = 12) -> DataFrame:
    """entity, month, forecast, lower, upper, method of every entity with `least` months, each by its method, in one pass. types: entity, type, cv."""
    arrays = as_arrays(filled(months, least)).join(types.select("entity", "type", "cv"), "entity", "left")
    method = choose_method(F.col("type"), F.col("cv"), F.col("n"))
    rows = arrays.withColumn("method", method).where((F.col("method") != "exp_smoothing") | (F.col("n") >= 3))
    rows = fitted(rows, es=F.col("method") == "exp_smoothing", hw=F.col("method") == "holt_winters")
    mean, es, hw = weighted_mean(), smoothing_ahead("es"), holt_winters_ahead("hw")
    choice = lambda a, b, c: F.when(F.col("method") == "moving_avg", a).when(F.col("method") == "exp_smoothing", b).otherwise(c)
    return _ahead(rows, horizon, choice(mean, es[0], hw[0]), choice(0.2 * mean, es[1], hw[1]), F.col("method"))


def batch_stats(forecasts: DataFrame, entities: DataFrame) -> DataFrame:
    """method, n_entities; entities without a forecast (too short a series) count under `failed`."""
    made = forecasts.select("entity", "method").distinct()
    rows = entities.select("entity").distinct().join(made, "entity", "left")
    return rows.groupBy(F.coalesce("method", F.lit("failed")).alias("method")).agg(F.count("*").alias("n_entities"))


def folds(series: DataFrame, splits: int = 3, test: int = 3, least: int = 12) -> DataFrame:
    """Rolling-origin folds of filled series: entity, fold, month, quantity, is_test; the last fold tests the last months."""
    ends = series.groupBy("entity").agg(F.count("*").alias("n"), F.min("month").alias("lo"))
    fold = ends.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    fold = fold.withColumn("cut", F.col("n") - (splits - F.col("fold")) * test).where(F.col("cut") >= F.greatest(F.lit(least), F.col("n") - splits * test - test))
    rows = series.join(fold, "entity").withColumn("at", F.months_between("month", "lo").cast("int"))
    rows = rows.where(F.col("at") < F.col("cut") + test)
    return rows.select("entity", "fold", "month", "quantity", (F.col("at") >= F.col("cut")).alias("is_test"))


METHODS = {"moving_avg": moving_average, "exp_smoothing": exponential_smoothing, "holt_winters": holt_winters}


def fold_forecasts(series: DataFrame, splits: int = 3, test: int = 3, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """entity, fold, month, step, method, forecast, quantity of the statistical methods on each fold's tested months, fitted on the months before.

    Folds are entities of their own, so all fits are one job.
    """
    rows = folds(series, splits, test).withColumn("key", F.concat_ws("\x1f", "entity", "fold"))
    train = rows.where("not is_test").select(F.col("key").alias("entity"), "month", "quantity")
    arrays, made = as_arrays(train), None
    for name in methods:
        out = METHODS[name](arrays, test)
        made = out if made is None else made.unionByName(out)
    made = made.select(F.col("entity").alias("key"), "month", "method", "forecast")
    truth = rows.where("is_test").select("key", "entity", "fold", "month", "quantity")
    step = F.row_number().over(Window.partitionBy("key", "method").orderBy("month"))
    return made.join(truth, ["key", "month"]).select("entity", "fold", "month", step.alias("step"), "method", "forecast", F.col("quantity").cast("double").alias("quantity"))


def fold_scores(forecasts: DataFrame) -> DataFrame:
    """entity, fold, method, mape, smape, mae, rmse of fold_forecasts() rows; mape leaves out months without sales (null if all are), smape those where
    forecast and sales are both 0."""
    f, y = F.col("forecast"), F.col("quantity")
    return forecasts.groupBy("entity", "fold", "method").agg(
        (F.avg(F.when(y != 0, F.abs(f - y) / F.abs(y))) * 100).alias("mape"),
        (F.avg(F.try_divide(2 * F.abs(f - y), F.abs(f) + F.abs(y))) * 100).alias("smape"),
        F.avg(F.abs(f - y)).alias("mae"), F.sqrt(F.avg((f - y) * (f - y))).alias("rmse"),
    )


def cross_validate(series: DataFrame, splits: int = 3, test: int = 3, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """entity, method, mape, smape, mae, rmse: means over the folds of the statistical methods."""
    per = fold_scores(fold_forecasts(series, splits, test, methods))
    return per.groupBy("entity", "method").agg(*[F.avg(c).alias(c) for c in ("mape", "smape", "mae", "rmse")])


def best_method(scores: DataFrame, metric: str = "mape") -> DataFrame:
    """The method with the least mean score of each entity; null scores (no valid fold) come last."""
    order = F.struct(F.col(metric).isNull(), metric, "method")
    return scores.groupBy("entity").agg(F.min_by(F.struct("method", F.col(metric).alias("score")), order).alias("best")).select("entity", "best.*")


def candidates(n_rows: int) -> dict:
    """The pooled models. Ridge and lasso penalties are those of sums of squares, hence the division by rows."""
    kw = {"featuresCol": "features", "labelCol": "quantity"}
    return {
        "gbt": GBTRegressor(maxIter=20, maxDepth=4, seed=7, **kw),
        "random_forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=7, **kw),
        "ridge": LinearRegression(regParam=1.0 / max(1, n_rows), elasticNetParam=0.0, standardization=False, **kw),
        "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False, **kw),
    }


def assembled(matrix: DataFrame) -> DataFrame:
    rows = matrix.withColumn("quantity", F.col("quantity").cast("double"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip").transform(rows)


#: Rows to train on that make a partition.
PART_ROWS = 20_000


def dealt(rows: DataFrame) -> DataFrame:
    """rows (entity, month, ...), computed once, kept, and dealt by their number.

    A fit of trees passes over its rows some hundred times, and each pass costs a task a partition: with a session's shuffle partitions, which follow the sales, a
    few thousand months would be mostly empty tasks. Order and partitions follow the rows alone, and so do samples that are drawn by partition.
    """
    first = rows.cache()
    parts = max(1, -(-first.count() // PART_ROWS))
    out = first.repartition(parts, "entity").sortWithinPartitions("entity", "month").cache()
    out.count()
    first.unpersist()
    return out


def fit_pooled(matrix: DataFrame, cut: date, names: list[str] | None = None):
    """Fit the candidates on months before cut, score them on the rest, and fit the one of the least MAE again on all months.

    One model is fitted over all entities, by distributed passes. Returns (name, model, scores, residuals): scores hold one row
    a candidate; residuals (entity, residual) are the chosen candidate's on the months held out, before it is fitted again.
    """
    rows = dealt(assembled(matrix))
    train, test = rows.where(F.col("month") < F.lit(cut)), rows.where(F.col("month") >= F.lit(cut))
    residual = F.col("quantity") - F.greatest(F.lit(0.0), F.col("prediction"))
    found = {}
    for name, estimator in candidates(train.count()).items():
        if names is None or name in names:
            model = estimator.fit(train)
            error = model.transform(test).agg(F.avg(F.abs(residual)).alias("mae")).first()["mae"]
            found[name] = (model, float("inf") if error is None else error)
    best = min(found, key=lambda k: (found[k][1], k))
    whole = candidates(rows.count())[best].fit(rows)
    rows.unpersist()
    return best, whole, {k: v[1] for k, v in found.items()}, found[best][0].transform(test).select("entity", residual.alias("residual"))


def train_pooled(matrix: DataFrame, cut: date, names: list[str] | None = None):
    """(name, model, scores) of fit_pooled()."""
    return fit_pooled(matrix, cut, names)[:3]


def residual_sds(residuals: DataFrame) -> DataFrame:
    """entity, residual_sd: the root mean square residual of each entity's months held out; the row of a null entity is that of all."""
    sums = residuals.groupBy("entity").agg(F.sum(F.col("residual") * F.col("residual")).alias("sse"), F.count("residual").alias("n"))
    whole = sums.agg(F.lit(None).cast("string").alias("entity"), F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    return sums.where("entity is not null").unionByName(whole).select("entity", F.sqrt(F.try_divide("sse", "n")).alias("residual_sd"))


def predict_pooled(model, future: DataFrame, residual_sd: float | DataFrame) -> DataFrame:
    """Forecasts with lower and upper, 1.96 residual_sd away.

    residual_sd: one for all, or the rows of residual_sds(). An entity without months held out has that of all; without any, the bounds are null.
    """
    rows = model.transform(assembled(future))
    if isinstance(residual_sd, DataFrame):
        whole = residual_sd.where("entity is null").select(F.col("residual_sd").alias("whole_sd"))  # one row
        rows = rows.join(residual_sd, "entity", "left").crossJoin(F.broadcast(whole)).withColumn("sd", F.coalesce("residual_sd", "whole_sd"))
    else:
        rows = rows.withColumn("sd", F.lit(residual_sd))
    p, off = F.greatest(F.lit(0.0), F.col("prediction")), 1.96 * F.col("sd")
    low = F.when(off.isNotNull(), F.greatest(F.lit(0.0), p - off))
    return rows.select("entity", "month", p.alias("forecast"), low.alias("lower"), (p + off).alias("upper"))


def importance(model, n: int = 15) -> list[tuple[str, float]]:
    """The n most important features (absolute coefficients of linear models)."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return sorted(zip(FEATURES, (abs(float(v)) for v in values.toArray())), key=lambda x: -x[1])[:n]


def as_vendor_rows(forecasts: DataFrame, shares: DataFrame) -> DataFrame:
    """Model-level forecasts as SKU rows (sku, forecast_date, forecast), split by each SKU's share. shares: model, sku, share."""
    rows = forecasts.join(shares, forecasts["entity"] == shares["model"])
    return rows.select("sku", F.col("month").alias("forecast_date"), (F.col("forecast") * F.col("share")).alias("forecast"))
