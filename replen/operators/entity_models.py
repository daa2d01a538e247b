"""A model for each entity: trained candidates and statistical methods meet on the same rolling-origin folds, and each entity takes its best.

Linear candidates are solved for all entities from mergeable sums of products (Gram matrices): the training part of a fold is the whole less the rows
tested in it and after it, so no model is fitted twice. Trees are fitted once a fold over all entities, on rows before the entity's own tested ones.
Forecasts get percentile bands of the residuals outside the folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import RegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replen.operators import forecasting
from replen.operators.forecasting import FEATURES, METHODS
from replen.operators.series import filled, future_matrix, training_matrix

LINEAR, TREES = ("ridge", "lasso"), ("gbt", "random_forest")
#: Rows that a candidate asks of an entity.
LEAST_ROWS = {"ridge": 12, "lasso": 12, "gbt": 24, "random_forest": 24}
RIDGE, LASSO = 1.0, 0.1
#: Matrices that ridge factors at a time (bounds memory).
CHUNK = 2000
#: Quantiles that are read from a sketch, equally far apart.
RANKS = 400
#: A vector of an entity's month: 1, the features, the quantity. Its sums of products are kept for i <= j.
WIDE = len(FEATURES) + 2
#: What rounding may leave of a sum of one product, beside its terms.
NOISE = np.finfo(float).eps * WIDE
UPPER = [(i, j) for i in range(WIDE) for j in range(i, WIDE)]


def with_folds(matrix: DataFrame, splits: int = 3, test: int = 3, least: int = 12) -> DataFrame:
    """matrix with n (rows of the entity), fold (in which a row is tested; null if in none) and step (its place there). The last fold
    tests the last `test` rows; a fold needs `least` rows before it."""
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("month"))) - 1
    rows = matrix.withColumns({"n": F.count("*").over(Window.partitionBy("entity")), "_back": back})
    from_end = F.floor(F.col("_back") / test).cast("int")
    tested = (from_end < splits) & (F.col("n") - (from_end + 1) * test >= least)
    step = test - F.pmod(F.col("_back"), F.lit(test)).cast("int")
    return rows.withColumns({"fold": F.when(tested, splits - 1 - from_end), "step": F.when(tested, step)}).drop("_back")


# Linear candidates from sums of products


def gram_sums(rows: DataFrame) -> DataFrame:
    """entity, fold, gram: sums of products of 1, the features and the quantity over the rows of each fold (null: never tested). Sums of
    disjoint rows may be added, so a new month costs its own row."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in FEATURES], F.col("quantity").cast("double")]
    return rows.groupBy("entity", "fold").agg(F.array(*[F.sum(z[i] * z[j]) for i, j in UPPER]).alias("gram"))


def merged(grams: DataFrame, more: DataFrame) -> DataFrame:
    """The sums of two tables of gram_sums() over disjoint rows."""
    rows = grams.unionByName(more)
    return rows.groupBy("entity", "fold").agg(F.array(*[F.sum(F.get("gram", F.lit(k))) for k in range(len(UPPER))]).alias("gram"))


def ridge_solved(centred: np.ndarray, moment: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of ridge for many matrices (m, WIDE - 1, WIDE - 1) of sums of n centred rows; moment: the sums of the features' squares, not centred.

    The last digits of sums are noise, which grows with the square of the quantities, and a mean of lags depends on the lags: no fixed penalty keeps such a
    matrix definite. So each is taken back to a factor like that of its rows, without directions that are noise beside the squares (no row has a part in
    them, and ridge gives them nothing), and the penalty meets the factor's singular values.
    """
    scale = np.sqrt(np.where(moment > 0, moment, 1))
    found = np.zeros_like(moment)
    for k in range(0, len(n), CHUNK):
        part = slice(k, k + CHUNK)
        by = scale[part]
        values, vectors = np.linalg.eigh(centred[part, :-1, :-1] / by[:, :, None] / by[:, None, :])
        known = values > NOISE * n[part, None]
        root, turned = np.sqrt(np.where(known, values, 1)), vectors.transpose(0, 2, 1)
        target = np.where(known, np.einsum("mij,mj->mi", turned, centred[part, :-1, -1] / by) / root, 0)
        left, s, right = np.linalg.svd(np.where(known, root, 0)[:, :, None] * turned * by[:, None, :])
        found[part] = np.einsum("mji,mj->mi", right, s / (s * s + ridge) * np.einsum("mji,mj->mi", left, target))
    return found


def solved(gram: np.ndarray, ridge: float = RIDGE, lasso: float = LASSO, most_sweeps: int = 1000) -> dict[str, np.ndarray]:
    """Coefficients (intercept first) of ridge and lasso for many Gram matrices (m, WIDE, WIDE) at a time; the intercept bears no penalty."""
    n = gram[:, 0, 0]
    mean = gram[:, 0, 1:] / n[:, None]
    centred = gram[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    xx, xy = centred[:, :-1, :-1], centred[:, :-1, -1]
    k = xx.shape[1]
    moment = np.einsum("mii->mi", gram)[:, 1:-1]
    found = {"ridge": ridge_solved(centred, moment, n, ridge)}
    # Lasso by coordinate descent on the same sums, all matrices together; what has settled is left out. A constant feature's square is noise of either sign.
    beta, left, square = np.zeros_like(xy), np.arange(len(n)), np.einsum("mii->mi", xx)
    square = np.where(square > NOISE * n[:, None] * moment, square, 0)
    for _ in range(most_sweeps):
        b, a, c, d, limit = beta[left], xx[left], xy[left], square[left], lasso * n[left]
        moved = np.zeros(len(left))
        for j in range(k):
            rest = c[:, j] - np.einsum("mi,mi->m", a[:, j], b) + d[:, j] * b[:, j]
            new = np.where(d[:, j] > 1e-9, np.sign(rest) * np.maximum(np.abs(rest) - limit, 0) / np.maximum(d[:, j], 1e-9), 0)
            moved = np.maximum(moved, np.abs(new - b[:, j]) * np.sqrt(d[:, j] / n[left]))
            b[:, j] = new
        beta[left] = b
        left = left[moved > 1e-7 * (1 + np.sqrt(np.maximum(centred[left, -1, -1], 0) / n[left]))]
        if not len(left):
            break
    found["lasso"] = beta
    return {m: np.c_[mean[:, -1] - np.einsum("mi,mi->m", mean[:, :-1], b), b] for m, b in found.items()}


def coefficients(grams: DataFrame, splits: int = 3) -> DataFrame:
    """entity, fold, method, coefficients of ridge and lasso, trained on the rows before each fold (fold null: on all rows). An entity has a few
    matrices only, so all of them come in one row."""
    rows = grams.groupBy("entity").agg(F.collect_list(F.struct(F.coalesce("fold", F.lit(-1)).alias("fold"), "gram")).alias("parts"))
    i, j = np.array(UPPER).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, sums = [], []
            for entity, parts in zip(pdf["entity"], pdf["parts"]):
                by = {int(p["fold"]): np.asarray(p["gram"], float) for p in parts}
                for fold in [f for f in by if f >= 0] + [splits]:
                    keys.append((entity, fold))
                    sums.append(sum(g for f, g in by.items() if f < fold))
            grids = np.zeros((len(keys), WIDE, WIDE))
            grids[:, i, j] = grids[:, j, i] = np.array(sums).reshape(len(keys), len(UPPER)) if keys else 0
            for method, found in (solved(grids) if keys else {}).items():
                fold = pd.array([None if f == splits else f for _, f in keys], "Int32")
                yield pd.DataFrame({"entity": [e for e, _ in keys], "fold": fold, "method": method, "coefficients": list(found)})

    return rows.mapInPandas(run, "entity string, fold int, method string, coefficients array<double>")


def linear_predictions(rows: DataFrame, coefs: DataFrame, on: list[str]) -> DataFrame:
    """rows with method and forecast, for each of the coefficients of the same keys."""
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in FEATURES])
    value = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return rows.join(coefs, on).withColumn("forecast", value).drop("coefficients")


# Trees, pooled over entities


def rows_before(rows: DataFrame, fold: int) -> DataFrame:
    """The rows of with_folds() that a fold's models may see: each entity's own before those it tests in this fold or a later one."""
    return rows.where(F.col("fold").isNull() | (F.col("fold") < fold))


def fitted_trees(rows: DataFrame, methods: tuple[str, ...] = TREES) -> dict[str, RegressionModel]:
    data = forecasting.dealt(forecasting.assembled(rows))
    made = {name: estimator.fit(data) for name, estimator in forecasting.candidates(1).items() if name in methods}
    data.unpersist()
    return made


def tree_predictions(models: dict[str, RegressionModel], rows: DataFrame) -> DataFrame:
    """rows with method and forecast of each model."""
    out, data = None, forecasting.assembled(rows.drop("features"))
    for name, model in models.items():
        made = model.transform(data).withColumn("method", F.lit(name)).withColumnRenamed("prediction", "forecast").drop("features")
        out = made if out is None else out.unionByName(made)
    return out


# Scores and choice


def kept(table: DataFrame) -> DataFrame:
    """table, computed here and once, in partitions by its number of rows and without its plan; one that is kept already is returned as it is.

    Months and types come from all sales, and candidates, folds and bands read them some dozen times. The partitions of a cache alone would be the session's
    shuffle partitions, which follow the sales, and each reading would cost a task for every one of them. Spark describes a plan with those of the caches in it
    after every stage, so caches over caches fill the driver's memory with descriptions.
    """
    if table.is_cached:
        return table
    own = table.checkpoint() if table.sparkSession.sparkContext.getCheckpointDir() else table.localCheckpoint()
    return own.coalesce(max(1, -(-own.count() // forecasting.PART_ROWS))).cache()


def out_of_fold(months: DataFrame, types: DataFrame, splits: int = 3, test: int = 3, least: int = 12, candidates: tuple[str, ...] = (*LINEAR, *TREES, *METHODS)) -> DataFrame:
    """entity, fold, month, step, method, forecast, quantity: what every candidate says about each fold's months, none of which it has seen of the entity.

    Entities with too few rows for a candidate (LEAST_ROWS) have none of it.
    """
    keep = ["entity", "fold", "month", "step", "method", "forecast", "quantity"]
    parts = []
    months, types = kept(months), kept(types)
    rows = with_folds(training_matrix(months, types, least), splits, test).withColumn("quantity", F.col("quantity").cast("double"))
    linear, trees, statistical = (tuple(m for m in group if m in candidates) for group in (LINEAR, TREES, METHODS))
    if linear:
        coefs = coefficients(gram_sums(rows), splits).where(F.col("fold").isNotNull() & F.col("method").isin(*linear))
        parts.append(linear_predictions(rows.where(F.col("n") >= LEAST_ROWS["ridge"]), coefs, ["entity", "fold"]).select(keep))
    if trees:
        rows = kept(rows)
        for fold in range(splits):
            tested = rows.where((F.col("fold") == fold) & (F.col("n") >= LEAST_ROWS["gbt"]))
            if not tested.isEmpty():
                parts.append(tree_predictions(fitted_trees(rows_before(rows, fold), trees), tested).select(keep))
    if statistical:
        parts.append(forecasting.fold_forecasts(filled(months, least), splits, test, statistical).select(keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_scores(forecasts: DataFrame, metric: str = "mape") -> DataFrame:
    """entity, method, score, deviation, n_folds: mean and standard deviation of the folds' scores. A fold without a score (mape without any sale)
    makes the mean infinite."""
    per = forecasting.fold_scores(forecasts).withColumn("s", F.coalesce(metric, F.lit(float("inf"))))
    finite = F.max("s") < float("inf")
    return per.groupBy("entity", "method").agg(
        F.when(finite, F.avg("s")).otherwise(F.lit(float("inf"))).alias("score"), F.when(finite, F.stddev_pop("s")).otherwise(F.lit(0.0)).alias("deviation"), F.count("*").alias("n_folds")
    )


def best_models(scores: DataFrame) -> DataFrame:
    """entity, method, score: the candidate of the least score (of equals the first by name); entities without a finite one are left out."""
    return scores.where(F.col("score") < float("inf")).groupBy("entity").agg(F.min(F.struct("score", "method")).alias("b")).select("entity", "b.method", "b.score")


def training_summary(entities: DataFrame, best: DataFrame) -> DataFrame:
    """method, n_entities, mean_score of the chosen candidates; entities without one count under `failed`."""
    rows = entities.select("entity").distinct().join(best, "entity", "left")
    return rows.groupBy(F.coalesce("method", F.lit("failed")).alias("method")).agg(F.count("*").alias("n_entities"), F.avg("score").alias("mean_score"))


# Bands


def levels(months: DataFrame) -> DataFrame:
    """entity, level (mean quantity and one), class (its binary logarithm): the scale of an entity's residuals."""
    level = months.groupBy("entity").agg((F.avg("quantity").cast("double") + 1).alias("level"))
    return level.withColumn("class", F.floor(F.log2(F.greatest("level", F.lit(1.0)))).cast("int"))


def residual_sketches(forecasts: DataFrame, scale: DataFrame) -> DataFrame:
    """method, step, class, sketch, n: mergeable quantile sketches (KLL) of residuals over the entity's level. n residuals each."""
    rows = forecasts.join(scale, "entity").withColumn("r", (F.col("quantity") - F.col("forecast")) / F.col("level"))
    return rows.groupBy("method", "step", "class").agg(F.kll_sketch_agg_double("r", F.lit(400)).alias("sketch"), F.count("r").alias("n"))


def _edges(confidence: float) -> list:
    """Quantiles of n residuals that a new one lies between with this confidence (each rank one wider, as the new one may take any place)."""
    ranks = F.array(*[F.lit(k / RANKS) for k in range(RANKS + 1)])
    values = F.kll_sketch_get_quantile_double("sketch", ranks)
    place = F.least(F.lit(RANKS), F.ceil((1 + confidence) / 2 * (F.col("n") + 1) / F.col("n") * RANKS)).cast("int")
    return [F.get(values, RANKS - place).alias("low"), F.get(values, place).alias("high")]


def bands(sketches: DataFrame, confidence: float = 0.95, least: int = 40) -> DataFrame:
    """method, step, class, low, high: between which shares of the level a residual lies; from the class's own sketch if it has
    `least` residuals, else from all classes of the step, merged."""
    whole = sketches.groupBy("method", "step").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")).select("method", "step", *_edges(confidence))
    own = sketches.where(F.col("n") >= least).select("method", "step", "class", *_edges(confidence))
    classes = sketches.select("method", "step", "class").join(whole, ["method", "step"])
    joined = classes.join(own.withColumnsRenamed({"low": "_low", "high": "_high"}), ["method", "step", "class"], "left")
    return joined.select("method", "step", "class", F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"))


def with_bands(forecasts: DataFrame, scale: DataFrame, banded: DataFrame, test: int = 3) -> DataFrame:
    """forecasts (entity, step, method, forecast, ...) with lower and upper, not under 0; steps beyond the tested ones take the last one's band.
    An entity of a class that no fold has seen takes the widest band of its method and step."""
    rows = forecasts.join(scale, "entity", "left").withColumn("_step", F.least("step", F.lit(test)))
    widest = banded.groupBy("method", F.col("step").alias("_step")).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    rows = rows.join(banded.withColumnRenamed("step", "_step"), ["method", "_step", "class"], "left").join(widest, ["method", "_step"], "left")
    edge = lambda c: F.greatest(F.lit(0.0), F.col("forecast") + F.coalesce(F.col(c), F.col(f"_{c}")) * F.col("level"))
    return rows.withColumns({"lower": F.when(F.coalesce("low", "_low").isNotNull(), edge("low")), "upper": F.when(F.coalesce("high", "_high").isNotNull(), edge("high"))}).select(
        *forecasts.columns, "lower", "upper"
    )


# All together


def forecast_best(months: DataFrame, types: DataFrame, best: DataFrame, horizon: int, least: int = 12) -> DataFrame:
    """entity, month, step, method, score, forecast: each entity by its chosen candidate, trained on all its months."""
    keep = ["entity", "month", "step", "method", "score", "forecast"]
    months, types = kept(months), kept(types)
    rows = training_matrix(months, types, least)
    future = future_matrix(months, types, horizon, least).drop("quantity").join(best, "entity")
    coefs = coefficients(gram_sums(rows.withColumn("fold", F.lit(None).cast("int")))).drop("fold")
    out = linear_predictions(future.where(F.col("method").isin(*LINEAR)), coefs, ["entity", "method"]).select(keep)
    trees = future.where(F.col("method").isin(*TREES))
    chosen = tuple(r["method"] for r in best.where(F.col("method").isin(*TREES)).select("method").distinct().collect())
    if chosen:
        made = tree_predictions(fitted_trees(rows, chosen), trees.withColumnRenamed("method", "_chosen").withColumn("quantity", F.lit(0.0)))
        out = out.unionByName(made.where("method = _chosen").select(keep))
    arrays = forecasting.as_arrays(filled(months, least))
    for name, method in METHODS.items():
        own = best.where(F.col("method") == name).select("entity", "score")
        made = method(arrays.join(own.select("entity"), "entity", "left_semi"), horizon).join(own, "entity")
        step = F.row_number().over(Window.partitionBy("entity").orderBy("month"))
        out = out.unionByName(made.withColumn("step", step).select(keep))
    return out.withColumn("forecast", F.greatest(F.lit(0.0), "forecast"))


def train_and_forecast(months: DataFrame, types: DataFrame, horizon: int, metric: str = "mape", splits: int = 3, test: int = 3, confidence: float = 0.95,
                       candidates: tuple[str, ...] = (*LINEAR, *TREES, *METHODS)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecasts with lower and upper, training summary, scores) of all entities with a year of months and more.

    months: entity, month, quantity; types: entity, type, cv. Entities without a candidate that could be scored are counted as failed and have no
    forecast.
    """
    months, types = kept(months), kept(types)
    known = kept(out_of_fold(months, types, splits, test, candidates=candidates))
    scores = model_scores(known, metric)
    best, scale = kept(best_models(scores)), levels(months)
    banded = bands(kept(residual_sketches(known, scale)), confidence)
    forecasts = with_bands(forecast_best(months, types, best, horizon), scale, banded, test)
    return forecasts, training_summary(months, best), scores
