"""Forecast accuracy and comparison by single grouped passes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.calendar import month, week_start

MAPE_BANDS = [(20.0, "good"), (40.0, "acceptable")]


def planned_and_sold(sales: DataFrame, forecast: DataFrame, start: date, end: date, entity: str) -> DataFrame:
    """entity, day, forecast, actual (null without sales) for every forecast day of a span."""
    key = F.col(entity).alias("entity")
    span = lambda day: F.col(day).between(F.lit(start), F.lit(end))
    planned = forecast.where(span("forecast_date")).groupBy(key, F.col("forecast_date").alias("day")).agg(F.sum("forecast").alias("forecast"))
    sold = sales.where(span("sale_date")).groupBy(key, F.col("sale_date").alias("day")).agg(F.sum("quantity").alias("actual"))
    return planned.join(sold, ["entity", "day"], "left")


def daily_grid(sales: DataFrame, forecast: DataFrame, stock: DataFrame, start: date, end: date, entity: str) -> DataFrame:
    """entity, day, forecast, actual, had_stock for every forecast day of a span.

    Stock carries forward from an entity's last snapshot in the grid; before any, a day counts as in stock.
    """
    held = stock.where(F.col("snapshot_date").between(F.lit(start), F.lit(end)))
    held = held.groupBy(F.col(entity).alias("entity"), F.col("snapshot_date").alias("day")).agg(F.sum("available_stock").alias("stock"))
    rows = planned_and_sold(sales, forecast, start, end, entity).join(held, ["entity", "day"], "left")
    upto = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("stock", ignorenulls=True).over(upto)
    return rows.select("entity", "day", "forecast", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce(known > 0, F.lit(True)).alias("had_stock"))


def _errors(f: Column, a: Column, where: Column) -> dict[str, Column]:
    """Percent errors over days with sales and plain errors over all days that `where` admits."""
    sold = where & (a > 0)
    return {
        "mape": F.avg(F.when(sold, F.abs(f - a) / a)) * 100,
        "bias": F.avg(F.when(sold, (f - a) / a)) * 100,
        "mae": F.avg(F.when(where, F.abs(f - a))),
        "rmse": F.sqrt(F.avg(F.when(where, (f - a) * (f - a)))),
    }


def accuracy(grid: DataFrame) -> DataFrame:
    """Metrics of each entity on days in stock, and what it may have missed on the others."""
    f, a, has = F.col("forecast"), F.col("actual"), F.col("had_stock")
    return grid.groupBy("entity").agg(
        *[v.alias(k) for k, v in _errors(f, a, has).items()],
        F.sum(F.when(has, f)).alias("total_forecast"),
        F.sum(F.when(has, a)).alias("total_actual"),
        F.count_if(has).alias("n_days"),
        F.count_if(~has).alias("n_days_out"),
        F.coalesce(F.sum(F.when(~has, f)), F.lit(0)).alias("missed"),
    )


def by_type(metrics: DataFrame, types: DataFrame) -> DataFrame:
    """Mean metrics and totals for each product type (unknown if missing)."""
    rows = metrics.join(types.select("entity", "type"), "entity", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))
    return rows.groupBy("type").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(c) for c in ("mape", "bias", "mae", "rmse")],
        *[F.sum(c).alias(c) for c in ("total_forecast", "total_actual", "missed")],
    )


def trend(grid: DataFrame, period: str = "week") -> DataFrame:
    """MAPE and bias over all entities by week (from Monday) or month, on days in stock."""
    start = week_start(F.col("day")) if period == "week" else month(F.col("day"))
    f, a, has = F.col("forecast"), F.col("actual"), F.col("had_stock")
    e = _errors(f, a, has)
    rows = grid.groupBy(start.alias("period")).agg(e["mape"].alias("mape"), e["bias"].alias("bias"), F.count_if(has & (a > 0)).alias("n"))
    return rows.where("n > 0")


def overall(metrics: DataFrame) -> DataFrame:
    """Unweighted means of the entities' metrics, totals, and the volume accuracy."""
    total = metrics.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(c) for c in ("mape", "bias", "mae", "rmse")],
        *[F.sum(c).alias(c) for c in ("total_forecast", "total_actual", "missed")],
    )
    off = F.try_divide(F.abs(F.col("total_forecast") - F.col("total_actual")), F.col("total_actual"))
    return total.withColumn("volume_accuracy", F.greatest(F.lit(0.0), 1 - off) * 100)


def align(internal: DataFrame, external: DataFrame, actual: DataFrame) -> DataFrame:
    """entity, month, internal, external, actual, method: internal forecasts drive; what is missing is 0.

    internal: entity, month, forecast, method; external and actual: entity, month, forecast / quantity.
    """
    own = internal.groupBy("entity", "month").agg(F.sum("forecast").alias("internal"), F.min("method").alias("method"))
    other = external.groupBy("entity", "month").agg(F.sum("forecast").cast("double").alias("external"))
    real = actual.groupBy("entity", "month").agg(F.sum("quantity").cast("double").alias("actual"))
    rows = own.join(other, ["entity", "month"], "left").join(real, ["entity", "month"], "left")
    return rows.fillna(0, ["internal", "external", "actual"])


def compare(aligned: DataFrame) -> DataFrame:
    """Errors of both forecasts for each entity over months with sales, the winner and its improvement in percent; others are dropped."""
    a, sold = F.col("actual"), F.col("actual") > 0
    both = {f"{side}_{k}": v for side in ("internal", "external") for k, v in _errors(F.col(side), a, sold).items()}
    rows = aligned.groupBy("entity").agg(F.min("method").alias("method"), F.count_if(sold).alias("n_months"), *[v.alias(k) for k, v in both.items()])
    i, e = F.col("internal_mape"), F.col("external_mape")
    winner = F.when(i < e, "internal").when(i > e, "external").otherwise("tie")
    return rows.where("n_months > 0").withColumns({"winner": winner, "improvement": F.coalesce(F.try_divide(e - i, e) * 100, F.lit(0.0))})


def compare_by_type(compared: DataFrame, types: DataFrame) -> DataFrame:
    rows = compared.join(types.select("entity", "type"), "entity", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))
    wins = lambda w: F.count_if(F.col("winner") == w)
    return rows.groupBy("type").agg(
        F.count("*").alias("n"), wins("internal").alias("internal_wins"), wins("external").alias("external_wins"), wins("tie").alias("ties"),
        (wins("internal") * 100.0 / F.count("*")).alias("internal_percent"), F.avg("internal_mape").alias("internal_mape"), F.avg("external_mape").alias("external_mape"),
    )


def compare_overall(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("n"), F.count_if(F.col("winner") == "internal").alias("internal_wins"), F.count_if(F.col("winner") == "external").alias("external_wins"),
        F.avg("internal_mape").alias("internal_mape"), F.avg("external_mape").alias("external_mape"), F.median("improvement").alias("median_improvement"),
    )


def details(rows: DataFrame, entity: str | None = None, search: str | None = None, by: str = "entity", descending: bool = False) -> DataFrame:
    """Result rows of one entity, or of those whose name holds a text in any case, sorted by a column (nulls last)."""
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if search:
        rows = rows.where(F.upper("entity").contains(search.upper()))
    return rows.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), "entity")
