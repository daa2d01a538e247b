"""Compositions: the full summary of an entity level and the recommendations from it. All lazy; Catalyst sees one plan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replen.operators import inventory, priority, stats
from replen.plans.settings import Settings


def reorder_points(sales: DataFrame, entity: str, as_of: date, s: Settings = Settings()) -> DataFrame:
    """Statistics, product type, safety stock and reorder point of every entity."""
    months = stats.monthly(stats.before(sales, as_of), entity, as_of, s)
    return stats.with_safety_stock(stats.classify(stats.profile(months, as_of, s), as_of, s), s)


def full_summary(sales: DataFrame, stock: DataFrame, forecast: DataFrame, meta: DataFrame, as_of: date, entity: str = "sku", s: Settings = Settings()) -> DataFrame:
    """Reorder points with stock position, forecast over the lead time and material.

    forecast: one version; meta: model, material, one row a model.
    """
    now = inventory.latest_snapshot(stock).groupBy(F.col(entity).alias("entity")).agg(F.sum("available_stock").alias("stock"), F.avg("net_price").alias("price"))
    out = inventory.position(reorder_points(sales, entity, as_of, s), now)
    out = out.join(stats.forecast_in_lead_time(forecast, entity, as_of, s.lead_time), "entity", "left")
    out = out.withColumns({"forecast": F.coalesce("forecast", F.lit(0)), "model": F.substring("entity", 1, 5)})
    return out.join(meta.select("model", "material"), "model", "left")


def recommendations(summary: DataFrame, n: int = 10, exclude: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """The n best model-colors; models in exclude (e.g. with active orders) are left out before the rollup."""
    rows = summary if exclude is None else summary.join(exclude.select("model").distinct(), "model", "left_anti")
    return priority.recommend(priority.prioritise(rows, s), n)
