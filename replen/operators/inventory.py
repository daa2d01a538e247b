"""Stock: latest snapshots, position against the reorder point, streaks without stock, and projections."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.calendar import add_months
from replen.plans.settings import Settings


def latest_snapshot(stock: DataFrame, on: date | None = None) -> DataFrame:
    """Active rows of the snapshot of a day, or of the last one (a one-row maximum, broadcast)."""
    rows = stock.where("is_active")
    if on is not None:
        return rows.where(F.col("snapshot_date") == F.lit(on))
    last = F.broadcast(stock.agg(F.max("snapshot_date").alias("snapshot_date")))
    return rows.join(last, "snapshot_date")


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each key: the one whose version columns are greatest."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in version])
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def version_as_of(forecast: DataFrame, target: date, tolerance_days: int = 7) -> DataFrame:
    """Rows of the forecast version generated nearest to target, within the tolerance (the earlier of equals)."""
    away = F.abs(F.datediff("generated_date", F.lit(target)))
    near = forecast.where(away <= tolerance_days).agg(F.min_by("generated_date", F.struct(away, "generated_date")).alias("generated_date"))
    return forecast.join(F.broadcast(near), "generated_date", "left_semi")


def newest_version(forecast: DataFrame) -> DataFrame:
    """The rows of the last generated version."""
    last = forecast.agg(F.max("generated_date").alias("generated_date"))  # one row
    return forecast.join(F.broadcast(last), "generated_date", "left_semi")


def history_between(stock: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Stock snapshots from start to end (both included; open where None). Whoever writes or shows them puts them in order."""
    rows = stock
    if start is not None:
        rows = rows.where(F.col("snapshot_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("snapshot_date") <= F.lit(end))
    return rows


def accuracy_target(start: date, lookback_months: int = 4) -> date:
    """The day around which the version to be judged was made."""
    return start - timedelta(days=int(lookback_months * 30.44))


def by_model(stock: DataFrame) -> DataFrame:
    """Stock, value and a description for each model."""
    return stock.groupBy("model").agg(
        F.sum("available_stock").alias("available_stock"),
        F.sum(F.col("available_stock") * F.col("net_price")).alias("value"),
        F.min("product_name").alias("product_name"),
    )


def position(summary: DataFrame, stock: DataFrame) -> DataFrame:
    """Add stock, price, value, below_rop, deficit and overstock percent; entities without stock rows have 0.

    stock: entity, stock, price.
    """
    out = summary.join(stock, "entity", "left").withColumns({"stock": F.coalesce("stock", F.lit(0)), "price": F.coalesce("price", F.lit(0.0))})
    return out.withColumns(
        {
            "value": F.col("stock") * F.col("price"),
            "below_rop": F.coalesce(F.col("stock") < F.col("rop"), F.lit(False)),
            "deficit": F.greatest(F.lit(0.0), F.coalesce(F.col("rop") - F.col("stock"), F.lit(0.0))),
            "overstock_percent": F.coalesce(F.try_divide(F.col("stock") - F.col("rop"), F.col("rop")) * 100, F.lit(0.0)),
        }
    )


def stock_kpis(positioned: DataFrame, s: Settings = Settings()) -> DataFrame:
    over = F.col("overstock_percent") >= s.overstock
    return positioned.agg(
        F.count("*").alias("n"),
        F.count_if("below_rop").alias("n_below_rop"),
        F.sum("deficit").alias("total_deficit"),
        F.coalesce(F.try_divide(F.count_if("below_rop") * 100.0, F.count("*")), F.lit(0.0)).alias("percent_below"),
        F.count_if(over).alias("n_overstocked"),
        F.count_if(~over & ~F.col("below_rop")).alias("n_normal"),
        F.sum("stock").alias("total_stock"),
        F.sum("value").alias("total_value"),
    )


def matches(search: str | None = None, below_rop: bool = False, bestseller: bool = False, overstocked: bool = False,
            types: list[str] | None = None, materials: list[str] | None = None, not_materials: list[str] | None = None,
            facilities: list[str] | None = None, not_facilities: list[str] | None = None, s: Settings = Settings()) -> Column:
    """The filters of the summary as one predicate; excluded materials and facilities keep rows without one."""
    out = F.lit(True)
    if search:
        out = out & F.upper("entity").contains(search.upper())
    if below_rop:
        out = out & F.col("below_rop")
    if bestseller:
        out = out & (F.col("recent_average") > s.bestseller)
    if overstocked:
        out = out & (F.col("overstock_percent") >= s.overstock)
    if types:
        out = out & F.col("type").isin(types)
    if materials:
        out = out & F.col("material").isin(materials)
    if not_materials:
        out = out & ~F.coalesce(F.col("material").isin(not_materials), F.lit(False))
    if facilities:
        out = out & F.col("facility").isin(facilities)
    if not_facilities:
        out = out & ~F.coalesce(F.col("facility").isin(not_facilities), F.lit(False))
    return out


def out_of_stock_streaks(history: DataFrame, entity: str) -> DataFrame:
    """Entities without stock at the last snapshot, or absent from it, and the days since they last had some.

    An entity that never had stock counts from the first snapshot. Only streaks of a day or more are listed.
    """
    bounds = F.broadcast(history.agg(F.max("snapshot_date").alias("last"), F.min("snapshot_date").alias("first")))
    daily = history.groupBy(F.col(entity).alias("entity"), "snapshot_date").agg(F.sum("available_stock").alias("stock"))
    per = daily.groupBy("entity").agg(
        F.max(F.when(F.col("stock") > 0, F.col("snapshot_date"))).alias("last_in_stock"),
        F.max_by("stock", "snapshot_date").alias("stock"),
        F.max("snapshot_date").alias("seen"),
    )
    days = F.datediff("last", F.coalesce("last_in_stock", "first"))
    out = per.crossJoin(bounds).where((F.col("seen") < F.col("last")) | (F.col("stock") <= 0))
    return out.select("entity", "last_in_stock", days.alias("days_out")).where("days_out > 0")


def projection(starts: DataFrame, forecast: DataFrame, start: date, n_months: int = 12) -> DataFrame:
    """Running stock of every entity: a seed row at start, then stock less all forecast up to each date.

    starts: entity, stock, rop; forecast: entity, forecast_date, forecast (dates from start to the same day n_months later, or that month's last day).
    below_rop holds from the reorder point itself on.
    """
    end = add_months(start, n_months)
    end = end.replace(day=min(start.day, monthrange(end.year, end.month)[1]))
    rows = forecast.where(F.col("forecast_date").between(F.lit(start), F.lit(end))).join(starts.select("entity"), "entity", "left_semi")
    rows = rows.groupBy("entity", "forecast_date").agg(F.sum("forecast").cast("double").alias("demand"))
    seed = starts.select("entity", F.lit(start).alias("forecast_date"), F.lit(0.0).alias("demand"), F.lit(0).alias("step"))
    rows = seed.unionByName(rows.withColumn("step", F.lit(1))).join(starts, "entity")
    upto = Window.partitionBy("entity").orderBy("forecast_date", "step").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("stock") - F.sum("demand").over(upto)
    return rows.select("entity", F.col("forecast_date").alias("date"), "step", "demand", left.alias("projected"), "rop").withColumns(
        {"below_rop": F.col("projected") <= F.col("rop"), "out_of_stock": F.col("projected") <= 0}
    )


def crossings(projected: DataFrame, start: date, critical_days: int = 30) -> DataFrame:
    """The first dates at which each projection is under the reorder point and out of stock."""
    first = projected.groupBy("entity").agg(
        F.min(F.when(F.col("below_rop"), F.col("date"))).alias("rop_date"), F.min(F.when(F.col("out_of_stock"), F.col("date"))).alias("zero_date")
    )
    days = F.datediff("zero_date", F.lit(start))
    return first.withColumns({"days_to_zero": days, "critical": F.coalesce(days <= critical_days, F.lit(False))})
