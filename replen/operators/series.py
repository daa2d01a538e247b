"""Monthly series of all entities at once: gap filling, lags, rolling means and feature matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 2, 3, 6, 12)
ROLLING = (3, 6, 12)
TYPE_CODES = {"basic": 0, "regular": 1, "seasonal": 2, "new": 3}


def filled(months: DataFrame, least: int = 1) -> DataFrame:
    """entity, month, quantity for every month from an entity's first to its last, 0 where it sold nothing; entities with `least` months or more."""
    span = months.groupBy("entity").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    span = span.where(F.months_between("hi", "lo") + 1 >= least)
    spine = span.select("entity", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return spine.join(months.select("entity", "month", "quantity"), ["entity", "month"], "left").withColumn("quantity", F.coalesce("quantity", F.lit(0)))


def features(series: DataFrame, leak_free: bool = True) -> DataFrame:
    """Lags, rolling mean and deviation, yearly change and calendar columns of filled series.

    leak_free ends every frame before the row's own month; without it rolling and yearly columns hold the month itself.
    """
    by = Window.partitionBy("entity").orderBy("month")
    last = -1 if leak_free else 0
    q = F.col("quantity")
    columns: dict[str, Column] = {f"lag_{k}": F.lag("quantity", k).over(by) for k in LAGS}
    for n in ROLLING:
        frame = by.rowsBetween(last - n + 1, last)
        columns[f"mean_{n}"] = F.avg("quantity").over(frame)
        columns[f"sd_{n}"] = F.coalesce(F.stddev_samp("quantity").over(frame), F.lit(0.0))
    now = F.lag("quantity", 1).over(by) if leak_free else q
    year_ago = F.lag("quantity", 13 if leak_free else 12).over(by)
    columns["yoy"] = F.coalesce(now - year_ago, F.lit(0))
    columns["yoy_percent"] = F.coalesce(F.try_divide(now - year_ago, year_ago), F.lit(0.0))
    month = F.month("month")
    columns |= {"calendar_month": month, "quarter": F.quarter("month"), "month_sin": F.sin(month * (2 * math.pi / 12)), "month_cos": F.cos(month * (2 * math.pi / 12))}
    return series.withColumns(columns)


def with_product(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Add the type's code (1 if unknown) and the variation (0.5 if unknown). types: entity, type, cv."""
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])[F.col("type")]
    out = rows.join(types.select("entity", "type", "cv"), "entity", "left")
    return out.withColumns({"type_code": F.coalesce(code, F.lit(1)), "cv": F.coalesce("cv", F.lit(0.5))}).drop("type")


def training_matrix(months: DataFrame, types: DataFrame, least: int = 12, leak_free: bool = True) -> DataFrame:
    """Features of all rows whose lags are known."""
    return with_product(features(filled(months, least), leak_free), types).na.drop(subset=[f"lag_{k}" for k in LAGS])


def future_matrix(months: DataFrame, types: DataFrame, horizon: int, least: int = 12, leak_free: bool = True) -> DataFrame:
    """Features of the `horizon` months after each series, the last value being carried forward; missing lags are 0."""
    series = filled(months, least)
    ends = series.groupBy("entity").agg(F.max("month").alias("hi"), F.max_by("quantity", "month").alias("quantity"))
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ahead = ends.select("entity", "quantity", "hi", step).select("entity", F.add_months("hi", F.col("step")).alias("month"), "quantity", "step")
    rows = features(series.withColumn("step", F.lit(0)).unionByName(ahead), leak_free).where("step > 0")
    return with_product(rows, types).fillna(0, [f"lag_{k}" for k in LAGS])
