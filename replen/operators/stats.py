"""Demand statistics of entities (sku or model) and the classes that follow from them."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.calendar import add_months, month
from replen.functions.sku import age_category
from replen.plans.settings import Settings


def before(sales: DataFrame, as_of: date) -> DataFrame:
    return sales.where(F.col("sale_date") < F.lit(as_of))


def monthly(sales: DataFrame, entity: str, as_of: date | None = None, s: Settings = Settings()) -> DataFrame:
    """entity, month, quantity and the first sale in it: the aggregate that most statistics share.

    With as_of also recent: the quantity of the last recent_days alone (null without sales in them).
    """
    recent = F.lit(None).cast("long") if as_of is None else F.when(F.col("sale_date") >= F.lit(as_of - timedelta(days=s.recent_days)), F.col("quantity"))
    return sales.groupBy(F.col(entity).alias("entity"), month(F.col("sale_date")).alias("month")).agg(
        F.sum("quantity").alias("quantity"), F.min("sale_date").alias("first_sale"), F.sum(recent).alias("recent")
    )


def entity_stats(months: DataFrame) -> DataFrame:
    """Months with sales, total, mean, sample deviation (null for one month), variation and first sale of each entity.

    Months without sales are not counted as 0.
    """
    stats = months.groupBy("entity").agg(
        F.count("*").alias("n_months"),
        F.sum("quantity").alias("quantity"),
        F.avg("quantity").alias("average"),
        F.stddev_samp("quantity").alias("sd"),
        F.min("first_sale").alias("first_sale"),
    )
    return stats.withColumn("cv", F.coalesce(F.try_divide("sd", "average"), F.lit(0.0)))


def profile(months: DataFrame, as_of: date, s: Settings = Settings()) -> DataFrame:
    """entity_stats(), recent_average and in_season (of as_of's month, see seasonal_index()) from one grouping of monthly()."""
    means = [F.avg(F.when(F.month("month") == k, F.col("recent"))).alias(f"_m{k}") for k in range(1, 13)]
    rows = months.groupBy("entity").agg(
        F.count("*").alias("n_months"),
        F.sum("quantity").alias("quantity"),
        F.avg("quantity").alias("average"),
        F.stddev_samp("quantity").alias("sd"),
        F.min("first_sale").alias("first_sale"),
        F.avg("recent").alias("recent_average"),
        *means,
    )
    known = F.array_compact(F.array(*[f"_m{k}" for k in range(1, 13)]))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    rows = rows.withColumn("in_season", F.coalesce(F.try_divide(F.col(f"_m{as_of.month}"), mean) > s.in_season, F.lit(False)))
    return rows.withColumn("cv", F.coalesce(F.try_divide("sd", "average"), F.lit(0.0))).drop(*[f"_m{k}" for k in range(1, 13)])


def product_type(as_of: date, s: Settings) -> Column:
    """new, basic, seasonal or regular from first_sale and cv."""
    return (
        F.when(F.col("first_sale") > F.lit(as_of - timedelta(days=s.new_days)), "new")
        .when(F.col("cv") < s.cv_basic, "basic")
        .when(F.col("cv") > s.cv_seasonal, "seasonal")
        .otherwise("regular")
    )


def classify(stats: DataFrame, as_of: date, s: Settings = Settings()) -> DataFrame:
    return stats.withColumn("type", product_type(as_of, s))


def seasonal_index(months: DataFrame, s: Settings = Settings()) -> DataFrame:
    """entity, calendar_month, mean, index (mean over the mean of means) and in_season, from monthly()'s recent quantities."""
    recent = months.where("recent is not null")
    means = recent.groupBy("entity", F.month("month").alias("calendar_month")).agg(F.avg("recent").alias("mean"))
    index = F.coalesce(F.try_divide(F.col("mean"), F.avg("mean").over(Window.partitionBy("entity"))), F.lit(0.0))
    return means.withColumn("index", index).withColumn("in_season", F.col("index") > s.in_season)


def safety_stock(stats: DataFrame, season: DataFrame, as_of: date, s: Settings = Settings()) -> DataFrame:
    """Add safety_stock and rop, also for both seasons; without a deviation they are null.

    Seasonal entities take the factor of the season that as_of's month is for them (out, if unknown).
    """
    now = season.where((F.col("calendar_month") == as_of.month) & F.col("in_season")).select("entity", F.lit(True).alias("in_season"))
    return with_safety_stock(stats.join(now, "entity", "left"), s)


def with_safety_stock(stats: DataFrame, s: Settings = Settings()) -> DataFrame:
    """safety_stock() for rows that know whether they are in_season."""
    kind, root = F.col("type"), math.sqrt(s.lead_time)
    in_season = F.coalesce("in_season", F.lit(False))
    fixed = F.when(kind == "basic", s.z_basic).when(kind == "new", s.z_new).when(kind == "regular", s.z_regular)
    z = {
        "": F.coalesce(fixed, F.when(in_season, s.z_seasonal_in).otherwise(s.z_seasonal_out)),
        "_in": F.coalesce(fixed, F.lit(s.z_seasonal_in)),
        "_out": F.coalesce(fixed, F.lit(s.z_seasonal_out)),
    }
    out = stats.withColumns({f"safety_stock{k}": v * F.col("sd") * root for k, v in z.items()})
    out = out.withColumns({f"rop{k}": F.col("average") * s.lead_time + F.col(f"safety_stock{k}") for k in z})
    return out.withColumn("in_season", in_season)


def recent_average(months: DataFrame) -> DataFrame:
    """entity, recent_average: the mean of monthly()'s recent quantities."""
    return months.where("recent is not null").groupBy("entity").agg(F.avg("recent").alias("recent_average"))


def monthly_aggregation(sales: DataFrame) -> DataFrame:
    """Quantity, revenue, transactions, orders and mean price for each sku and for each model by month, in one pass of grouping sets."""
    rows = sales.withColumn("month", month(F.col("sale_date")))
    both = rows.groupingSets([[F.col("sku"), F.col("month")], [F.col("model"), F.col("month")]], "sku", "model", "month").agg(
        F.grouping("sku").alias("by_model"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("total_amount").alias("total_revenue"),
        F.count("*").alias("transaction_count"),
        F.count_distinct("order_id").alias("unique_orders"),
        F.avg("unit_price").alias("avg_unit_price"),
    )
    by_model = F.col("by_model") == 1
    return both.select(
        F.when(by_model, "model").otherwise("sku").alias("entity_type"),
        F.when(by_model, F.col("model")).otherwise(F.col("sku")).alias("entity_id"),
        "month", "total_quantity", "total_revenue", "transaction_count", "unique_orders", "avg_unit_price",
    )


def yearly_sales(sales: DataFrame, keys: list[str]) -> DataFrame:
    return sales.groupBy(*keys, F.year("sale_date").alias("year")).agg(F.sum("quantity").alias("quantity"))


def yearly_forecast(forecast: DataFrame, keys: list[str], as_of: date) -> DataFrame:
    """Forecast totals by year from the start of as_of's month on."""
    rows = forecast.where(F.col("forecast_date") >= F.lit(as_of.replace(day=1)))
    return rows.groupBy(*keys, F.year("forecast_date").alias("year")).agg(F.sum("forecast").alias("forecast"))


def period_sales(months: DataFrame, lead_time: float, force_seasonal: bool = False) -> DataFrame:
    """entity, period_sales over ceil(lead_time) of the table's distinct months.

    Children's entities take the newest months; adults' (all, if force_seasonal) the same months of last
    year, ranks 13 - n to 12 from the newest, given more than 12 months. Ranks are worked out on the
    distinct months, of which there are few; the bounds come back as one row.
    """
    n = math.ceil(lead_time)
    ranked = months.select("month").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc("month"))))
    pick = lambda lo, hi: F.collect_list(F.when(F.col("rank").between(lo, hi), F.col("month")))
    few = ranked.where(F.col("rank") <= max(n, 13)).agg(pick(1, n).alias("newest"), pick(13 - n, 12).alias("last_year"), F.max("rank").alias("known"))
    rows = months.crossJoin(F.broadcast(few))  # one row
    adult = F.lit(True) if force_seasonal else age_category(F.col("entity")) == "adult"
    child = F.lit(False) if force_seasonal else age_category(F.col("entity")) == "children"
    taken = (child & F.array_contains("newest", F.col("month"))) | (adult & (F.col("known") > 12) & F.array_contains("last_year", F.col("month")))
    return rows.where(taken).groupBy("entity").agg(F.sum("quantity").alias("period_sales"))


def new_models(sales: DataFrame, as_of: date, s: Settings = Settings()) -> DataFrame:
    first = sales.groupBy("model").agg(F.min("sale_date").alias("first_sale"))
    return first.where(F.col("first_sale") > F.lit(as_of - timedelta(days=s.new_days)))


def forecast_window(as_of: date, lead_time: float) -> tuple[date, date]:
    """First of the next month (as_of itself on a first) and int(lead_time) months later, end exclusive."""
    start = as_of if as_of.day == 1 else add_months(as_of, 1)
    return start, add_months(start, int(lead_time))


def forecast_in_lead_time(forecast: DataFrame, entity: str, as_of: date, lead_time: float) -> DataFrame:
    start, end = forecast_window(as_of, lead_time)
    rows = forecast.where((F.col("forecast_date") >= F.lit(start)) & (F.col("forecast_date") < F.lit(end)))
    return rows.groupBy(F.col(entity).alias("entity")).agg(F.sum("forecast").alias("forecast"))


def volume_ranking(months: DataFrame, n: int, prefix: str | None = None) -> DataFrame:
    rows = months if prefix is None else months.where(F.col("entity").startswith(prefix))
    return rows.groupBy("entity").agg(F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"), "entity").limit(n)
