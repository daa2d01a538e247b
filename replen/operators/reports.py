"""Sales reports. Two periods are compared in one pass of conditional sums instead of a join of two aggregates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.calendar import add_months, last_whole_week, week_start, year_to_last_month
from replen.functions.change import percent_change, yearly_change
from replen.plans.settings import Settings

WEDNESDAY = 2


def _between(day: str, span: tuple[date, date]) -> Column:
    return F.col(day).between(F.lit(span[0]), F.lit(span[1]))


def _two_periods(sales: DataFrame, keys: list[str], now: tuple[date, date], prior: tuple[date, date]) -> DataFrame:
    """keys, current, prior over two spans; only days of either are read."""
    rows = sales.where(_between("sale_date", now) | _between("sale_date", prior))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(_between("sale_date", now), F.col("quantity"))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(_between("sale_date", prior), F.col("quantity"))), F.lit(0)).alias("prior"),
    )


def weekly_new_products(sales: DataFrame, stock: DataFrame, as_of: date, s: Settings = Settings()) -> DataFrame:
    """model, week (Wednesday), quantity, product_name of models first sold in the last lookback_days.

    Sales count within lookback_days of the first one; the grid from each model's first week to the
    end of its span (as_of at the latest) is filled with zeros.
    """
    first = sales.groupBy("model").agg(F.min("sale_date").alias("first_sale"))
    new = first.where(_between("first_sale", (as_of - timedelta(days=s.lookback_days), as_of)))
    end = F.least(F.date_add("first_sale", s.lookback_days), F.lit(as_of))
    weeks = F.sequence(week_start(F.col("first_sale"), WEDNESDAY), week_start(end, WEDNESDAY), F.expr("interval 7 days"))
    grid = new.select("model", F.explode(weeks).alias("week"))
    sold = sales.join(new, "model").where(F.col("sale_date") <= end).groupBy("model", week_start(F.col("sale_date"), WEDNESDAY).alias("week"))
    names = stock.groupBy("model").agg(F.min("product_name").alias("product_name"))
    rows = grid.join(sold.agg(F.sum("quantity").alias("quantity")), ["model", "week"], "left").join(names, "model", "left")
    return rows.select("model", "week", F.coalesce("quantity", F.lit(0)).alias("quantity"), "product_name")


def weekly_wide(long: DataFrame, weeks: list[date]) -> DataFrame:
    """One column a week; the weeks are given, so no extra job finds them."""
    return long.groupBy("model", "product_name").pivot("week", weeks).agg(F.sum("quantity"))


def weekly_kpis(long: DataFrame) -> DataFrame:
    per = long.groupBy("model").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n_weeks"))
    return per.agg(
        F.count("*").alias("n_models"), F.max("n_weeks").alias("n_weeks"), F.sum("quantity").alias("total"), F.count_if(F.col("quantity") == 0).alias("n_without_sales")
    )


def stars(sales: DataFrame, as_of: date) -> DataFrame:
    """The models with the largest rise and the largest fall of the last whole week against that 364 days before."""
    now = last_whole_week(as_of)
    prior = tuple(d - timedelta(days=364) for d in now)
    rows = _two_periods(sales, ["model"], now, prior).withColumn("difference", F.col("current") - F.col("prior"))
    rows = rows.withColumn("change", percent_change(F.col("current"), F.col("prior")))
    row = F.struct("model", "current", "prior", "difference", "change")
    rising = F.min_by(row, F.struct(-F.col("difference"), "model"))
    falling = F.min_by(row, F.struct("difference", "model"))
    both = rows.agg(rising.alias("rising"), falling.alias("falling"))
    pair = F.expr("stack(2, 'rising', rising, 'falling', falling) as (star, row)")
    return both.select(pair).where("row is not null").select("star", "row.*")


def top_by_type(sales: DataFrame, types: DataFrame, as_of: date, n: int = 5) -> DataFrame:
    """The n best model-colors of each product type in the last whole week. types: entity (model), type."""
    week = sales.where(_between("sale_date", last_whole_week(as_of))).groupBy("model", "color").agg(F.sum("quantity").alias("quantity"))
    rows = week.join(types.select(F.col("entity").alias("model"), "type"), "model")
    best = Window.partitionBy("type").orderBy(F.desc("quantity"), "model", "color")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def with_descriptions(rows: DataFrame, stock: DataFrame) -> DataFrame:
    """Add the product's name by model and color, null if stock has none."""
    names = stock.groupBy("model", "color").agg(F.min("product_name").alias("product_name"))
    return rows.join(names, ["model", "color"], "left")


def yoy_by_category(sales: DataFrame, category: DataFrame, as_of: date) -> DataFrame:
    """Year to the last complete month against the year before, by podgrupa and kategoria and by podgrupa (level 0 and 1).

    Both levels come from one grouping. Models without a category form a null group in the detail; the summary leaves it out.
    """
    now, prior = year_to_last_month(as_of)
    rows = _two_periods(sales, ["model"], now, prior).join(category.select("model", "podgrupa", "kategoria"), "model", "left")
    out = rows.groupingSets([[F.col("podgrupa"), F.col("kategoria")], [F.col("podgrupa")]], "podgrupa", "kategoria").agg(
        F.grouping("kategoria").cast("int").alias("level"), F.sum("current").alias("current"), F.sum("prior").alias("prior")
    )
    out = out.where("level = 0 or podgrupa is not null")
    return out.withColumns({"difference": F.col("current") - F.col("prior"), "change": percent_change(F.col("current"), F.col("prior"))})


def yoy_by_color(sales: DataFrame, as_of: date) -> DataFrame:
    """The same by color (level 1) and by color and model (level 0)."""
    now, prior = year_to_last_month(as_of)
    rows = _two_periods(sales, ["color", "model"], now, prior)
    out = rows.groupingSets([[F.col("color"), F.col("model")], [F.col("color")]], "color", "model").agg(
        F.grouping("model").cast("int").alias("level"), F.sum("current").alias("current"), F.sum("prior").alias("prior")
    )
    return out.withColumns({"difference": F.col("current") - F.col("prior"), "change": percent_change(F.col("current"), F.col("prior"))})


def yoy_kpis(sales: DataFrame, category: DataFrame, as_of: date) -> DataFrame:
    """Totals, overall change, rising and falling podgrupas, and what has no category."""
    rows = yoy_by_category(sales, category, as_of)
    total = rows.where("level = 1").agg(
        F.sum("current").alias("current"), F.sum("prior").alias("prior"),
        F.count_if(F.col("current") > F.col("prior")).alias("n_rising"), F.count_if(F.col("current") < F.col("prior")).alias("n_falling"),
    )
    total = total.withColumn("change", F.when(F.col("prior") > 0, (F.col("current") - F.col("prior")) / F.col("prior") * 100).otherwise(999.0))
    now, _ = year_to_last_month(as_of)
    bare = sales.where(_between("sale_date", now)).join(category.select("model"), "model", "left_anti")
    return total.crossJoin(bare.agg(F.count_distinct("model").alias("uncategorised_models"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("uncategorised_sales")))


def color_months(months: DataFrame, model: str, n: int = 4) -> DataFrame:
    """color, month, quantity of a model over the last n months of the whole table, filled with zeros.

    months: sku-level monthly(). The months come from a distinct of which n rows are kept.
    """
    last = F.broadcast(months.select("month").distinct().orderBy(F.desc("month")).limit(n))
    own = months.where(F.col("entity").startswith(model)).withColumn("color", F.substring("entity", 6, 2))
    grid = own.select("color").distinct().crossJoin(last)
    sold = own.groupBy("color", "month").agg(F.sum("quantity").alias("quantity"))
    return grid.join(sold, ["color", "month"], "left").select("color", "month", F.coalesce("quantity", F.lit(0)).alias("quantity"))


def worst_models(sales: DataFrame, meta: DataFrame, as_of: date, n: int = 20, exclude: DataFrame | None = None,
                 materials: list[str] | None = None, colors: list[str] | None = None) -> DataFrame:
    """The n model-colors with the least sales a month with sales, over the last 12 months. meta: model, material_type.

    materials and colors filter the n rows that were found.
    """
    rows = sales.where((F.col("sale_date") >= F.lit(add_months(as_of, -12).replace(day=1))) & (F.col("sale_date") <= F.lit(as_of)))
    if exclude is not None:
        rows = rows.join(exclude.select("model"), "model", "left_anti")
    per = rows.groupBy("model", "color").agg(F.sum("quantity").alias("quantity"), F.count_distinct(F.trunc("sale_date", "month")).alias("n_months"))
    per = per.withColumn("per_month", F.col("quantity") / F.col("n_months"))
    out = per.orderBy("per_month", "model", "color").limit(n).join(meta.select("model", "material_type"), "model", "left")
    if materials:
        out = out.where(F.col("material_type").isin(materials))
    return out.where(F.col("color").isin(colors)) if colors else out


def worst_rotating(sales: DataFrame, as_of: date, n: int = 20) -> DataFrame:
    """The n models with the least sales a month since their first sale."""
    per = sales.groupBy("model").agg(F.sum("quantity").alias("quantity"), F.min("sale_date").alias("first_sale"))
    age = F.datediff(F.lit(as_of), "first_sale") / 30.44
    per = per.withColumn("n_months", age).where("n_months > 0 and quantity > 0").withColumn("per_month", F.col("quantity") / F.col("n_months"))
    return per.orderBy("per_month", "model").limit(n)


def yearly_summary(yearly: DataFrame, forecast: DataFrame, as_of: date) -> DataFrame:
    """The last three years side by side, their change, and all forecast to come. yearly, forecast: model, year, quantity / forecast."""
    y = as_of.year
    at = lambda k: F.coalesce(F.sum(F.when(F.col("year") == y - k, F.col("quantity"))), F.lit(0))
    wide = yearly.where(F.col("year") >= y - 2).groupBy("model").agg(at(2).alias("two_years_ago"), at(1).alias("last_year"), at(0).alias("this_year"))
    ahead = forecast.groupBy("model").agg(F.sum("forecast").alias("forecast"))
    out = wide.join(ahead, "model", "left").withColumn("forecast", F.coalesce("forecast", F.lit(0)))
    return out.withColumn("change", yearly_change(F.col("last_year"), F.col("two_years_ago")))


def yearly_trend(yearly: DataFrame, forecast: DataFrame, as_of: date) -> DataFrame:
    """model, year, kind (actual or forecast), quantity; forecasts from this year on."""
    actual = yearly.select("model", "year", F.lit("actual").alias("kind"), F.col("quantity").cast("double").alias("quantity"))
    ahead = forecast.where(F.col("year") >= as_of.year).select("model", "year", F.lit("forecast").alias("kind"), F.col("forecast").cast("double").alias("quantity"))
    return actual.unionByName(ahead)


def trend_kpis(yearly: DataFrame, forecast: DataFrame, as_of: date) -> DataFrame:
    """First year, years with sales, total, forecast, and the change of the last two complete years that follow each other."""
    before = Window.partitionBy("model").orderBy("year")
    rows = yearly.withColumns({"prior": F.lag("quantity").over(before), "prior_year": F.lag("year").over(before)})
    pair = F.when((F.col("year") < as_of.year) & (F.col("prior_year") == F.col("year") - 1), yearly_change(F.col("quantity"), F.col("prior")))
    out = rows.groupBy("model").agg(
        F.min("year").alias("first_year"), F.count("*").alias("n_years"), F.sum("quantity").alias("quantity"),
        F.max_by(pair, F.when(F.col("year") < as_of.year, F.col("year"))).alias("change"),
    )
    ahead = forecast.groupBy("model").agg(F.sum("forecast").alias("forecast"))
    return out.join(ahead, "model", "left").withColumn("forecast", F.coalesce("forecast", F.lit(0)))
