"""Row selection by lists and dimensions: exclusions, activity, recommendation filters, and small lists for choices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(df: DataFrame, excluded: DataFrame, level: str = "sku", key: str = "sku") -> DataFrame:
    """Rows not on a list of SKUs: by the SKU itself, its model, or its model and color. key: df's column at that level."""
    width = {"sku": 9, "model": 5, "model_color": 7}[level]
    keys = excluded.where("sku is not null").select(F.substring("sku", 1, width).alias("_key")).distinct()
    return df.join(keys, F.substring(key, 1, width) == F.col("_key"), "left_anti")


def active_only(df: DataFrame, stock: DataFrame) -> DataFrame:
    return df.join(stock.where("is_active").select("sku").distinct(), "sku", "left_semi")


def order_candidates(rows: DataFrame, orders: DataFrame | None = None, meta: DataFrame | None = None, facilities: list[str] | None = None,
                     not_facilities: list[str] | None = None, materials: list[str] | None = None) -> DataFrame:
    """Models without active orders, of given facilities and materials. meta: model, facility, material; excluded facilities keep unknown ones."""
    if orders is not None:
        rows = rows.join(orders.where("status = 'active'").select("model").distinct(), "model", "left_anti")
    if meta is not None:
        rows = rows.drop("facility", "material").join(meta.select("model", F.trim("facility").alias("facility"), F.trim("material").alias("material")), "model", "left")
        if facilities:
            rows = rows.where(F.col("facility").isin(facilities))
        if not_facilities:
            rows = rows.where(~F.coalesce(F.col("facility").isin(not_facilities), F.lit(False)))
        if materials:
            rows = rows.where(F.col("material").isin(materials))
    return rows


def until_month(months: DataFrame, cutoff: date) -> DataFrame:
    return months.where(F.col("month") <= F.lit(cutoff.replace(day=1)))


def in_period(sales: DataFrame, start: date, end: date) -> DataFrame:
    """Sales from the start of start's month to end."""
    return sales.where(F.col("sale_date").between(F.lit(start.replace(day=1)), F.lit(end)))


def valid_sales(sales: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Valid sales (is_valid, where sales have it) from start to end, both open where None. Whoever writes or shows them puts them in order."""
    rows = sales.where("is_valid") if "is_valid" in sales.columns else sales
    if start is not None:
        rows = rows.where(F.col("sale_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("sale_date") <= F.lit(end))
    return rows


def exclusion_view(stock: DataFrame, excluded: DataFrame, search: str | None = None) -> DataFrame:
    """Stock's SKUs and excluded ones that stock lacks, flagged, excluded first."""
    own = stock.groupBy("sku").agg(F.min("product_name").alias("product_name"))
    out = own.join(excluded.select("sku").distinct().withColumn("excluded", F.lit(True)), "sku", "full").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    if search:
        out = out.where(F.upper("sku").contains(search.upper()) | F.upper(F.coalesce("product_name", F.lit(""))).contains(search.upper()))
    return out.orderBy(F.desc("excluded"), "sku")


def exclusion_list(df: DataFrame) -> DataFrame:
    """The list as it is stored: distinct SKUs in order."""
    return df.select("sku").where("sku is not null").distinct().orderBy("sku")


def choices(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-empty trimmed values of some columns, in order."""
    values = df.select(F.explode(F.array(*[F.trim(F.col(c)) for c in columns])).alias("value"))
    return values.where("value <> ''").distinct().orderBy("value")


def reversed_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("alias").alias("code"), F.col("code").alias("alias"))


def alias_subset(aliases: DataFrame, patterns: DataFrame) -> DataFrame:
    """The aliases (code, alias) of the size names that a pattern set (size) uses, in order."""
    return aliases.join(patterns.select(F.col("size").alias("alias")).distinct(), "alias", "left_semi").select("code", "alias").orderBy("code")


def date_range(sales: DataFrame) -> DataFrame:
    return sales.agg(F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"))


def projection_candidates(summary: DataFrame, forecast: DataFrame) -> DataFrame:
    """Entities with stock and a reorder point that the forecast knows, in order. forecast: entity."""
    rows = summary.where("stock is not null and rop is not null").join(forecast.select("entity").distinct(), "entity", "left_semi")
    return rows.select("entity").orderBy("entity")


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Columns that a missing feed leaves out, as constants."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
