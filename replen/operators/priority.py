"""Order priorities and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replen.functions.sku import age_category
from replen.plans.settings import Settings

NEEDED = ("entity", "stock", "rop", "type")


def prioritise(positioned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Add the stock-out risk, revenue impact, score and urgency of each entity.

    positioned: entity, type, stock, price, rop, deficit, forecast. The impact is relative to the greatest revenue at risk,
    a one-row aggregate that is broadcast, and 0 where none is; only without a column price does the forecast stand for the revenue.
    """
    if missing := [c for c in NEEDED if c not in positioned.columns]:
        raise ValueError(f"missing columns: {missing}")
    rows = positioned.withColumn("forecast", F.coalesce("forecast", F.lit(0)))
    stock, rop, forecast = F.col("stock"), F.col("rop"), F.col("forecast")
    risk = F.when((stock <= 0) & (forecast > 0), s.risk_out).when((stock > 0) & (stock < rop), (rop - stock) / rop * s.risk_below)
    revenue = forecast * F.col("price") if "price" in rows.columns else forecast
    rows = rows.withColumns({"risk": F.coalesce(risk, F.lit(0.0)), "revenue_at_risk": revenue})
    # The maximum carries every column: were columns pruned here, the rows would be worked out twice instead of their exchanges being reused.
    top = F.max(F.struct(F.col("revenue_at_risk").alias("_top"), *[x for x in rows.columns if x != "revenue_at_risk"]))["_top"]
    most = rows.agg(top.alias("_revenue"))
    share = F.when(F.col("_revenue") > 0, F.col("revenue_at_risk") / F.col("_revenue"))
    multiplier = F.coalesce(F.create_map(*[F.lit(x) for kv in s.multipliers.items() for x in kv])[F.col("type")], F.lit(1.0))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("impact", F.coalesce(share, F.lit(0.0)) * 100)
    score = F.col("risk") * s.weight_risk + F.col("impact") * s.weight_revenue + F.least(forecast, F.lit(s.demand_cap)) * s.weight_demand
    return rows.withColumns({"score": score * multiplier, "urgent": (stock <= 0) & (forecast > 0)}).drop("_revenue")


def by_model_color(scored: DataFrame, *more) -> DataFrame:
    """Roll SKU priorities up to model and color. more: further aggregates, over rows that also have model, color, size and quantity."""
    rows = scored.withColumns({"model": F.substring("entity", 1, 5), "color": F.substring("entity", 6, 2), "size": F.substring("entity", 8, 2), "quantity": _to_order()})
    out = rows.groupBy("model", "color").agg(
        F.avg("score").alias("score"),
        F.sum("deficit").alias("deficit"),
        F.sum("forecast").alias("forecast"),
        F.sum("stock").alias("stock"),
        F.sum("rop").alias("rop"),
        F.sum("safety_stock").alias("safety_stock"),
        F.sum("revenue_at_risk").alias("revenue_at_risk"),
        F.bool_or("urgent").alias("urgent"),
        *more,
    )
    return out.withColumn("coverage_gap", F.greatest(F.lit(0), F.col("forecast") - F.col("stock")))


def _to_order() -> Column:
    """The whole part of the larger of deficit and forecast."""
    return F.floor(F.greatest(F.coalesce("deficit", F.lit(0.0)), F.col("forecast").cast("double")))


def size_quantities(scored: DataFrame) -> DataFrame:
    """model, color, size, quantity to order: the whole part of the larger of deficit and forecast."""
    return scored.select(
        F.substring("entity", 1, 5).alias("model"),
        F.substring("entity", 6, 2).alias("color"),
        F.substring("entity", 8, 2).alias("size"),
        _to_order().alias("quantity"),
    )


def recommend(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n model-colors of the highest mean score, each with its sizes as text `size:quantity`, in order."""
    pairs = F.sort_array(F.collect_list(F.struct("size", "quantity"))).alias("sizes")  # a model-color has some sizes
    top = by_model_color(scored, pairs).orderBy(F.desc("score"), "model", "color").limit(n)
    return top.withColumn("sizes", F.array_join(F.transform("sizes", lambda x: F.concat_ws(":", x["size"], x["quantity"])), ", "))


def urgent_colors(rolled: DataFrame, model: str) -> DataFrame:
    return rolled.where((F.col("model") == model) & F.col("urgent")).select("color", "score", "deficit")


def order_quantity(rows: DataFrame, with_safety: bool = True, seasonal: bool = False) -> DataFrame:
    """Pieces to order of each SKU: demand and safety stock less stock, none without demand.

    Demand is period_sales, or if seasonal the larger of it and forecast.
    """
    demand = F.greatest("period_sales", "forecast") if seasonal else F.col("period_sales")
    extra = F.coalesce("safety_stock", F.lit(0.0)) if with_safety else F.lit(0.0)
    return rows.withColumn("order_quantity", F.when(F.coalesce(demand, F.lit(0)) > 0, F.greatest(F.lit(0.0), demand + extra - F.col("stock"))).otherwise(0.0))


def forecast_for_new_adults(rows: DataFrame) -> DataFrame:
    """New adult products without period sales take the whole part of their forecast instead."""
    new = (F.col("type") == "new") & (age_category(F.col("entity")) == "adult") & (F.coalesce("period_sales", F.lit(0)) == 0) & (F.col("forecast") > 0)
    return rows.withColumn("period_sales", F.when(new, F.floor("forecast")).otherwise(F.col("period_sales")))
