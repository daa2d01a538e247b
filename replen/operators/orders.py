"""Order shaping by size and color, order tables, and production orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.sku import aliased


def size_history(months: DataFrame, n: int = 4) -> DataFrame:
    """model, color, size, sold in the last n months in which each model-color sold. months: sku-level monthly()."""
    rows = months.withColumns({"model": F.substring("entity", 1, 5), "color": F.substring("entity", 6, 2), "size": F.substring("entity", 8, 2)})
    rank = F.dense_rank().over(Window.partitionBy("model", "color").orderBy(F.desc("month")))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return rows.groupBy("model", "color", "size").agg(F.sum("quantity").alias("sold"))


def size_months(months: DataFrame, n: int = 3) -> DataFrame:
    """model, month, size, quantity over each model's last n months with sales."""
    rows = months.withColumns({"model": F.substring("entity", 1, 5), "size": F.substring("entity", 8, 2)})
    rank = F.dense_rank().over(Window.partitionBy("model").orderBy(F.desc("month")))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n)
    return rows.groupBy("model", "month", "size").agg(F.sum("quantity").alias("quantity"))


def size_scores(scored: DataFrame, aliases: DataFrame) -> DataFrame:
    """model, size name, score: summed priorities over the model's greatest."""
    rows = scored.select(F.substring("entity", 1, 5).alias("model"), F.substring("entity", 8, 2).alias("size"), "score")
    rows = aliased(rows, aliases, "size", "name").groupBy("model", "name").agg(F.sum("score").alias("score"))
    return rows.withColumn("score", F.coalesce(F.try_divide("score", F.max("score").over(Window.partitionBy("model"))), F.lit(0.0)))


def size_distribution(produced: DataFrame) -> DataFrame:
    """Each size's percent of the model's pieces. produced: model, size, produced."""
    rows = produced.groupBy("model", "size").agg(F.sum("produced").alias("produced"))
    total = F.sum("produced").over(Window.partitionBy("model"))
    return rows.withColumn("percent", F.coalesce(F.try_divide(F.col("produced") * 100.0, total), F.lit(0.0)))


def required_and_produced(produced: DataFrame, excluded_sizes: list[str] = ()) -> DataFrame:
    """Both by size for each model, with a TOTAL row over the sizes that are not excluded."""
    rows = produced.groupBy("model", "size").agg(F.sum("required").alias("required"), F.sum("produced").alias("produced"))
    total = rows.where(~F.col("size").isin(list(excluded_sizes))).groupBy("model").agg(F.sum("required").alias("required"), F.sum("produced").alias("produced"))
    return rows.unionByName(total.withColumn("size", F.lit("TOTAL"))).withColumn("excess", F.col("produced") - F.col("required"))


def color_items(scored: DataFrame) -> DataFrame:
    """One order line for each model-color: mean score, deficit, forecast and a size map."""
    rows = scored.withColumns({"model": F.substring("entity", 1, 5), "color": F.substring("entity", 6, 2), "size": F.substring("entity", 8, 2)})
    quantity = F.floor(F.greatest(F.coalesce("deficit", F.lit(0.0)), F.col("forecast").cast("double")))
    sizes = F.map_from_entries(F.sort_array(F.collect_list(F.struct("size", quantity.alias("quantity")))))
    return rows.groupBy("model", "color").agg(F.avg("score").alias("score"), F.sum("deficit").alias("deficit"), F.sum("forecast").alias("forecast"), sizes.alias("sizes"))


def stock_by_color_size(stock: DataFrame, aliases: DataFrame) -> DataFrame:
    rows = aliased(stock, aliases, "size", "name")
    return rows.groupBy("model", "color", "name").agg(F.sum("available_stock").alias("stock"))


def produced_without_stock(produced: DataFrame, stock: DataFrame) -> DataFrame:
    """Color-sizes that are produced and out of stock. stock: model, color, size, stock."""
    return produced.where("produced > 0").join(stock.where("stock = 0"), ["model", "color", "size"]).select("model", "color", "size", "produced")


def order_table(items: DataFrame, months: DataFrame, last: list[date]) -> DataFrame:
    """Order lines with a column of sales for each of some months, named MM-YYYY; the months are given, so no job looks for them."""
    rows = months.withColumns({"model": F.substring("entity", 1, 5), "color": F.substring("entity", 6, 2), "at": F.date_format("month", "MM-yyyy")})
    rows = rows.where(F.col("month").isin(last))
    wide = rows.groupBy("model", "color").pivot("at", [m.strftime("%m-%Y") for m in last]).agg(F.sum("quantity"))
    return items.join(wide, ["model", "color"], "left").fillna(0)


def pairs_text(rows: DataFrame, keys: list[str], name: str, value: str, alias: str) -> DataFrame:
    """`name:value` pairs above 0 of each key, in order, as text."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value) > 0, F.struct(F.col(name).alias("k"), F.col(value).alias("v")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["k"], x["v"])), ", ").alias(alias))


def processing_time(start: Column, end: Column) -> Column:
    """Whole days, else hours, else <1h; blank if it is missing or negative."""
    minutes = F.timestamp_diff("MINUTE", start, end)
    return (
        F.when(minutes.isNull() | (minutes < 0), "")
        .when(minutes >= 1440, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .otherwise("<1h")
    )


def active_orders(orders: DataFrame) -> DataFrame:
    return orders.where("status = 'active'").orderBy(F.desc("order_date"), "order_id")


def archived_orders(orders: DataFrame) -> DataFrame:
    """Newest first by archiving, else by the last change."""
    return orders.where("status = 'archived'").orderBy(F.desc(F.coalesce("archived_at", "updated_at")), "order_id")


def archive(orders: DataFrame, ids: DataFrame, at) -> DataFrame:
    """orders with those of ids (order_id) archived at a time."""
    flag = ids.select("order_id").distinct().withColumn("_done", F.lit(True))
    rows = orders.join(flag, "order_id", "left")
    done = F.coalesce("_done", F.lit(False))
    return rows.withColumns({"status": F.when(done, "archived").otherwise(F.col("status")), "archived_at": F.when(done, F.lit(at)).otherwise(F.col("archived_at"))}).drop("_done")


def manual_order(rows: DataFrame, at) -> DataFrame:
    """Orders entered by hand, with the defaults of the others."""
    defaults = {"status": F.lit("active"), "facility": F.lit(None).cast("string"), "operation": F.lit(None).cast("string"), "material": F.lit(None).cast("string")}
    return rows.withColumns({**{c: v for c, v in defaults.items() if c not in rows.columns}, "created_at": F.lit(at), "archived_at": F.lit(None).cast("timestamp")})
