"""Feeds derived from the driver's tables, for queries and tests: the same definitions as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 15)
PREFIXES = ("CH", "DO", "JU", "NI", "DZ")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bn, model: one row a brand (25)."""
    bn = F.expr("cast(substring(p_brand, 7, 10) as int)")
    prefix = F.get(F.array(*map(F.lit, PREFIXES)), F.col("bn") % 5)
    return _table(spark, sf_dir, "part").select(bn.alias("bn")).distinct().withColumn("model", F.concat(prefix, F.lpad(F.col("bn").cast("string"), 3, "0")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.expr("cast(substring(p_brand, 7, 10) as int)").alias("bn"))
    rows = _table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    prefix = F.get(F.array(*map(F.lit, PREFIXES)), F.col("bn") % 5)
    month = F.month("l_shipdate")
    burst = F.when(month >= 11, F.col("l_quantity") * 12).when(month.between(5, 9), F.lit(1.0)).otherwise(F.col("l_quantity"))
    rows = rows.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.concat(prefix, F.lpad(F.col("bn").cast("string"), 3, "0")).alias("model"),
        _two(F.col("l_suppkey") % 10).alias("color"),
        _two(F.col("l_linenumber")).alias("size"),
        F.floor(F.when(F.col("bn") % 8 == 1, burst).otherwise(F.col("l_quantity"))).cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("total_amount"),
        "bn",
    ).withColumn("sku", F.concat("model", "color", "size"))
    new = (F.col("bn") % 8 == 0) & (F.col("sale_date") < "2001-07-01") | (F.col("bn") % 8 == 7) & (F.col("sale_date") < "2001-02-01")
    return rows.where(~new)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).where(F.col("sale_date") < F.lit(AS_OF))


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("sku", "model", "color", "size", "bn").distinct()


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({"c": F.col("color").cast("int"), "s": F.col("size").cast("int")})


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(skus(spark, sf_dir)).withColumn("wk", F.explode(F.sequence(F.lit(0), F.lit(12))))
    held = F.greatest(F.lit(0), (F.col("bn") * 5 + F.col("c") * 7 + F.col("s") * 13 + F.col("wk") * 17) % 60 - 12)
    rows = rows.where(~((F.col("bn") % 11 == 3) & (F.col("wk") == 0)))
    return rows.select(
        "sku", "model", "color", "size", F.date_sub(F.to_date(F.lit("2001-08-13")), F.col("wk") * 7).alias("snapshot_date"), held.alias("available_stock"),
        (10.0 + F.col("bn")).alias("net_price"), F.concat(F.lit("item "), "model").alias("product_name"), F.lit(True).alias("is_active"),
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(skus(spark, sf_dir)).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    value = (F.col("bn") * 3 + F.col("c") * 5 + F.col("s") * 11 + F.col("m") * 7 + F.col("v") * 9) % 40
    made = F.to_date(F.when(F.col("v") == 0, "2001-03-01").otherwise("2001-08-01"))
    return rows.select("sku", "model", "color", "size", F.add_months(F.to_date(F.lit("2001-04-01")), F.col("m")).alias("forecast_date"), value.alias("forecast"), made.alias("generated_date"))


def forecast_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(skus(spark, sf_dir)).withColumn("dd", F.explode(F.sequence(F.lit(0), F.lit(75))))
    value = (F.col("bn") * 3 + F.col("c") * 5 + F.col("dd") * 7) % 6
    return rows.select("sku", "model", "color", "size", F.date_add(F.to_date(F.lit("2001-05-16")), F.col("dd")).alias("forecast_date"), value.alias("forecast"), F.to_date(F.lit("2001-01-15")).alias("generated_date"))


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("bn") % 5
    grupa = F.when(k == 0, "G1").when(k == 1, "G2").otherwise("G3")
    rows = models(spark, sf_dir).where("bn % 10 <> 0")
    return rows.select("model", grupa.alias("grupa"), F.concat(F.lit("P"), k).alias("podgrupa"), F.concat(F.lit("K"), F.col("bn") % 4).alias("kategoria"), F.concat(F.lit("item "), "model").alias("nazwa"))


def bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bn")
    return models(spark, sf_dir).where("bn % 9 <> 0").select(
        "model", F.concat(F.lit("fabric"), b % 6).alias("main_material_name"), (1.0 + (b % 7) / 10.0).alias("main_m"), ((b % 5) / 10.0).alias("main_kg"),
        F.when(b % 4 == 0, "2x1").when(b % 4 == 1, "1x1").alias("ribbing_type"), ((b % 3) / 10.0).alias("ribbing_m"), ((b % 2) * 0.5).alias("lining_m"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("bn", (F.col("o_custkey") % 25 + 1).cast("int")).join(models(spark, sf_dir), "bn")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "archived").otherwise("cancelled")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderdate").cast("date").alias("order_date"), "model",
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total_quantity"), F.concat(F.lit("F"), F.substring("o_orderpriority", 1, 1)).alias("facility"), status.alias("status"),
    )


#: The same feeds as common table expressions, by name, with those that each needs.
SQL = {
    "fx_model": """
        select distinct cast(substring(p_brand, 7, 10) as int) as bn,
               ['CH', 'DO', 'JU', 'NI', 'DZ'][cast(substring(p_brand, 7, 10) as int) % 5 + 1] || lpad(substring(p_brand, 7, 10), 3, '0') as model
        from part""",
    "fx_sales": """
        select *, model || color || size as sku from (
            select cast(l_orderkey as varchar) as order_id, cast(l_shipdate as date) as sale_date, m.model,
                   lpad(cast(l_suppkey % 10 as varchar), 2, '0') as color, lpad(cast(l_linenumber as varchar), 2, '0') as size,
                   cast(floor(case when m.bn % 8 = 1 and month(l_shipdate) >= 11 then l_quantity * 12
                                   when m.bn % 8 = 1 and month(l_shipdate) between 5 and 9 then 1 else l_quantity end) as int) as quantity,
                   l_extendedprice / l_quantity as unit_price, l_extendedprice as total_amount, m.bn
            from lineitem join part on l_partkey = p_partkey join fx_model m on m.bn = cast(substring(p_brand, 7, 10) as int))
        where not (bn % 8 = 0 and sale_date < date '2001-07-01') and not (bn % 8 = 7 and sale_date < date '2001-02-01')""",
    "fx_history": "select * from fx_sales where sale_date < date '2001-08-15'",
    "fx_sku": "select distinct sku, model, color, size, bn, cast(color as int) as c, cast(size as int) as s from fx_history",
    "fx_stock": """
        select sku, model, color, size, cast(date '2001-08-13' - cast(7 * wk as int) as date) as snapshot_date,
               greatest(0, (bn * 5 + c * 7 + s * 13 + wk * 17) % 60 - 12) as available_stock, 10.0::double + bn as net_price, 'item ' || model as product_name
        from fx_sku, range(0, 13) w(wk) where not (bn % 11 = 3 and wk = 0)""",
    "fx_forecast": """
        select sku, model, color, size, cast(date '2001-04-01' + to_months(cast(m as int)) as date) as forecast_date,
               (bn * 3 + c * 5 + s * 11 + m * 7 + v * 9) % 40 as forecast, case v when 0 then date '2001-03-01' else date '2001-08-01' end as generated_date
        from fx_sku, range(0, 10) a(m), range(0, 2) b(v)""",
    "fx_daily": """
        select sku, model, color, size, cast(date '2001-05-16' + cast(dd as int) as date) as forecast_date, (bn * 3 + c * 5 + dd * 7) % 6 as forecast
        from fx_sku, range(0, 76) d(dd)""",
    "fx_category": """
        select model, case bn % 5 when 0 then 'G1' when 1 then 'G2' else 'G3' end as grupa, 'P' || bn % 5 as podgrupa, 'K' || bn % 4 as kategoria
        from fx_model where bn % 10 <> 0""",
    "fx_bom": """
        select model, 'fabric' || bn % 6 as main_material_name, 1.0::double + (bn % 7) / 10.0::double as main_m, (bn % 5) / 10.0::double as main_kg,
               case bn % 4 when 0 then '2x1' when 1 then '1x1' end as ribbing_type, (bn % 3) / 10.0::double as ribbing_m, (bn % 2) * 0.5::double as lining_m
        from fx_model where bn % 9 <> 0""",
    "fx_order": """
        select cast(o_orderkey as varchar) as order_id, cast(o_orderdate as date) as order_date, model, cast(floor(o_totalprice / 1000) as int) as total_quantity,
               'F' || substring(o_orderpriority, 1, 1) as facility, case o_orderstatus when 'O' then 'active' when 'F' then 'archived' else 'cancelled' end as status
        from orders join fx_model on bn = o_custkey % 25 + 1""",
    "months_model": """
        select model as entity, date_trunc('month', sale_date)::date as month, sum(quantity) as quantity, min(sale_date) as first_sale,
               sum(quantity) filter (where sale_date >= date '2001-08-15' - 730) as recent
        from fx_history group by all""",
    "months_sku": """
        select sku as entity, date_trunc('month', sale_date)::date as month, sum(quantity) as quantity, min(sale_date) as first_sale,
               sum(quantity) filter (where sale_date >= date '2001-08-15' - 730) as recent
        from fx_history group by all""",
}


def with_fixtures(sql: str) -> str:
    """sql with the feeds before it, as common table expressions."""
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in SQL.items()) + ",\n" + sql
