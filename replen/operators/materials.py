"""Materials: explosion of bills of material, gaps against stock, and constraints from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.functions.change import banded

#: Use of a facility's capacity in percent, up to which it has a status.
LOAD_BANDS = [(75.0, "free"), (100.0, "normal"), (150.0, "busy"), (200.0, "full"), (250.0, "over"), (300.0, "far over")]


def production_quantities(orders: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """model, quantity of orders (model, total_quantity) and manual entries of the same columns; models are trimmed and upper-cased."""
    rows = orders.select("model", "total_quantity")
    if manual is not None:
        rows = rows.unionByName(manual.select("model", "total_quantity"))
    rows = rows.withColumn("model", F.upper(F.trim("model"))).where("model <> '' and total_quantity > 0")
    return rows.groupBy("model").agg(F.sum("total_quantity").alias("quantity"))


def explode_bom(quantities: DataFrame, bom: DataFrame) -> DataFrame:
    """model, material, kind, meters, kg of every material that a model's pieces use; no use, no row.

    Catalyst chooses how to join the bill of material, which has one row a model.
    """
    q = F.col("quantity")
    use = lambda kind, name, m, kg: F.struct(F.lit(kind).alias("kind"), name.alias("material"), m.cast("double").alias("m"), kg.cast("double").alias("kg"))
    none = F.lit(0.0)
    parts = F.array(
        use("main", F.col("main_material_name"), F.coalesce("main_m", none), F.coalesce("main_kg", none)),
        use("ribbing", F.concat(F.lit("ribbing "), F.col("ribbing_type")), F.coalesce("ribbing_m", none), none),
        use("lining", F.lit("lining"), F.coalesce("lining_m", none), none),
    )
    used = F.filter(parts, lambda p: p["material"].isNotNull() & ((p["m"] > 0) | (p["kg"] > 0)))
    rows = quantities.join(bom, "model").select("model", "quantity", F.explode(used).alias("p"))
    return rows.select("model", F.col("p.material").alias("material"), F.col("p.kind").alias("kind"), (F.col("p.m") * q).alias("meters"), (F.col("p.kg") * q).alias("kg"))


def requirements(exploded: DataFrame) -> DataFrame:
    """Totals of each material with the models that need it."""
    return exploded.groupBy("material").agg(
        F.sum("meters").alias("meters"), F.sum("kg").alias("kg"),
        F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("models"), F.count_distinct("model").alias("n_models"),
    )


def gap(required: DataFrame, stock: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """What is missing of each material. stock: material, quantity_meters, quantity_kg; catalog: material, supplier (one is kept)."""
    held = stock.groupBy("material").agg(F.sum("quantity_meters").alias("stock_meters"), F.sum("quantity_kg").alias("stock_kg"))
    out = required.join(held, "material", "left").fillna(0, ["stock_meters", "stock_kg"])
    out = out.withColumns({"gap_meters": F.col("meters") - F.col("stock_meters"), "gap_kg": F.col("kg") - F.col("stock_kg")})
    if catalog is None:
        return out.withColumn("supplier", F.lit(None).cast("string"))
    return out.join(catalog.groupBy("material").agg(F.min("supplier").alias("supplier")), "material", "left")


def parse_constraint(text: Column) -> Column:
    """struct(least, most, even) of texts such as `min 5 maks 40` or an even-only remark; null where none is given."""
    low = F.lower(text)
    number = lambda word: F.regexp_extract(low, rf"{word}\.?\s*(\d+)", 1).try_cast("int")
    given = ~F.coalesce(F.trim(low).isin("", "n/d", "nd", "-"), F.lit(True))
    return F.when(given, F.struct(number("min").alias("least"), number("ma(?:ks|x)").alias("most"), low.contains("parzyst").alias("even")))


def match_constraints(models: DataFrame, rules: DataFrame, keywords: list[str]) -> DataFrame:
    """The rule of each model: of the rules with its weight, the one whose keywords overlap most (shared over the larger set; the first of equals).

    models: model, weight, name; rules: rule_id, weight, name. Joined on the weight.
    """
    words = lambda c: F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(c), k))
    m = models.withColumn("own", words(F.col("name"))).select("model", "weight", "own")
    r = rules.withColumn("theirs", words(F.col("name"))).select("rule_id", "weight", "theirs")
    rows = m.join(r, "weight").withColumn("overlap", F.coalesce(F.try_divide(F.size(F.array_intersect("own", "theirs")), F.greatest(F.size("own"), F.size("theirs"))), F.lit(0.0)))
    best = Window.partitionBy("model").orderBy(F.desc("overlap"), "rule_id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("model", "rule_id", "overlap")


def facility_column(facility: Column, columns: dict[str, Column], default: Column) -> Column:
    """The constraint column of the first name that a facility's name holds (in any case)."""
    out = default
    for name, column in reversed(columns.items()):
        out = F.when(F.lower(facility).contains(name.lower()), column).otherwise(out)
    return out


def facility_load(orders: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """Orders and pieces of each facility, with use of its monthly capacity (facility, capacity) and weeks ahead."""
    named = F.coalesce(F.nullif(F.trim(F.col("facility")), F.lit("")), F.lit("Unknown"))
    out = orders.groupBy(named.alias("facility")).agg(F.count("*").alias("n_orders"), F.sum("total_quantity").alias("quantity"))
    if capacity is None:
        return out
    out = out.join(capacity, "facility", "left")
    use = F.coalesce(F.try_divide(F.col("quantity"), F.col("capacity")) * 100, F.lit(0.0))
    weeks = F.coalesce(F.try_divide(F.col("quantity"), F.col("capacity") / 4), F.lit(0.0))
    return out.withColumns({"use_percent": use, "weeks_ahead": weeks, "status": banded(use, LOAD_BANDS, "overloaded")})


def order_ages(orders: DataFrame, as_of, delivery_days: int = 42) -> DataFrame:
    """Active orders, newest first: days since the order, whether it should be ready, and days left."""
    days = F.datediff(F.lit(as_of), "order_date")
    rows = orders.where("status = 'active'").withColumns({"days": days, "ready": days >= delivery_days, "days_left": F.greatest(F.lit(0), delivery_days - days)})
    return rows.orderBy(F.desc("order_date"), "order_id")
