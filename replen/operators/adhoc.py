"""Ad-hoc questions as a structured specification that becomes a DataFrame; Catalyst plans it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = {"sales": "sale_date", "forecast": "forecast_date", "stock": "snapshot_date"}
QUANTITY = {"sales": "quantity", "forecast": "forecast", "stock": "available_stock"}
UNIT_DAYS = {"years": 365, "months": 30, "weeks": 7, "days": 1}
COMPARE = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__", "=": "__eq__"}


@dataclass(frozen=True)
class QuerySpec:
    """entity: sales, forecast or stock. metric: quantity (sum), value (sum), average. last: e.g. (2, "years") before as_of; years: inclusive range."""

    entity: str
    models: tuple[str, ...] = ()
    skus: tuple[str, ...] = ()
    colors: tuple[str, ...] = ()
    last: tuple[int, str] | None = None
    years: tuple[int, int] | None = None
    group_by: str | None = None
    metric: str = "quantity"
    limit: int | None = None
    where: tuple[tuple[str, str, float], ...] = ()
    below_rop: bool = False
    overstock: bool = False
    types: tuple[str, ...] = ()
    facility: str | None = None
    as_of: date = field(kw_only=True)


def query(spec: QuerySpec, tables: dict[str, DataFrame]) -> DataFrame:
    """tables: sales, forecast, stock (each with sku, model, color, size), and stats (entity, type, rop, safety_stock) for stock questions."""
    df, day = tables[spec.entity], DAY[spec.entity]
    for column, wanted in (("model", spec.models), ("sku", spec.skus), ("color", spec.colors)):
        if wanted:
            df = df.where(F.upper(column).isin([w.upper() for w in wanted]))
    if spec.last:
        n, unit = spec.last
        df = df.where(F.col(day) >= F.lit(spec.as_of - timedelta(days=n * UNIT_DAYS[unit])))
    if spec.years:
        df = df.where(F.year(day).between(*spec.years))
    for column, sign, value in spec.where:
        df = df.where(getattr(F.col(column), COMPARE[sign])(value))
    if spec.below_rop or spec.overstock or spec.types:
        stats = tables["stats"].select(F.col("entity").alias("sku"), "type", "rop", "safety_stock")
        df = df.join(stats, "sku")
        if spec.below_rop:
            df = df.where(F.col("available_stock") < F.col("rop"))
        if spec.overstock:
            df = df.where(F.col("available_stock") > F.col("rop") + F.col("safety_stock"))
        if spec.types:
            df = df.where(F.col("type").isin(list(spec.types)))
    if spec.facility:
        df = df.join(tables["facilities"], "model").where(F.lower("facility").contains(spec.facility.lower()))
    if spec.group_by is None:
        return df.limit(spec.limit) if spec.limit else df
    key = {"month": F.trunc(day, "month"), "year": F.year(day)}.get(spec.group_by, F.col(spec.group_by)).alias(spec.group_by)
    out = df.groupBy(key).agg(_metric(spec).alias("total"))
    in_time = spec.group_by in ("month", "year")
    out = out.orderBy(spec.group_by) if in_time else out.orderBy(F.desc("total"), spec.group_by)
    return out.limit(spec.limit) if spec.limit else out


def _metric(spec: QuerySpec) -> Column:
    quantity = F.col(QUANTITY[spec.entity])
    if spec.metric == "average":
        return F.avg(quantity)
    if spec.metric == "value":
        return F.sum(F.col("total_amount") if spec.entity == "sales" else quantity * F.col("net_price"))
    return F.sum(quantity)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temp views for spark.sql()."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
