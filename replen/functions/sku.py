"""The packed SKU key: model in characters 1-5, color in 6-7, size in 8-9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILDREN, ADULTS = ("ch", "ni", "dz"), ("do", "ju")


def part(sku: Column, start: int, length: int) -> Column:
    """A part of the key, null when the SKU is too short to have it."""
    return F.when(F.length(sku) >= start + length - 1, F.substring(sku, start, length))


def with_sku_parts(df: DataFrame, sku: str = "sku") -> DataFrame:
    k = F.col(sku)
    return df.withColumns({"model": part(k, 1, 5), "color": part(k, 6, 2), "size": part(k, 8, 2)})


def age_category(key: Column) -> Column:
    """children or adult by the first two letters, else null."""
    prefix = F.lower(F.substring(key, 1, 2))
    return F.when(prefix.isin(*CHILDREN), "children").when(prefix.isin(*ADULTS), "adult")


def size_sort_key(code: Column) -> Column:
    return F.coalesce(code.try_cast("int"), F.lit(999))


def aliased(df: DataFrame, aliases: DataFrame, code: str, name: str) -> DataFrame:
    """Add name: the alias (code, alias) of a code, or the code itself."""
    dim = aliases.select(F.col("code").alias(code), F.col("alias").alias("_alias"))
    return df.join(dim, code, "left").withColumn(name, F.coalesce("_alias", code)).drop("_alias")
