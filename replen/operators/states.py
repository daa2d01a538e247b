"""Monthly states of entities that batches add to: a batch costs its own size, not the history of what it touches.

A state (rows, values, total, squares about the mean, least, greatest, first, last) of an entity's month merges with another of it, in any
order, so late rows are corrections of their own month and need no recomputation. Each batch's states are a folder of their own number,
which a batch that is run again replaces; compact() merges those of the batches before a number into one table now and then.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replen.operators import maintenance, stats

KEYS = ["entity_type", "entity_id", "month"]
VIEW = "monthly_states"
STATES = "entity_type string, entity_id string, month date, n_rows long, n long, total double, m2 double, low double, high double, first timestamp, last timestamp"


def month_states(rows: DataFrame, entities: dict[str, Column], at: Column, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The states of rows under STATES, with the columns `by` kept apart (a batch's number): one scan and one partial aggregation for all types.

    entities: an identifier for each type. Rows without a time have the month null, those without an identifier an entity that is null; n and the
    sums leave out values that are null. Without rows there is no state.
    """
    named = F.array(*[F.struct(F.lit(k).alias("entity_type"), v.cast("string").alias("entity_id")) for k, v in entities.items()])
    rows = rows.select(*by, F.explode(named).alias("e"), at.cast("timestamp").alias("at"), value.cast("double").alias("v"))
    rows = rows.select(*by, "e.*", F.trunc("at", "month").alias("month"), "at", "v")
    return rows.groupBy(*by, *KEYS).agg(
        F.count("*").alias("n_rows"), F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"),
        F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("m2"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("at").alias("first"), F.max("at").alias("last"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One state for each entity and month. The squares are taken about the common mean, so large values lose no digits; both steps share one exchange."""
    whole = Window.partitionBy(*KEYS)
    mean = F.try_divide(F.sum("total").over(whole), F.sum("n").over(whole))
    off = F.try_divide("total", "n") - F.col("mean")
    return states.withColumn("mean", mean).groupBy(*KEYS).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(F.col("m2") + F.coalesce(F.col("n") * off * off, F.lit(0.0))).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"),
    )


def append(states: DataFrame, root: str, batch: int) -> None:
    """Store a batch's states; the same number replaces what it stored before."""
    states.write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")


def _since(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The compacted states and the first batch that they lack (none and 0 before the first compact())."""
    try:
        first = maintenance.generation(spark, root, VIEW)
    except ValueError:
        return spark.createDataFrame([], STATES), 0
    return spark.read.parquet(f"{root}/{VIEW}/generation={first}"), first


def stored(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The merged states of all batches, or of those before a number, which must not be compacted further than that."""
    base, first = _since(spark, root)
    if before is not None and before < first:
        raise ValueError(f"batches before {first} are compacted")
    try:
        later = spark.read.schema(f"{STATES}, batch long").option("basePath", f"{root}/batches").parquet(f"{root}/batches")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return merged(base)
    later = later.where(F.col("batch") >= first)  # prunes folders; a batch run again after it was compacted is not read
    if before is not None:
        later = later.where(F.col("batch") < before)
    return merged(base.unionByName(later.drop("batch")))


def compact(spark: SparkSession, root: str, before: int) -> DataFrame:
    """Merge the batches before a number into one table that readers see whole; the row of publish(). Batches to come must have that number or more."""
    return maintenance.publish({VIEW: stored(spark, root, before)}, root, before, "states")


def as_months(states: DataFrame, entity_type: str) -> DataFrame:
    """entity, month, quantity, first_sale of one type: what stats.monthly() gives, for the operators that take it. Rows without a time are left out."""
    rows = states.where((F.col("entity_type") == entity_type) & F.col("month").isNotNull())
    return rows.select(F.col("entity_id").alias("entity"), "month", F.col("total").alias("quantity"), F.col("first").cast("date").alias("first_sale"))


def entity_table(states: DataFrame) -> DataFrame:
    """entity_type, entity_id and the columns of stats.entity_stats() for every type."""
    entity = F.struct("entity_type", "entity_id")
    months = states.where("month is not null").select(entity.alias("entity"), "month", F.col("total").alias("quantity"), F.col("first").cast("date").alias("first_sale"))
    return stats.entity_stats(months).select("entity.*", "*").drop("entity")


def refreshed_table(old: DataFrame, states: DataFrame, batch: DataFrame) -> DataFrame:
    """entity_table() after a batch: only entities that the batch's states touch are worked out again, from months and not from sales."""
    keys = batch.where("entity_id is not null").select("entity_type", "entity_id").distinct()
    return maintenance.refreshed(old, entity_table(states.join(keys, ["entity_type", "entity_id"], "left_semi")), keys)
