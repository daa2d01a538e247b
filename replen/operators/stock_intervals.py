"""Stock history as intervals of equal stock: a row for each change of a SKU and not for each snapshot, without losing one.

An interval (sku, first, last, stock) says that the SKU was in every snapshot from first to last with that stock; a snapshot that lacks it, or
another stock, ends it. With the days of all snapshots (snapshot_date, one row each) the history can be had back. Stock is held to six
decimals, so that sums come out exact in any order. Rows without a day are left out; of rows that repeat a SKU and day the largest stock
counts; a null SKU is one of its own and a null stock is unlike every number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replen.operators import accuracy, maintenance

INTERVALS = "sku string, first date, last date, stock decimal(28,6)"
DAYS = "snapshot_date date"
TABLES = ("stock_intervals", "snapshot_days")


def snapshot_days(history: DataFrame) -> DataFrame:
    return history.select("snapshot_date").where("snapshot_date is not null").distinct()


def _numbered(days: DataFrame) -> DataFrame:
    """day and its number among all days; one row a snapshot day, so one task orders them."""
    return days.select(F.col("snapshot_date").alias("day"), F.row_number().over(Window.orderBy("snapshot_date")).alias("number"))


def _joined(pieces: DataFrame, days: DataFrame) -> DataFrame:
    """Pieces of equal stock on neighbouring days as one interval: one exchange by SKU."""
    number = _numbered(days)
    rows = pieces.join(number.select(F.col("day").alias("first"), F.col("number").alias("a")), "first").join(number.select(F.col("day").alias("last"), F.col("number").alias("b")), "last")
    w = Window.partitionBy("sku").orderBy("first")
    same = F.col("stock").eqNullSafe(F.lag("stock").over(w)) & (F.col("a") == F.lag("b").over(w) + 1)
    rows = rows.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("starts").over(w))
    return rows.groupBy("sku", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("stock").alias("stock")).drop("run")


def _units(rows: DataFrame) -> DataFrame:
    held = F.col("available_stock").cast("decimal(28,6)").alias("stock")
    rows = rows.where("snapshot_date is not null").select("sku", "snapshot_date", held)
    day = F.col("snapshot_date")
    return rows.groupBy("sku", "snapshot_date").agg(F.max("stock").alias("stock")).select("sku", day.alias("first"), day.alias("last"), "stock")


def intervals(history: DataFrame) -> DataFrame:
    """The intervals of a whole history (sku, snapshot_date, available_stock)."""
    return _joined(_units(history), snapshot_days(history))


def _cut(old: DataFrame, days: DataFrame, new: DataFrame) -> DataFrame:
    """Intervals taken apart at new days that lie inside: up to the old day before, from the old day after. All new days travel as one row."""
    every = days.withColumn("own", F.col("snapshot_date")).unionByName(new.withColumn("own", F.lit(None).cast("date")))
    up, down = Window.orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("snapshot_date").rowsBetween(0, Window.unboundedFollowing)
    around = every.select("own", F.last("own", ignorenulls=True).over(up).alias("upto"), F.first("own", ignorenulls=True).over(down).alias("since"))
    gaps = around.where("own is null and upto is not null and since is not null").agg(F.array_sort(F.collect_set(F.struct("upto", "since"))).alias("gaps"))
    rows = old.crossJoin(gaps).withColumn("gaps", F.filter("gaps", lambda g: (g["upto"] >= F.col("first")) & (g["since"] <= F.col("last"))))
    starts = F.concat(F.array("first"), F.transform("gaps", lambda g: g["since"]))
    ends = F.concat(F.transform("gaps", lambda g: g["upto"]), F.array("last"))
    return rows.select("sku", F.explode(F.arrays_zip(starts.alias("first"), ends.alias("last"))).alias("p"), "stock").select("sku", "p.first", "p.last", "stock")


def extend(old: DataFrame, days: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals and days after snapshots (sku, snapshot_date, available_stock) of days that days lacks; rows of known days are left out.

    Snapshots may come late and in any order: the result equals intervals() of the whole history. Intervals that end before the last old day before
    the first new one can neither grow nor be cut, so they pass by without an exchange.
    """
    rows = rows.join(days, "snapshot_date", "left_anti")
    new = snapshot_days(rows)
    first = new.agg(F.min("snapshot_date").alias("_first"))
    edge = days.crossJoin(first).where("snapshot_date < _first").agg(F.max("snapshot_date").alias("_edge"))
    placed = old.crossJoin(edge).crossJoin(first)
    closed = F.col("_first").isNull() | F.coalesce(F.col("last") < F.col("_edge"), F.lit(False))
    still, open_ = placed.where(closed).drop("_edge", "_first"), placed.where(~closed).drop("_edge", "_first")
    all_days = days.unionByName(new)
    return still.unionByName(_joined(_cut(open_, days, new).unionByName(_units(rows)), all_days)), all_days


def history(found: DataFrame, days: DataFrame) -> DataFrame:
    """sku, snapshot_date, available_stock of every snapshot, as it was stored."""
    held = days.agg(F.array_sort(F.collect_set("snapshot_date")).alias("_days"))  # one row
    rows = found.crossJoin(held).withColumn("snapshot_date", F.explode(F.filter("_days", lambda d: d.between(F.col("first"), F.col("last")))))
    return rows.select("sku", "snapshot_date", F.col("stock").alias("available_stock"))


def entity_runs(found: DataFrame, days: DataFrame, entity: Column) -> DataFrame:
    """entity, first, last, stock: spans of days over which an entity's total (and whether it is seen at all) stays the same.

    Each interval is two events, what it adds and what it takes away after its end, and a running sum gives the totals: the work grows with the
    changes, not with the days. The total is null where every SKU's stock is.
    """
    number = _numbered(days).select("day", "number")
    rows = found.select(entity.alias("entity"), "first", "last", "stock").join(number.select(F.col("day").alias("first"), F.col("number").alias("a")), "first")
    rows = rows.join(number.select(F.col("day").alias("last"), F.col("number").alias("b")), "last")
    event = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("rows"), F.when(F.col("stock").isNotNull(), sign).otherwise(0).alias("known"), (F.coalesce("stock", F.lit(0)) * sign).cast("decimal(28,6)").alias("stock"))
    events = rows.select("entity", F.explode(F.array(event(F.col("a"), 1), event(F.col("b") + 1, -1))).alias("e")).select("entity", "e.*")
    events = events.groupBy("entity", "at").agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("stock").alias("stock"))
    w = Window.partitionBy("entity").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = events.select("entity", "at", (F.lead("at").over(w) - 1).alias("until"), *[F.sum(c).over(upto).alias(c) for c in ("rows", "known", "stock")]).where("rows > 0")
    runs = runs.join(number.select(F.col("day").alias("first"), F.col("number").alias("at")), "at").join(number.select(F.col("day").alias("last"), F.col("number").alias("until")), "until")
    return runs.select("entity", "first", "last", F.when(F.col("known") > 0, F.col("stock")).alias("stock"))


def out_of_stock_streaks(runs: DataFrame, days: DataFrame) -> DataFrame:
    """What inventory.out_of_stock_streaks() gives, from entity_runs()."""
    bounds = days.agg(F.max("snapshot_date").alias("_last"), F.min("snapshot_date").alias("_first"))
    per = runs.groupBy("entity").agg(F.max(F.when(F.col("stock") > 0, F.col("last"))).alias("last_in_stock"), F.max_by("stock", "last").alias("stock"), F.max("last").alias("seen"))
    out = per.crossJoin(bounds).where((F.col("seen") < F.col("_last")) | (F.col("stock") <= 0))
    return out.select("entity", "last_in_stock", F.datediff("_last", F.coalesce("last_in_stock", "_first")).alias("days_out")).where("days_out > 0")


def daily_grid(sales: DataFrame, forecast: DataFrame, runs: DataFrame, days: DataFrame, start: date, end: date, entity: str) -> DataFrame:
    """What accuracy.daily_grid() gives, from entity_runs(): forecast days and runs are sorted together once, and a snapshot day takes the run it lies in."""
    plan = accuracy.planned_and_sold(sales, forecast, start, end, entity)
    seen = days.select(F.col("snapshot_date").alias("day"), F.lit(True).alias("seen"))
    cells = plan.join(seen, "day", "left").withColumns({"run": F.lit(None).cast("struct<last:date,stock:decimal(28,6)>"), "kind": F.lit(1)})
    held = runs.where((F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end))).select("entity", F.col("first").alias("day"), F.struct("last", "stock").alias("run"), F.lit(0).alias("kind"))
    upto = Window.partitionBy("entity").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.unionByName(held, allowMissingColumns=True).withColumn("run", F.last("run", ignorenulls=True).over(upto))
    stock = F.when((F.col("kind") == 1) & F.col("seen") & (F.col("run.last") >= F.col("day")), F.col("run.stock"))
    rows = rows.withColumn("stock", stock).withColumn("known", F.last("stock", ignorenulls=True).over(upto)).where("kind = 1")
    return rows.select("entity", "day", "forecast", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce(F.col("known") > 0, F.lit(True)).alias("had_stock"))


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The published intervals and days; empty ones before the first ingest()."""
    try:
        return maintenance.published(spark, root, TABLES[0]), maintenance.published(spark, root, TABLES[1])
    except ValueError:
        return spark.createDataFrame([], INTERVALS), spark.createDataFrame([], DAYS)


def ingest(rows: DataFrame, root: str, generation: int) -> DataFrame:
    """Extend the published intervals by snapshots and publish both tables at once; the rows of maintenance.publish()."""
    found, days = extend(*read(rows.sparkSession, root), rows)
    return maintenance.publish({TABLES[0]: found, TABLES[1]: days}, root, generation, "history")
