"""Streaming ingest of sales: every sale is inserted once, however late it comes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from replen.operators import states
from replen.operators.maintenance import insert_ignore

KEYS = ["order_id", "sku", "sale_time"]


def distinct_sales(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """stream: order_id, sku, sale_time (timestamp), quantity, ... Sales older than the watermark are dropped; start() keeps them."""
    return stream.withWatermark("sale_time", delay).dropDuplicatesWithinWatermark(KEYS)


def daily_totals(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Quantity of each SKU and day, final once the watermark has passed the day."""
    rows = stream.withWatermark("sale_time", delay)
    return rows.groupBy(F.window("sale_time", "1 day").alias("day"), "sku").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))


def start(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, states_root: str | None = None, entities: dict[str, Column] | None = None) -> StreamingQuery:
    """Read new files of source, insert what target lacks, stop when all is read.

    Duplicates are found against the target, not within a watermark, so back-filled sales of any age are inserted once. The target is
    partitioned by day and batch: a batch is compared with the earlier sales of its own days alone, so its cost grows with the batch and not with
    the batches before it. A batch that is run again after a failure replaces its own partitions, so no row is inserted twice. Sales without a time share a partition and, as nobody knows their time, are never taken for repeats.

    With states_root each batch also stores the monthly states (see replen.operators.states) of the rows that it inserted, under its number, for the
    entities given (those of sku by default). A late sale is a correction of its own month. Once a batch has failed between its rows and its
    states, running it again replaces both.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def insert(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.coalesce(F.date_format("sale_time", "yyyy-MM-dd"), F.lit("none")))
        days = sorted(r["day"] for r in rows.select("day").distinct().collect())  # the days of one batch
        earlier = rows.limit(0)
        if number and days:
            try:
                found = spark.read.schema(rows.schema).option("basePath", target).parquet(f"{target}/day={{{','.join(days)}}}/batch=*")
                earlier = found.where(F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long") < number)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        new = insert_ignore(earlier, rows, KEYS).withColumn("batch", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)
        if states_root is not None:
            try:
                kept = spark.read.schema(new.schema).option("basePath", target).parquet(f"{target}/day={{{','.join(days)}}}/batch={number}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                kept = rows.limit(0)
            made = states.month_states(kept, entities or {"sku": F.col("sku")}, F.col("sale_time"), F.col("quantity"))
            states.append(made, states_root, number)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
