"""Stored forecast batches and models: tables in folders that Spark writes and prunes."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replen.functions.calendar import add_months
from replen.operators import accuracy

BATCH = "batch_id string, generated_date date, entity_type string, horizon int, n_entities long, notes string"


def save_batch(forecasts: DataFrame, root: str, batch_id: str, generated: date, entity_type: str, horizon: int, notes: str = "") -> None:
    """Write a batch of forecasts (entity, month, forecast, ...) to its own partition, and a line about it."""
    spark = forecasts.sparkSession
    forecasts.write.mode("overwrite").parquet(f"{root}/forecasts/batch_id={batch_id}")
    n = spark.read.parquet(f"{root}/forecasts/batch_id={batch_id}").select("entity").distinct().count()
    line = spark.createDataFrame([(batch_id, generated, entity_type, horizon, n, notes)], BATCH)
    line.write.mode("overwrite").json(f"{root}/batches/id={batch_id}")


def list_batches(spark: SparkSession, root: str, entity_type: str | None = None, n: int = 20) -> DataFrame:
    """The newest batches."""
    rows = spark.read.schema(BATCH).json(f"{root}/batches/*")
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    return rows.orderBy(F.desc("generated_date"), "batch_id").limit(n)


def load_batch(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/forecasts").where(F.col("batch_id") == batch_id).drop("batch_id")


def _delete(spark: SparkSession, *paths: str) -> bool:
    """Remove folders through Spark's own file systems; whether any was there."""
    found = False
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found |= p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return found


def delete_batch(spark: SparkSession, root: str, batch_id: str) -> bool:
    """Remove a batch's partition and its line; whether it was there."""
    return _delete(spark, f"{root}/forecasts/batch_id={batch_id}", f"{root}/batches/id={batch_id}")


def covered_months(generated: date, horizon: int) -> tuple[date, date]:
    """First and last month that a batch is about."""
    return generated.replace(day=1), add_months(generated, horizon - 1)


def rescore(batch: DataFrame, external: DataFrame, actual_months: DataFrame, until: date) -> DataFrame:
    """Compare a stored batch with sales known by a later day. actual_months: entity, month, quantity."""
    rows = batch.where(F.col("month") <= F.lit(until.replace(day=1)))
    return accuracy.compare(accuracy.align(rows, external, actual_months))


def save_model(model, root: str, name: str, generated: date, method: str, score: float, spark: SparkSession) -> None:
    PipelineModel([model]).write().overwrite().save(f"{root}/models/{name}")
    spark.createDataFrame([(name, generated, method, float(score))], "name string, generated_date date, method string, cv_score double").write.mode("overwrite").json(f"{root}/registry/id={name}")


def list_models(spark: SparkSession, root: str, method: str | None = None) -> DataFrame:
    rows = spark.read.schema("name string, generated_date date, method string, cv_score double").json(f"{root}/registry/*")
    return (rows.where(F.col("method") == method) if method else rows).orderBy(F.desc("generated_date"), "name")


def delete_model(spark: SparkSession, root: str, name: str) -> bool:
    """Remove a model and its line; whether it was there."""
    return _delete(spark, f"{root}/models/{name}", f"{root}/registry/id={name}")


def model_kpis(models: DataFrame) -> DataFrame:
    """Number of models, mean score (0 for models without one) and the method of most (of equals the least name)."""
    return models.agg(F.count("*").alias("n"), F.avg(F.coalesce("cv_score", F.lit(0.0))).alias("mean_score"), F.mode("method", deterministic=True).alias("most_common"))


def load_model(root: str, name: str):
    return PipelineModel.load(f"{root}/models/{name}").stages[0]
