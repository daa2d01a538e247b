"""Published generations of derived tables, stored models, schema checks and feeds that other tests leave out."""

from datetime import date

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replen.operators import forecasting, maintenance, store
from replen.sources import files, schemas


def views(spark, n, broken=False):
    stock = spark.range(n).select(F.col("id").cast("string").alias("sku"), F.lit(n).alias("stock"))
    forecast = spark.range(2 * n).select(F.col("id").cast("string").alias("sku"), F.lit(n).alias("forecast"))
    if broken:
        forecast = forecast.withColumn("forecast", F.when(F.col("sku") == "0", F.raise_error(F.lit("lost"))).otherwise(F.col("forecast")))
    return {"latest_stock": stock, "latest_forecast": forecast}


def test_readers_see_one_generation(spark, tmp_path):
    root = str(tmp_path / "views")
    both = lambda: tuple(maintenance.published(spark, root, v).agg(F.count("*"), F.max(c)).first() for v, c in (("latest_stock", "stock"), ("latest_forecast", "forecast")))
    with pytest.raises(ValueError):
        maintenance.published(spark, root, "latest_stock")
    with pytest.raises(ValueError):
        maintenance.publish({}, root, 1)
    first = maintenance.publish(views(spark, 3), root, 1)
    assert [tuple(r) for r in first.collect()] == [("latest_stock", 0, 3, 3), ("latest_forecast", 0, 6, 6)] and both() == ((3, 3), (6, 3))
    with pytest.raises(Exception, match="lost"):  # the stock is written before the run fails
        maintenance.publish(views(spark, 5, broken=True), root, 2)
    assert spark.read.parquet(f"{root}/latest_stock/generation=2").count() == 5 and both() == ((3, 3), (6, 3))
    again = maintenance.publish(views(spark, 5), root, 2)
    assert {r.view: r.changed for r in again.collect()} == {"latest_stock": 2, "latest_forecast": 4} and both() == ((5, 5), (10, 5))
    maintenance.publish(views(spark, 7), root, 3, "stock")  # the other group keeps its files
    assert both() == ((7, 7), (10, 5))
    with pytest.raises(ValueError):
        maintenance.publish(views(spark, 9), root, 3)


def test_published_while_a_manifest_is_unfinished(spark, tmp_path):
    root = str(tmp_path / "views")
    maintenance.publish(views(spark, 3), root, 1)
    (tmp_path / "views" / "manifests" / "2" / "_temporary").mkdir(parents=True)
    assert maintenance.published(spark, root, "latest_stock").count() == 3


def test_stored_models_forecast_again(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(30)], "x double, quantity double")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="quantity").fit(data)
    for name, day, method, score in (("a", date(2001, 1, 1), "ridge", 3.0), ("b", date(2001, 2, 1), "lasso", 5.0), ("c", date(2001, 3, 1), "ridge", 4.0)):
        store.save_model(model, str(tmp_path), name, day, method, score, spark)
    assert [r.name for r in store.list_models(spark, str(tmp_path)).collect()] == ["c", "b", "a"]
    assert [r.name for r in store.list_models(spark, str(tmp_path), "ridge").collect()] == ["c", "a"]
    assert tuple(store.model_kpis(store.list_models(spark, str(tmp_path))).first()) == (3, 4.0, "ridge")
    again = store.load_model(str(tmp_path), "b")
    assert [r.prediction for r in again.transform(data).collect()] == [r.prediction for r in model.transform(data).collect()]
    assert store.delete_model(spark, str(tmp_path), "b") and not store.delete_model(spark, str(tmp_path), "b")
    assert [r.name for r in store.list_models(spark, str(tmp_path)).collect()] == ["c", "a"]


def test_schema_and_batch_counts(spark):
    want = StructType.fromDDL("sku string, quantity int")
    df = spark.createDataFrame([("a", "1")], "sku string, quantity string")
    assert maintenance.check_schema(df.select("sku"), want) == (False, ["missing column quantity"])
    assert maintenance.check_schema(df, want, ("quantity",)) == (False, ["column quantity is not numeric"])
    assert maintenance.check_schema(df.where("false"), want) == (False, ["no rows"]) and maintenance.check_schema(df, want) == (True, [])
    made = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "entity string, method string")
    found = forecasting.batch_stats(made, spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "entity string"))
    assert {r.method: r.n_entities for r in found.collect()} == {"x": 1, "y": 1, "failed": 1}


def test_history_and_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", date(2001, 1, 1), 5), ("b", date(2001, 1, 1), 6), ("a", date(2001, 1, 8), 7), ("a", date(2001, 1, 8), 9)], "sku string, snapshot_date date, available_stock int")
    path = str(tmp_path / "history")
    files.append_history(rows.where("snapshot_date = date'2001-01-01'"), path)
    files.append_history(files.new_snapshots(rows, spark.read.parquet(path)), path)
    assert sorted((r.sku, r.available_stock) for r in spark.read.parquet(path).collect()) == [("a", 5), ("a", 9), ("b", 6)]
    assert files.new_snapshots(rows, spark.read.parquet(path)).count() == 0
    files.write_report(rows.orderBy("available_stock"), str(tmp_path / "report"), ";")
    assert spark.read.csv(str(tmp_path / "report"), header=True, sep=";").columns == rows.columns
    folder = tmp_path / "forecasts" / "2001-08-01"
    rows.selectExpr(*[f"cast({v} as {f.dataType.simpleString()}) as {f.name}" for f in StructType.fromDDL(schemas.FORECAST).fields for v in [{"sku": "sku", "forecast_date": "snapshot_date"}.get(f.name, "5")]]).coalesce(1).write.csv(str(folder), header=True)
    assert {str(r.generated_date) for r in files.forecasts(spark, str(tmp_path / "forecasts"), "csv").select("generated_date").collect()} == {"2001-08-01"}
