from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replen.streaming import ingest


def test_ingest_inserts_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    rows = events.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_shipdate").cast("timestamp").alias("sale_time"), F.col("l_quantity").alias("quantity")).dropDuplicates(ingest.KEYS)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.unionByName(rows).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest.start(spark, source, schema, target, str(tmp_path / "ck")).awaitTermination()
    n = spark.read.parquet(source).select(ingest.KEYS).distinct().count()
    assert spark.read.parquet(target).count() == n
    spark.read.parquet(source).write.mode("append").parquet(source)
    ingest.start(spark, source, schema, target, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(target).count() == n


def test_ingest_keeps_late_sales(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "order_id string, sku string, sale_time timestamp, quantity int"
    sale = lambda i, day: (f"o{i}", "s", datetime(2001, *day), i)
    files = [[sale(1, (6, 1)), sale(1, (6, 1)), sale(2, (6, 30))], [sale(3, (7, 1))], [sale(4, (1, 1)), sale(4, (1, 1)), sale(1, (6, 1)), ("o5", "s", None, 5)], [("o5", "s", None, 6), ("o6", "s", None, 6)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, StructType.fromDDL(schema), target, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.quantity for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5, 6, 6]
