"""Readers and writers of the feeds' files. All discovery is by Spark's readers and the files' own names."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replen.operators.maintenance import first_per_key
from replen.operators.selection import exclusion_list
from replen.sources import schemas

YES = ("tak", "yes", "1", "true", "x")
NONE = ("", "-", "n/d", "nd", "brak", "none", "nan")


def read_feed(spark: SparkSession, path: str, schema, fmt: str = "csv", pattern: str = "*") -> DataFrame:
    """A feed with its schema and the file of each row; rows without any value are dropped."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    df = (reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)).na.drop("all")
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def span_in_name(name: Column) -> tuple[Column, Column]:
    """First and last day of names such as 20230101-20231231.csv; null for others."""
    day = lambda i: F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{8})[_-](\d{8})", i), F.lit("")), "yyyyMMdd")
    return day(1), day(2)


def sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Sales files with the span that each file's name states."""
    df = read_feed(spark, path, schemas.SALES, fmt)
    start, end = span_in_name(F.col("source_file"))
    return df.withColumns({"file_start": start, "file_end": end})


def best_file_per_year(df: DataFrame) -> DataFrame:
    """Rows of the file with the longest span (then the last end) of each end year, so that cumulative exports count once."""
    files = df.select("source_file", "file_start", "file_end").distinct().where("file_end is not null")
    best = Window.partitionBy(F.year("file_end")).orderBy(F.desc(F.datediff("file_end", "file_start")), F.desc("file_end"), "source_file")
    files = files.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return df.join(F.broadcast(files.select("source_file")), "source_file", "left_semi")  # one name a year


def current_year_file(df: DataFrame, as_of: date) -> DataFrame:
    """Rows of the newest file that starts in as_of's year."""
    files = df.where(F.year("file_start") == as_of.year).agg(F.max_by("source_file", "file_end").alias("source_file"))
    return df.join(F.broadcast(files), "source_file", "left_semi")


def stock(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Stock snapshots: active rows, dated by the file's name."""
    df = read_feed(spark, path, schemas.STOCK, fmt).where("is_active = 1")
    day = F.try_to_date(F.nullif(F.regexp_extract("source_file", r"(\d{8})", 1), F.lit("")), "yyyyMMdd")
    return df.withColumns({"snapshot_date": day, "is_active": F.lit(True)})


def forecasts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Forecast versions: the generation date is in the folder or file name (yyyy-MM-dd, yyyy_MM_dd or yyyyMMdd)."""
    df = read_feed(spark, path, schemas.FORECAST, fmt).withColumn("_path", F.col("_metadata.file_path"))
    digits = F.regexp_extract("_path", r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[^0-9]*[^/]*$", 0)
    parts = [F.regexp_extract("_path", r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[^0-9]*[^/]*$", i) for i in (1, 2, 3)]
    return df.withColumn("generated_date", F.when(digits != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))).drop("_path")


def new_snapshots(found: DataFrame, cached: DataFrame) -> DataFrame:
    """Snapshot rows of days that the history lacks, one for each SKU and day."""
    rows = found.join(cached.select("snapshot_date").distinct(), "snapshot_date", "left_anti")
    return first_per_key(rows.select("sku", "snapshot_date", "available_stock"), ["sku", "snapshot_date"], [F.desc("available_stock")])


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("snapshot_date").parquet(path)


def number(text: Column) -> Column:
    """A number from text with a point or comma, 0 if it is none."""
    return F.coalesce(F.regexp_replace(text.cast("string"), ",", ".").try_cast("double"), F.lit(0.0))


def yes(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*YES), F.lit(False))


def known(text: Column) -> Column:
    """Trimmed text, null for the words that stand for none."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin(*NONE), trimmed)


def normalised_bom(raw: DataFrame, numbers: list[str], texts: list[str], flags: list[str]) -> DataFrame:
    """Bills of material with upper-cased models, numbers, flags and nulls in place of their spellings; one row a model."""
    rows = raw.withColumns({"model": F.upper(F.trim("model")), **{c: number(F.col(c)) for c in numbers}, **{c: known(F.col(c)) for c in texts}, **{c: yes(F.col(c)) for c in flags}})
    return first_per_key(rows.where("model <> ''"), ["model"], [F.col(c).asc_nulls_last() for c in rows.columns if c != "model"])


def size_aliases(raw: DataFrame) -> DataFrame:
    return raw.select(F.lpad(F.trim(F.col("code").cast("string")), 2, "0").alias("code"), F.trim("alias").alias("alias"))


def color_aliases(raw: DataFrame) -> DataFrame:
    bare = F.substring(F.regexp_replace(F.trim(F.col("code").cast("string")), r"\*", ""), 1, 2)
    return raw.select(F.upper(F.lpad(bare, 2, "0")).alias("code"), F.trim("alias").alias("alias"))


def outlet_models(raw: DataFrame) -> DataFrame:
    name = next(c for c in raw.columns if c.lower() == "model")
    return raw.select(F.substring(name, 1, 5).alias("model")).where("model is not null").distinct()


def pattern_sizes(spark: SparkSession, path: str) -> DataFrame:
    """set_id, pattern_id, pattern, size, count, least of nested pattern-set files."""
    sets = spark.read.schema(schemas.PATTERN_SETS).json(path, multiLine=True)
    rows = sets.select(F.col("id").alias("set_id"), F.col("min_order_per_pattern").alias("least"), F.explode("patterns").alias("p"))
    return rows.select("set_id", "least", F.col("p.id").alias("pattern_id"), F.col("p.name").alias("pattern"), F.explode("p.sizes").alias("size", "count"))


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def jdbc(spark: SparkSession, url: str, table: str, column: str, bounds: tuple[int, int], partitions: int) -> DataFrame:
    """A database table read in ranges of a column by as many tasks."""
    options = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int = 8, batch: int = 1000, mode: str = "append") -> None:
    """Write a database table by so many connections, each in batches of rows."""
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(partitions), batchsize=str(batch)).mode(mode).save()


def write_orders(orders: DataFrame, path: str) -> None:
    """Orders as JSON lines, one folder an order date."""
    orders.write.mode("overwrite").partitionBy("order_date").json(path)


def save_exclusions(rows: DataFrame, path: str) -> None:
    """The list of excluded SKUs as JSON lines, distinct and in order."""
    exclusion_list(rows).write.mode("overwrite").json(path)


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """A saved list; rows that are no SKU are left out."""
    return exclusion_list(spark.read.schema("sku string").json(path))


def newest_outlets(df: DataFrame) -> DataFrame:
    """Outlet models of the file whose name has the last year (of equals the last name)."""
    year = F.nullif(F.regexp_extract("source_file", r"(20\d{2})", 1), F.lit("")).cast("int")
    newest = df.select(F.struct(year.alias("year"), F.col("source_file").alias("name")).alias("f")).where("f.year is not null").agg(F.max("f").alias("f"))
    rows = df.join(F.broadcast(newest.select(F.col("f.name").alias("source_file"))), "source_file", "left_semi")  # one row
    return outlet_models(rows)
