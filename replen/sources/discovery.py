"""Which files of a feed to read, decided from their names alone, and scans of the chosen ones.

A listing has a row for each file (path, name, length, modified) and opens none: content is no column of it. A choice keeps one file a year,
day or version, so its paths may come to the driver, which hands them to the readers; files that were not chosen are never opened.
Ties go to the least path. Folders without a file that fits give an empty choice, and that gives an empty table.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replen.operators.maintenance import first_per_key
from replen.sources import schemas
from replen.sources.files import span_in_name
from replen.sources.workbook import read_workbooks

#: Formats by preference where two files say the same.
FORMATS = ("csv", "xlsx", "parquet")
VERSION_FORMATS = ("xlsx", "csv", "parquet")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, length, modified of the files below root whose name fits a glob; Spark's readers leave out files of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def _day(text: Column, form: str) -> Column:
    return F.try_to_date(F.nullif(text, F.lit("")), form)


def _format(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([a-z]+)$", 1)


def _preference(formats: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("format"))


def sales_files(found: DataFrame) -> DataFrame:
    """Sales files (yyyyMMdd-yyyyMMdd or with _) with file_start, file_end and format; other names and impossible days are left out."""
    start, end = span_in_name(F.col("name"))
    named = found.where(F.col("name").rlike(rf"^\d{{8}}[_-]\d{{8}}\.({'|'.join(FORMATS)})$"))
    return named.withColumns({"file_start": start, "file_end": end, "format": _format(F.col("name"))}).where("file_start is not null and file_end is not null")


def best_per_year(found: DataFrame) -> DataFrame:
    """Of the sales files that end in a year the one with the longest span, then the last end."""
    span = F.datediff("file_end", "file_start")
    return first_per_key(found.withColumn("year", F.year("file_end")), ["year"], [F.desc(span), F.desc("file_end"), _preference(FORMATS), F.col("path")])


def newest_of_year(found: DataFrame, as_of: date) -> DataFrame:
    """Of the sales files that start in as_of's year the one with the last end."""
    rows = found.where(F.year("file_start") == as_of.year).withColumn("year", F.year("file_start"))
    return first_per_key(rows, ["year"], [F.desc("file_end"), _preference(FORMATS), F.col("path")])


def stock_files(found: DataFrame) -> DataFrame:
    """Snapshots (yyyyMMdd) with snapshot_date and format, one file a day."""
    named = found.where(F.col("name").rlike(rf"^\d{{8}}\.({'|'.join(FORMATS)})$"))
    rows = named.withColumns({"snapshot_date": _day(F.substring("name", 1, 8), "yyyyMMdd"), "format": _format(F.col("name"))}).where("snapshot_date is not null")
    return first_per_key(rows, ["snapshot_date"], [_preference(FORMATS), F.col("path")])


def unread_snapshots(snapshots: DataFrame, cached: DataFrame) -> DataFrame:
    """Snapshot files of days that the history lacks."""
    return snapshots.join(cached.select("snapshot_date").distinct(), "snapshot_date", "left_anti")


def generated_in_path(path: Column) -> Column:
    """The generation date that a forecast's folder (yyyy-MM-dd) or, without one, its name (generated_yyyy_MM_dd) states; null for other paths."""
    folder = _day(F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1), "yyyy-MM-dd")
    return F.coalesce(folder, _day(F.regexp_extract(path, r"/forecast_\d{4}_\d{2}_\d{2}_generated_(\d{4}_\d{2}_\d{2})\.[a-z]+$", 1), "yyyy_MM_dd"))


def forecast_files(found: DataFrame) -> DataFrame:
    """Forecast versions with generated_date and format, one file a date, workbooks before text. Files in dated folders count; only where there are
    none do the names state the dates."""
    named = found.where(F.col("name").rlike(rf"^forecast_.*\.({'|'.join(VERSION_FORMATS)})$"))
    foldered = _day(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1), "yyyy-MM-dd").isNotNull()
    rows = named.withColumns({"generated_date": generated_in_path(F.col("path")), "format": _format(F.col("name")), "_foldered": foldered}).where("generated_date is not null")
    any_folder = rows.agg(F.coalesce(F.bool_or("_foldered"), F.lit(False)).alias("_any"))
    rows = rows.crossJoin(any_folder).where("_foldered = _any").drop("_foldered", "_any")  # one row
    return first_per_key(rows, ["generated_date"], [_preference(VERSION_FORMATS), F.col("path")])


def newest_outlet_file(found: DataFrame) -> DataFrame:
    """The outlet file (outlet yyyy, any case) of the last year."""
    year = F.regexp_extract("name", rf"(?i)outlet[_\s]*(\d{{4}})\.({'|'.join(FORMATS)})$", 1).try_cast("int")
    rows = found.withColumns({"year": year, "format": F.lower(_format(F.lower("name"))), "_all": F.lit(1)}).where("year is not null")
    return first_per_key(rows, ["_all"], [F.desc("year"), _preference(VERSION_FORMATS), F.col("path")]).drop("_all")


def _literal(path: str) -> str:
    """A path that readers do not take for a glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_chosen(spark: SparkSession, chosen: DataFrame, schema: str) -> DataFrame:
    """Rows of the chosen files (path, format) with source_file and source_path; rows without any value are dropped.

    Text and workbooks have a header line; columns of text are taken by position, of workbooks and Parquet by name.
    """
    paths: dict[str, list[str]] = {}
    for row in chosen.select("path", "format").orderBy("path").collect():  # one a year, day or version
        paths.setdefault(row["format"], []).append(_literal(row["path"]))
    names = [f.name for f in T.StructType.fromDDL(schema)]
    out = spark.createDataFrame([], f"{schema}, source_file string, source_path string")
    for fmt, found in paths.items():
        if fmt == "xlsx":
            rows = read_workbooks(spark, found, schema)
        else:
            reader = spark.read.schema(schema).format(fmt)
            rows = (reader.option("header", True) if fmt == "csv" else reader).load(found).withColumn("source_path", F.col("_metadata.file_path"))
        out = out.unionByName(rows.na.drop("all", subset=names).withColumn("source_file", F.element_at(F.split("source_path", "/"), -1)))
    return out


def load_sales(spark: SparkSession, root: str, as_of: date | None = None) -> DataFrame:
    """Sales of the best file of each year, or of the newest file of as_of's year, with the spans that their names state."""
    found = sales_files(listing(spark, root))
    rows = read_chosen(spark, best_per_year(found) if as_of is None else newest_of_year(found, as_of), schemas.SALES)
    start, end = span_in_name(F.col("source_file"))
    return rows.withColumns({"file_start": start, "file_end": end})


def load_stock(spark: SparkSession, root: str, cached: DataFrame | None = None) -> DataFrame:
    """Active rows of each day's snapshot, or only of the days that cached (snapshot_date) lacks."""
    found = stock_files(listing(spark, root))
    rows = read_chosen(spark, found if cached is None else unread_snapshots(found, cached), schemas.STOCK).where("is_active = 1")
    return rows.withColumns({"snapshot_date": _day(F.substring("source_file", 1, 8), "yyyyMMdd"), "is_active": F.lit(True)})


def load_latest_stock(spark: SparkSession, root: str) -> DataFrame:
    """Active rows of the last day's snapshot; no other file is read."""
    found = stock_files(listing(spark, root))
    last = found.join(found.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date", "left_semi")
    rows = read_chosen(spark, last, schemas.STOCK).where("is_active = 1")
    return rows.withColumns({"snapshot_date": _day(F.substring("source_file", 1, 8), "yyyyMMdd"), "is_active": F.lit(True)})


def load_forecasts(spark: SparkSession, root: str, target: date | None = None, tolerance: int = 7) -> DataFrame:
    """Rows of every forecast version, or of the one generated nearest to target within some days (of two, the earlier)."""
    found = forecast_files(listing(spark, root))
    if target is not None:
        away = F.abs(F.datediff("generated_date", F.lit(target)))
        found = first_per_key(found.where(away <= tolerance).withColumn("_all", F.lit(1)), ["_all"], [away, F.col("generated_date")])
    return read_chosen(spark, found, schemas.FORECAST).withColumn("generated_date", generated_in_path(F.col("source_path")))
