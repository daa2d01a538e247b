"""Ingest checks, upserts and refresh of derived tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replen.functions.sku import with_sku_parts


def check_schema(df: DataFrame, expected: T.StructType, numeric: tuple[str, ...] = ()) -> tuple[bool, list[str]]:
    """Whether df has the expected columns, numbers where they are asked for, and any row."""
    errors = [f"missing column {f.name}" for f in expected.fields if f.name not in df.columns]
    errors += [f"column {c} is not numeric" for c in numeric if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)]
    if not errors and df.isEmpty():
        errors.append("no rows")
    return not errors, errors


def category_quality(category: DataFrame) -> DataFrame:
    return category.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("model").isNull()).alias("null_models"),
        F.count_if(F.length("model") != 5).alias("odd_models"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("grupa", "podgrupa", "kategoria")],
    )


def category_distribution(category: DataFrame) -> DataFrame:
    return category.groupBy("podgrupa").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "podgrupa")


def data_summary(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count("*").alias("n"), F.count_distinct("sku").alias("n_skus"), F.count_distinct("order_id").alias("n_orders"),
        F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"), F.sum("total_amount").alias("revenue"),
    )


def sales_records(raw: DataFrame, batch_id: str, source_file: Column) -> DataFrame:
    """Raw rows with the SKU's parts, month, batch and source, as they are stored."""
    return with_sku_parts(raw).withColumns({"year_month": F.date_format("sale_date", "yyyy-MM"), "batch_id": F.lit(batch_id), "source_file": source_file})


def forecast_records(raw: DataFrame, generated, source: str) -> DataFrame:
    """Forecast rows with the SKU's parts, generation date and source."""
    return with_sku_parts(raw).withColumns({"generated_date": F.lit(generated), "source": F.lit(source)})


def stock_records(raw: DataFrame, snapshot, source: str) -> DataFrame:
    """Stock rows with the SKU's parts, snapshot date and source."""
    return with_sku_parts(raw).withColumns({"snapshot_date": F.lit(snapshot), "source": F.lit(source)})


def import_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("file_type", "status").agg(F.count("*").alias("n"))


def with_bom_name(meta: DataFrame, bom: DataFrame) -> DataFrame:
    """Model metadata with the main material's name."""
    return meta.join(bom.select("model", "main_material_name"), "model", "left")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; raises when a key occurs twice (runs a job, for tests and small dimensions)."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by order: a deterministic dropDuplicates."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: one for each key that target lacks."""
    order = [F.col(c).asc_nulls_last() for c in rows.columns]
    return first_per_key(rows, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows in place of those of the same keys; of rows that repeat a key the first one counts."""
    rows = first_per_key(rows, keys, [F.col(c).asc_nulls_last() for c in rows.columns])
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def new_generations(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Forecast rows to append: those of generation dates that target has not seen, one for each SKU and day."""
    unseen = rows.join(target.select("generated_date").distinct(), "generated_date", "left_anti").select(rows.columns)
    return insert_ignore(target, unseen, ["sku", "forecast_date", "generated_date"])


#: Derived tables that are refreshed together.
REFRESH_GROUPS = {"stock": ("latest_stock",), "forecast": ("latest_forecast",), "cache": ("monthly_aggregation", "entity_stats"), "states": ("monthly_states",), "history": ("stock_intervals", "snapshot_days")}


def refresh(before: dict[str, DataFrame], after: dict[str, DataFrame], group: str = "all") -> DataFrame:
    """view, rows_before, rows_after, changed of a group's tables (of all for "all"); the tables themselves are left to the caller to write."""
    names = [n for g, views in REFRESH_GROUPS.items() if group in ("all", g) for n in views if n in after]
    out = None
    for n in names:
        old = before[n].agg(F.count("*").alias("rows_before")) if n in before else after[n].sparkSession.range(1).select(F.lit(0).cast("long").alias("rows_before"))
        row = after[n].agg(F.count("*").alias("rows_after")).crossJoin(old).select(F.lit(n).alias("view"), "rows_before", "rows_after")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError(f"no table of group {group} is given")
    return out.withColumn("changed", F.col("rows_after") - F.col("rows_before"))


MANIFEST = "generation long, view string, written long, n_rows long"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last manifest: view, written (the generation that its files are of), n_rows; none before the first."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.join(F.broadcast(rows.agg(F.max("generation").alias("generation"))), "generation", "left_semi")  # one row


def publish(tables: dict[str, DataFrame], root: str, generation: int, group: str = "all") -> DataFrame:
    """Rebuild a group's derived tables and let readers see them all at once: view, rows_before, rows_after, changed.

    Each table is written to files of its own generation; a manifest that names the files of every view is written last, in one file, so readers see
    either the generation before or the new one, whole. A run that fails earlier changes nothing for them and may be run again under the same number.
    Views that are not rebuilt keep their files. generation must be over the last one published. One row a view comes to the driver.
    """
    names = [n for g, views in REFRESH_GROUPS.items() if group in ("all", g) for n in views if n in tables]
    if not names:
        raise ValueError(f"no table of group {group} is given")
    spark = tables[names[0]].sparkSession
    before = {r["view"]: r for r in _manifest(spark, root).collect()}
    if any(r["generation"] >= generation for r in before.values()):
        raise ValueError(f"generation {generation} does not come after the last one")
    after = {view: (generation, view, r["written"], r["n_rows"]) for view, r in before.items()}
    for name in names:
        path = f"{root}/{name}/generation={generation}"
        tables[name].write.mode("overwrite").parquet(path)
        after[name] = (generation, name, generation, spark.read.parquet(path).count())
    spark.createDataFrame(list(after.values()), MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{generation}")
    rows = [(n, before[n]["n_rows"] if n in before else 0, after[n][3]) for n in names]
    return spark.createDataFrame(rows, "view string, rows_before long, rows_after long").withColumn("changed", F.col("rows_after") - F.col("rows_before"))


def generation(spark: SparkSession, root: str, view: str) -> int:
    """The generation that wrote a view as it is published."""
    row = _manifest(spark, root).where(F.col("view") == view).first()
    if row is None:
        raise ValueError(f"{view} was never published")
    return row["written"]


def published(spark: SparkSession, root: str, view: str) -> DataFrame:
    """A view's rows in the last published generation."""
    return spark.read.parquet(f"{root}/{view}/generation={generation(spark, root, view)}")


def rebuild_entity_type(df: DataFrame, path: str) -> None:
    """Write a derived table partitioned by entity_type: the partitions of the types in df are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_type").parquet(path)


def top_versioned(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """The n rows of the last valid versions with the largest value of a column."""
    return latest_version(df, keys).orderBy(F.desc(by), *keys).limit(n)


def new_files(listing: DataFrame, imports: DataFrame) -> DataFrame:
    """Files (path, content as read by binaryFile, file_type) whose SHA-256 was not imported yet for their type."""
    rows = listing.withColumn("file_hash", F.sha2("content", 256)).drop("content")
    return rows.join(imports.select("file_hash", "file_type"), ["file_hash", "file_type"], "left_anti")


def admitted(listing: DataFrame, imports: DataFrame) -> DataFrame:
    """Files (path, file_hash, file_type) to import: of each content and type that was not imported yet the least path, so that copies within one
    batch count once too. Types and digests that are null equal nothing that was imported."""
    unseen = listing.join(imports.select("file_hash", "file_type"), ["file_hash", "file_type"], "left_anti").select(listing.columns)
    return first_per_key(unseen, ["file_hash", "file_type"], [F.col("path")])


def import_log(admitted_files: DataFrame, status: str = "imported") -> DataFrame:
    """Rows to append to the imports once the files' rows are stored: path, file_type, file_hash, status."""
    return admitted_files.select("path", "file_type", "file_hash", F.lit(status).alias("status"))


def touched(batch: DataFrame) -> DataFrame:
    """Entities whose derived rows a batch of sales invalidates: its SKUs and models."""
    sku = batch.select(F.lit("sku").alias("entity_type"), F.col("sku").alias("entity_id"))
    return sku.unionByName(batch.select(F.lit("model").alias("entity_type"), F.col("model").alias("entity_id"))).distinct()


def refreshed(old: DataFrame, recomputed: DataFrame, keys: DataFrame) -> DataFrame:
    """The derived table after an invalidation: rows of touched entities come from the recomputation, others stay."""
    on = ["entity_type", "entity_id"]
    return old.join(keys, on, "left_anti").unionByName(recomputed.join(keys, on, "left_semi"))


def latest_version(df: DataFrame, keys: list[str], version: str = "cache_version") -> DataFrame:
    """All rows of the last valid version of each key."""
    rows = df.where("is_valid")
    last = F.max(version).over(Window.partitionBy(*keys))
    return rows.withColumn("_last", last).where(F.col(version) == F.col("_last")).drop("_last")


def usable(cached: DataFrame, digest: str) -> DataFrame:
    """Cached rows that the same settings gave."""
    return cached.where(F.col("configuration_hash") == digest)
