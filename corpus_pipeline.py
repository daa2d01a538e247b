"""The corpus pipeline: documents through stages of text operators, each written and reread.

Columns beside doc_id, text, lang and source pass through every stage but the last, whatever their names (but for those that begin with an
underscore). Null and empty texts are rejected by the quality stage (they have no perplexity); each later stage gives them a result of its own: exact dedup keeps
one, near dedup links them with nothing, they weigh nothing in the mix and encode to the end id alone. Ties are settled by ids.
An empty table passes through as one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replen.llm import exact, minhash, mixing, pieces, quality
from replen.llm.common import ascii_lower, stored
from replen.llm.queries import piece_model

#: The stage links at 0.8, whereas op1's own contract is 0.85. At exactly 0.8, 30 bands miss 6.7e-6 of pairs
#: and the sketches' limit that belongs to this screen rejects 5.7e-6.
NEAR = minhash.NearParams(percent=80, bands=30, screen=0.64)
#: Bytes of an Arrow batch: a worker holds a batch several times over (as sent, as pandas rows, as the groups cut from it), and Spark's 64 MB are meant
#: for larger executors.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold this session's Arrow batches to BATCH_BYTES; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower())
    if not now or not 0 < int(now[1]) * 1024 ** " kmgtp".index(now[2] or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under their language's perplexity limit; the model's trusted texts are all rows of docs labelled as good."""
    small_batches(spark)
    return quality.fit_and_keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which tells rows apart by id and text, also where ids are missing or repeat."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.xxhash64(F.reverse(text)).cast("string"))
    return docs.withColumn("_key", name)


def tie(docs: DataFrame) -> Column:
    """A number from a row's text and its columns beside id and text, which puts rows of equal keys in the same order in every run."""
    more = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text") and not c.startswith("_")]
    return F.xxhash64(F.coalesce("text", F.lit("")), F.to_json(F.struct(*more), {"ignoreNullFields": "false"}) if more else F.lit(""))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays; of rows that also repeat the id, one of them; a null id
    counts as the smallest."""
    small_batches(spark)
    decided = exact.deduplicate(docs, exact.dealt_load()).groupBy("text_sha256").agg(F.max("keep_id").alias("_keep"))
    decided = decided.select(F.col("text_sha256").alias("_sha"), F.coalesce("_keep", F.lit(0)).alias("_id"), F.col("_keep").isNull().alias("_none"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    keys = ["_sha", "_id", "_none"]
    rows = docs.withColumns({"_sha": sha, "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull()})
    rows = rows.join(decided.hint("merge"), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(tie(docs)))
    return rows.withColumn("_place", place).where("_place = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, linked at a similarity of 0.8 or more, the document with the least doc_id stays. Rows that repeat an id share its
    group and stay or go together; a row without an id takes part under a negative one made from its text."""
    small_batches(spark)
    near = docs.withColumn("_near", F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64("text"), 2)))
    decided = minhash.near_duplicates(near, NEAR, id_col="_near").where("kept").select(F.col("doc_id").alias("_near")).distinct().hint("merge")
    return near.join(decided, "_near", "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times), whether or not it has an id of its own.

    Of the rows of a key, the first ones take the most copies, so a key needs but the numbers of rows that are taken once or more, twice or more, and
    so on: rows are placed and joined by the key alone, and texts are shuffled once.
    """
    small_batches(spark)
    times = range(1, mixing.MixParams().most + 1)
    taken = mixing.mix(keyed(docs), id_col="_key").groupBy(F.col("doc_id").alias("_key")).agg(*[F.count_if(F.col("copies") >= c).alias(f"_rows_{c}") for c in times])
    place = F.row_number().over(Window.partitionBy("_key").orderBy(tie(docs)))
    rows = keyed(docs).withColumn("_place", place).join(taken.where("_rows_1 > 0").hint("merge"), "_key")
    copies = sum((F.col("_place") <= F.col(f"_rows_{c}")).cast("int") for c in times)
    return rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that the mix takes, once for each time it is taken."""
    small_batches(spark)
    return pieces.with_digests(pieces.encode(docs, pieces.model_bytes(piece_model())))


STAGES = [
    ("quality", of_quality),
    ("exact dedup", one_of_each_text),
    ("near dedup", one_of_each_group),
    ("mixing", mixed),
    ("encoding", encoded),
]
#: The models' smoothing, MinHash groups, balanced rates and ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
