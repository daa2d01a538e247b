"""Helpers that the text operators share: written tables in the shared folder, and streaming over sorted groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where one machine runs all tasks (local mode, as in tests) may it be unset;
    then a folder of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="replen-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/replen/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Remove the tables that stored() and the n-gram blocks wrote. Results read them when they are computed, so this is for the end, when
    they have been written."""
    for t in spark.catalog.listTables():
        if re.fullmatch(r"\w+_blocks_[0-9a-f]{32}", t.name):
            spark.sql(f"drop table if exists {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/replen")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Parts that the edges of a node are dealt in, in components().
SALTS = 8
#: Bits of the bitmaps of may_be_among(): 8 MB, whatever the tables' sizes.
BITMAP_BITS = 1 << 26


def may_be_among(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows whose key may be in asked (one column named key): all that are, and few others while asked is small.

    A step before a join with asked that spares wide rows the shuffle. asked's hashes become one
    bitmap of fixed size, at most 2,048 rows of 4 kB, so broadcasting it is safe at any scale; a full one lets every row pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    bits = asked.select(place.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("_page")).agg(F.expr("bitmap_construct_agg(pmod(at, 32768))").alias("_bits"))
    rows = rows.withColumn("_at", place).withColumn("_page", F.floor(F.col("_at") / 32768)).join(F.broadcast(bits), "_page")
    rows = rows.where("getbit(cast(conv(hex(substring(_bits, cast(pmod(_at, 32768) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(pmod(_at, 8) as int)) = 1")
    return rows.drop("_at", "_page", "_bits")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1
    ).cast("long")


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def pieces_of(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each."""
    ends = np.cumsum([len(t) if t else 0 for t in texts])
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, end
        start = end


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Bring the rows of a group together and call fn(rows, starts) on runs of whole groups.

    For bounded groups only: fn gets as many whole groups as an Arrow batch holds, so
    that many small groups cost one call. `starts` are the groups' first positions.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            edge = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1].iloc[-1]
                edge[0] = any(last[k] != pdf[k].iloc[0] for k in keys)
            at = np.flatnonzero(edge)
            if not len(at):
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf.iloc[: at[-1]]], ignore_index=True) if held else pdf.iloc[: at[-1]]
            if len(whole):
                yield from fn(whole, group_starts(whole, keys))
            held = [pdf.iloc[at[-1] :]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield from fn(whole, group_starts(whole, keys))

    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    edge = np.zeros(len(pdf), bool)
    edge[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(edge)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links a[i]-b[i] among n members, as (root, member) pairs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(r, i) for i in range(n) if (r := root(i)) != i]


def components(edges: DataFrame, name: str, most_rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): node, label (the smallest node reachable); nodes without edges are absent.

    Alternating large-star and small-star rounds: each joins every node with the least
    of its neighbours, so the number of rounds grows with the logarithm of the longest path.
    Each round is a written table; no edge or label passes through the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # A node of many edges is dealt over some parts, in both joins.
        dealt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        edges = now.select(F.col("b").alias("a"), F.col("a").alias("b")).select("*", dealt)
        large = edges.join(least.select("*", parts), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.select("*", dealt).join(least.select("*", parts), ["a", "salt"])
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        now = stored(small.where("a <> b").distinct(), name)
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(cast(pmod(xxhash64(b, a), 1000000007) as decimal(38,0)))").alias("s")).first()
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
