"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests before exact buckets are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replen.llm.common import ascii_lower, map_sorted_groups, may_be_among, stored

#: Digests that one shard of a filter is meant to hold; the number of shards grows with the tables.
SHARD_KEYS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys.

    A key's three slots lie in three neighbouring segments; slots that hold one key are
    peeled in rounds, and fingerprints are then set from the last round to the first, so
    that the three slots of each key XOR to its fingerprint. No key is ever missed; other
    keys pass with a chance of 1 in 256.
    """

    def __init__(self, seed: int, length: int, count: int, cells: np.ndarray):
        self.seed, self.length, self.count, self.cells = seed, length, count, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        segment = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        g = _mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
        within = np.stack([g, g >> np.uint64(20), g >> np.uint64(40)]) & np.uint64(length - 1)
        places = (segment + np.arange(3, dtype=np.uint64)[:, None]) * np.uint64(length) + within
        return places.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        length = min(1 << 18, 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        for seed in range(1, 200):
            count = max(1, int(np.ceil(n * factor / length)) - 2 + seed // 20)
            places, prints = cls._places(keys, seed, length, count)
            cells = np.zeros((count + 2) * length, np.uint8)
            load = np.bincount(places.ravel(), minlength=len(cells))
            held = np.zeros(len(cells), np.int64)  # XOR of the indexes of the keys of a slot
            for p in places:
                np.bitwise_xor.at(held, p, np.arange(len(keys)))
            rounds, left = [], len(keys)
            alone = np.flatnonzero(load == 1)
            while len(alone):
                own, at = np.unique(held[alone], return_index=True)
                slot = alone[at]
                rounds.append((own, slot))
                left -= len(own)
                touched = places[:, own]
                np.subtract.at(load, touched.ravel(), 1)
                for p in touched:
                    np.bitwise_xor.at(held, p, own)
                near = np.unique(touched)
                alone = near[load[near] == 1]
            if left:
                continue
            for own, slot in reversed(rounds):
                cells[slot] = 0
                a, b, c = places[:, own]
                cells[slot] = prints[own] ^ cells[a] ^ cells[b] ^ cells[c]
            return cls(seed, length, count, cells)
        raise RuntimeError("the filter's keys could not be peeled")

    def has(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._places(keys.astype(np.uint64), self.seed, self.length, self.count)
        return self.cells[a] ^ self.cells[b] ^ self.cells[c] == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.length, self.count], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> FuseFilter:
        return cls(*np.frombuffer(blob[:24], np.int64).tolist(), np.frombuffer(blob[24:], np.uint8))


def digests(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, load, sha (32 bytes), if asked for also text, of docs (doc_id, text, load): A-Z lower-cased, null as empty."""
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    return docs.select("doc_id", "load", sha.alias("sha"), *(["text"] if keep_text else []))


def _shard(shards: int):
    """A digest's shard and the 64-bit key that stands for it in a filter."""
    key = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).alias("shard"), key.alias("key")


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """shard, load, blob: a filter for each shard of each immutable load of groups (load, sha)."""

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        keys, ends = pdf["key"].to_numpy(), [*starts[1:], len(pdf)]
        first = pdf.iloc[starts]
        blobs = [FuseFilter.build(keys[a:b]).to_bytes() for a, b in zip(starts, ends)]
        yield pd.DataFrame({"shard": first["shard"].to_numpy(), "load": first["load"].to_numpy(), "blob": blobs})

    return map_sorted_groups(groups.select(*_shard(shards), "load"), ["shard", "load"], run, "shard long, load int, blob binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows (load, sha) of groups that the filter of some earlier load lets through."""
    probes = groups.select(*_shard(shards), F.lit(1).alias("kind"), "load", "sha")
    rows = probes.unionByName(
        filters.select("shard", F.lit(0).cast("long").alias("key"), F.lit(0).alias("kind"), "load", F.col("blob").alias("sha"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, {}  # the filters of the shard at hand; rows come sorted, filters first
        for pdf in batches:
            shard, kind, load, sha = (pdf[c].to_numpy() for c in ("shard", "kind", "load", "sha"))
            keys = pdf["key"].to_numpy(np.int64)  # never null: pandas would round keys beside nulls
            passed = np.zeros(len(pdf), bool)
            edge = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]) | (load[1:] != load[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(pdf)]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, kept = shard[a], {}
                if kind[a] == 0:
                    kept[load[a]] = FuseFilter.from_bytes(sha[a])
                    continue
                for earlier, f in kept.items():
                    if earlier < load[a]:
                        passed[a:b] |= f.has(keys[a:b])
            yield pdf.loc[passed, ["load", "sha"]]

    return (
        rows.repartition("shard").sortWithinPartitions("shard", "kind", "load").mapInPandas(run, "load int, sha binary")
    )


def texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, sha, text: one text of each id and digest in asked. An id may repeat with other texts, so the digest is part of the key."""
    texts = may_be_among(texts.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", asked.select("doc_id"))
    return digests(texts, True).join(asked.hint("merge"), ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]).select("doc_id", "sha", "text")


def deduplicate(docs: DataFrame, load: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact duplicates over loads that came one after another; each load is an immutable snapshot for the later ones.

    load: an int expression, not null; the loads' numbers follow the order in which they came.

    Within a load, equal digests are grouped. A load's distinct digests are then screened by the
    filters of the earlier snapshots; what passes is joined with their exact buckets on the
    whole SHA-256, and one text of each side is compared byte for byte. Texts are equal when
    identical after lower-casing A-Z; the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null
    texts count as empty. Rows that repeat an id share its decision. A null id never stays,
    unless no row of its group has one: then keep_id is null and kept false. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), load.cast("int").alias("load"))
    rows = stored(digests(texts), "exact-digests")
    groups = stored(
        rows.groupBy("load", "sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.min("doc_id").alias("first")),
        "exact-groups",
    )
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    filters = build_filters(groups, shards)
    passed = screen(groups, filters, shards).withColumnRenamed("load", "later")
    pairs = stored(
        passed.join(groups.select("sha", "load", F.col("first").alias("old")), "sha")
        .where("load < later")
        .groupBy("sha", "later")
        .agg(F.min_by("old", "load").alias("old"))
        .join(groups.select("sha", F.col("load").alias("later"), F.col("first").alias("new")), ["sha", "later"]),
        "exact-pairs",
    )
    asked = pairs.select("sha", F.explode(F.array("old", "new")).alias("doc_id")).distinct()
    found = texts_of(texts, asked)
    differ = (
        pairs.join(found.select("sha", F.col("doc_id").alias("old"), F.col("text").alias("old_text")), ["old", "sha"])
        .join(found.select("sha", F.col("doc_id").alias("new"), F.col("text").alias("new_text")), ["new", "sha"])
        .where((F.col("old_text") != F.col("new_text")) & (ascii_lower(F.col("old_text")) != ascii_lower(F.col("new_text"))))
        .select("sha", F.col("later").alias("load"), F.lit(1).alias("other"))
    )
    parted = stored(groups.join(differ, ["sha", "load"], "left").withColumn("other", F.when(F.col("other") == 1, F.col("load")).otherwise(-1)), "exact-parted")
    whole = parted.groupBy("sha", "other").agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"))
    decided = parted.select("sha", "load", "other").join(whole, ["sha", "other"]).drop("other")
    several = decided.where("group_size > 1")
    return rows.join(several, ["sha", "load"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dealt_load(n: int = 3, id_col: str = "doc_id") -> Column:
    """A load from 0 to n - 1 by a hash of the id, for tables that do not record theirs; results do not depend on it."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))), F.lit(n)).cast("int")


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write an immutable snapshot of docs under path: its exact buckets (sha, n, first, last) and their filters, one a shard.

    Later batches are screened by it with screen_batch(); it is never changed, a new batch gets a snapshot of its own.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).alias("load"))
    rows = digests(texts).groupBy("load", "sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.min("doc_id").alias("first"))
    rows.write.parquet(f"{path}/buckets")
    groups = docs.sparkSession.read.parquet(f"{path}/buckets")
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    build_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")


def screen_batch(batch: DataFrame, paths: list[str], earlier: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which texts of a new batch stand in stored snapshots or repeat within the batch.

    paths: snapshots by write_snapshot(), in the order in which they came; earlier: the documents they were made of (same columns), for the
    byte checks. The batch's digests are grouped on their own; each snapshot's filters screen them, positives are joined with its exact buckets, and
    one text of each side is compared byte for byte.

    Returns one row per row of batch: doc_id, text_sha256, keep_id (largest id of the text within the batch), group_size (there), known_id (the least id of
    the first snapshot that has the text, else null), kept (new, and the row that stays). Null texts count as empty; a null id is never kept;
    rows that repeat an id share its decision. Empty tables and no snapshots are allowed.
    """
    spark = batch.sparkSession
    texts = batch.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(1).alias("load"))
    rows = stored(digests(texts), "batch-digests")
    groups = stored(rows.groupBy("load", "sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("doc_id").alias("new")), "batch-groups")
    known = None
    for order, path in enumerate(paths):
        filters = spark.read.parquet(f"{path}/filters")
        shards = (filters.select("shards").first() or [1])[0]
        passed = screen(groups, filters.drop("shards"), shards).select("sha")
        hit = passed.join(spark.read.parquet(f"{path}/buckets").select("sha", F.col("first").alias("old")), "sha").withColumn("order", F.lit(order))
        known = hit if known is None else known.unionByName(hit)
    if known is None:
        pairs = groups.select("sha", "new", F.lit(None).cast("long").alias("old")).where("false")
    else:
        pairs = known.groupBy("sha").agg(F.min_by("old", "order").alias("old")).join(groups.select("sha", "new"), "sha")
    pairs = stored(pairs.where("old is not null and new is not null"), "batch-pairs")
    before = earlier.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).alias("load"))
    old_texts = texts_of(before, pairs.select("sha", F.col("old").alias("doc_id"))).select("sha", F.col("doc_id").alias("old"), F.col("text").alias("old_text"))
    new_texts = texts_of(texts, pairs.select("sha", F.col("new").alias("doc_id"))).select("sha", F.col("doc_id").alias("new"), F.col("text").alias("new_text"))
    same = (F.col("old_text") == F.col("new_text")) | (ascii_lower(F.col("old_text")) == ascii_lower(F.col("new_text")))
    sure = pairs.join(old_texts, ["old", "sha"]).join(new_texts, ["new", "sha"]).where(same).select("sha", F.col("old").alias("known_id"))
    decided = groups.join(sure, "sha", "left").select("sha", "keep_id", F.col("n").alias("group_size"), "known_id")
    own = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return rows.join(decided, "sha").select(
        "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", "known_id", (own & F.col("known_id").isNull()).alias("kept")
    )
