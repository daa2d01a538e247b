"""Near-dedup: MinHash bands find candidates, odd sketches screen them, whole shingle sets confirm the links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replen.llm.common import components, forest, map_sorted_groups, may_be_among, stored, utf8

SKETCH_BITS = 512
LANES = [f"s{i}" for i in range(SKETCH_BITS // 64)]


@dataclass(frozen=True)
class NearParams:
    """percent: linked when 100 * intersection >= percent * union. samples MinHash values fold into the
    odd sketch; the first bands * rows of them also make the bands. screen: the similarity under
    which a sketch's estimate rejects a pair (some four standard deviations below 0.85); a lower percent
    needs a lower screen and more bands.
    block: members that one task compares with as many others at a time, and weight: shingles of those whose whole sets it compares."""

    percent: int = 85
    shingle: int = 5
    bands: int = 20
    rows: int = 5
    samples: int = 200
    screen: float = 0.72
    block: int = 512
    weight: int = 1 << 19
    seed: int = 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word windows; shorter texts are one window, wordless ones none."""
    words = utf8(text).lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), n)], np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


class Signer:
    """MinHash samples, band keys and odd sketches of many sets at a time."""

    def __init__(self, p: NearParams):
        r = np.random.RandomState(p.seed)
        self.p = p
        self.mul = (r.randint(0, 2**31, p.samples).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.add = r.randint(0, 2**31, p.samples).astype(np.uint32) << np.uint32(1)
        self.salt = r.randint(1, 2**62, p.samples).astype(np.uint64)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, samples): the least of each permutation's values; sets must not be empty."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[:-1])])
        out, buffer = np.empty((len(sets), self.p.samples), np.uint32), np.empty_like(flat)
        for k in range(self.p.samples):
            np.multiply(flat, self.mul[k], out=buffer)
            buffer += self.add[k]
            out[:, k] = np.minimum.reduceat(buffer, at)
        return out

    def bands(self, signed: np.ndarray) -> np.ndarray:
        out = np.empty((len(signed), self.p.bands), np.uint64)
        for b in range(self.p.bands):
            key = np.full(len(signed), b + 1, np.uint64)
            for k in range(b * self.p.rows, (b + 1) * self.p.rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, k].astype(np.uint64))
            out[:, b] = key
        return out.view(np.int64)

    def sketches(self, signed: np.ndarray) -> np.ndarray:
        """Each sample toggles one bit; equal samples of two sets cancel in the XOR of their sketches."""
        bit = (_mix(signed.astype(np.uint64) + self.salt) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))).astype(np.int64)
        spot = bit + np.arange(len(signed))[:, None] * SKETCH_BITS
        odd = np.bincount(spot.ravel(), minlength=len(signed) * SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(signed), -1)


def most_bits(p: NearParams) -> int:
    """XOR bits at which a sketch pair's estimated similarity is p.screen: a set bit is expected for
    n/2 * (1 - (1 - 2/n)^d) of n when d toggles do not cancel, and d = 2 * samples * (1 - similarity)."""
    d = 2 * p.samples * (1 - p.screen)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** d))


def features(docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), band keys and odd sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(p)

        def out(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
            full = [s for s in sets if len(s)]
            signed = signer.sign(full) if full else np.zeros((0, p.samples), np.uint32)
            bands, sketch = iter(signer.bands(signed)), iter(signer.sketches(signed) if full else [])
            pdf = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": np.array([len(s) for s in sets], np.int64)})
            pdf["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            pdf["bands"] = [next(bands) if len(s) else None for s in sets]
            pdf["sketch"] = [next(sketch) if len(s) else None for s in sets]
            return pdf

        for pdf in batches:
            ids, sets, n = [], [], 0
            for i, t in zip(pdf["doc_id"].array, pdf["text"]):
                ids.append(None if pd.isna(i) else int(i))
                sets.append(shingles(t, p.shingle))
                n += len(sets[-1])
                if n >= 1 << 17:
                    yield out(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield out(ids, sets)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    )


def in_blocks(rows: DataFrame, key: str, most: int, weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """Give each row its place in the comparisons that its key still needs, block by block.

    rows have a column core: members that are known to hang together, so that only pairs with a member outside the core are compared.
    Adds a (this row's block) and x, y (the two blocks that a task compares). A block has about `most` members and, if a weight is named,
    most_weight of it; every pair of blocks is a group of its own, so that no task gets a whole large key.
    """
    heavy = F.sum(weight) / most_weight if weight else F.lit(0)
    sizes = rows.groupBy(key, "core").agg(F.ceil(F.greatest(F.count("*") / most, heavy)).cast("int").alias("blocks"))
    sizes = sizes.groupBy(key).agg(
        F.max(F.when(~F.col("core"), F.col("blocks"))).alias("outer"), F.coalesce(F.max(F.when(F.col("core"), F.col("blocks"))), F.lit(0)).alias("inner")
    )
    placed = rows.join(sizes.where("outer > 0"), key)
    place = F.xxhash64("doc_id")
    placed = placed.withColumn("a", F.when(F.col("core"), F.col("outer") + F.pmod(place, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(place, F.col("outer"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(F.col("core"), 0).otherwise(F.col("inner")))))
    return placed.select(
        *rows.columns, "a", F.least("a", "other").cast("int").alias("x"), F.greatest("a", "other").cast("int").alias("y")
    )


def undecided(placed: DataFrame, key: str, limit: float) -> DataFrame:
    """The rows of placed (key, distance from the key's pivot) that may be linked other than through the pivot, and whether they are its core.

    The core lies within the limit of the pivot, which links it together. Distances obey the triangle inequality, so a member beyond the limit
    is linked at most with those of the core that lie less than the limit nearer to the pivot. Keys without such members are decided.
    """
    apart = placed.where(F.col("distance") > limit).groupBy(key).agg(F.min("distance").alias("nearest"))
    rows = placed.join(apart, key).withColumn("core", F.col("distance") <= limit)
    return rows.where(~F.col("core") | (F.col("distance") >= F.col("nearest") - limit - 1e-9)).drop("nearest")


def screened(feats: DataFrame, p: NearParams) -> DataFrame:
    """Edges (a, b) that hold together what the bands propose and the odd sketches let through.

    Bands of one member are left out. The members of a band are compared with its first one; those that pass are held together by it, and only
    the others go on to be compared with the rest of their band, block by block. Of the pairs that pass there, only a
    spanning forest leaves a task.
    """
    rows = feats.select(F.explode("bands").alias("band"), "doc_id", *[F.col("sketch")[i].alias(c) for i, c in enumerate(LANES)])
    limit = most_bits(p)
    shared = stored(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "near-bands")
    rows = stored(may_be_among(rows, "band", shared).join(shared.hint("merge"), "band"), "near-banded")
    pivots = rows.groupBy("band").agg(F.min(F.struct("doc_id", *LANES)).alias("pivot"))
    distance = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"pivot.{c}"))) for c in LANES), F.lit(0))
    placed = stored(rows.join(pivots, "band").select("band", "doc_id", *LANES, F.col("pivot.doc_id").alias("pivot"), distance.alias("distance")), "near-placed")
    near = placed.where((F.col("distance") <= limit) & (F.col("doc_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    rest = undecided(placed, "band", limit).select("band", "doc_id", *LANES, "core")

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, block = pdf["doc_id"].to_numpy(np.int64), pdf["a"].to_numpy()
        sketch = np.stack([pdf[c].to_numpy(np.int64) for c in LANES], 1).view(np.uint64)  # bits of signed numbers are counted without their sign
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            own = other = np.arange(s, e)
            if x[s] != y[s]:
                own, other = own[block[own] == x[s]], other[block[other] == y[s]]
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                bits = np.zeros((len(part), len(other)), np.uint16)
                for lane in range(sketch.shape[1]):
                    bits += np.bitwise_count(sketch[part, lane][:, None] ^ sketch[other, lane][None, :])
                i, j = np.nonzero(bits <= limit)
                links = forest(part[i] - s, other[j] - s, e - s)
                if links:
                    found.append(ids[np.array(links) + s])
        pairs = np.concatenate(found)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    others = map_sorted_groups(in_blocks(rest, "band", p.block), ["band", "x", "y"], run, "a long, b long")
    return near.unionByName(others).distinct()


def shared_counts(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that occur in two sets or more."""
    both = sets + (others or [])
    flat, inverse, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    spot = np.full(len(flat), -1)
    spot[n > 1] = np.arange((n > 1).sum())
    col = spot[inverse]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    m, wide = len(sets), 4096
    out = np.zeros((m, len(both) if others is None else len(others)), np.float64)
    for at in range(0, int((n > 1).sum()), wide):
        i, j = np.searchsorted(col, [at, at + wide])
        grid = np.zeros((len(both), wide), np.float32)
        grid[row[i:j], col[i:j] - at] = 1
        out += grid[:m] @ (grid if others is None else grid[m:]).T
    return out.round().astype(np.int64)


def from_pivot(members: DataFrame, p: NearParams) -> DataFrame:
    """family, doc_id, size, distance: the Jaccard distance of each member's whole set from that of the family's first document.

    A family is dealt over blocks of bounded weight, and its first document goes to each of them.
    """
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / p.block, F.sum("size") / p.weight)).cast("int").alias("blocks"))
    is_pivot = F.col("doc_id") == F.col("family")
    rows = members.join(blocks, "family").withColumn(
        "a", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))))
    )
    rows = rows.select("family", "a", (~is_pivot).cast("int").alias("place"), "doc_id", "size", "text")

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        distance = np.zeros(len(pdf))
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            if e - s == 1:
                continue
            sets = [shingles(t, p.shingle) for t in pdf["text"].iloc[s:e]]
            pivot = max((t for t, place in zip(sets, pdf["place"].iloc[s:e]) if not place), key=len)  # an id that repeats may lack words once
            for i, t in enumerate(sets):
                at = np.minimum(np.searchsorted(pivot, t), len(pivot) - 1)
                shared = int((pivot[at] == t).sum()) if len(pivot) else 0
                distance[s + i] = 1 - shared / max(1, len(t) + len(pivot) - shared)
        yield pdf[["family", "doc_id", "size"]].assign(distance=distance)

    return map_sorted_groups(rows, ["family", "a"], run, "family long, doc_id long, size long, distance double").distinct()


def confirmed(families: DataFrame, docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that hold together the links between members of a family (doc_id, family, size), counted on whole shingle sets.

    Members are compared with the family's first document, which holds together those that it links; only the others are compared with the rest.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = may_be_among(texts, "doc_id", families.select("doc_id"))
    members = families.hint("merge").join(texts, "doc_id").withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "family", "same"]).drop("same")
    members = stored(members, "near-texts")
    placed = stored(from_pivot(members, p), "near-distances")
    limit = 1 - p.percent / 100 + 1e-12
    near = placed.where((F.col("distance") <= limit) & (F.col("doc_id") != F.col("family"))).select(F.col("family").alias("a"), F.col("doc_id").alias("b"))
    rest = undecided(placed, "family", limit).select("family", "doc_id", "size", "core").distinct()
    rows = in_blocks(rest, "family", p.block, "size", p.weight).hint("merge").join(members.select("doc_id", "text"), "doc_id")

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, block = pdf["doc_id"].to_numpy(np.int64), pdf["a"].to_numpy()
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            own = other = np.arange(e - s)
            if x[s] != y[s]:
                own, other = np.flatnonzero(block[s:e] == x[s]), np.flatnonzero(block[s:e] == y[s])
            if e - s < 2 or not (len(own) and len(other)):
                continue
            sets = [shingles(t, p.shingle) for t in pdf["text"].iloc[s:e]]
            size = np.array([len(t) for t in sets])
            shared = shared_counts([sets[i] for i in own], None if own is other else [sets[i] for i in other])
            union = size[own][:, None] + size[other][None, :] - shared
            i, j = np.nonzero((100 * shared >= p.percent * union) & (union > 0))
            links = forest(own[i], other[j], e - s)
            if links:
                found.append(ids[np.array(links) + s])
        pairs = np.concatenate(found)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return near.unionByName(map_sorted_groups(rows, ["family", "x", "y"], run, "a long, b long")).distinct()


def equal_sets(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, rep, n) of the documents with equal sets, and the rows of feats of their representatives (the least ids)."""
    rows = feats.where("digest is not null and doc_id is not null")
    classes = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near-classes")
    return classes, feats.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")


def linked_classes(docs: DataFrame, reps: DataFrame, edges: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """node, label: components of the confirmed links among representatives that hang together by screened edges (a, b)."""
    families = components(edges, "near-families")
    members = families.select(F.col("node").alias("doc_id"), F.col("label").alias("family"))
    members = members.unionByName(members.select(F.col("family").alias("doc_id"), "family").distinct())
    sizes = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    members = stored(members.join(sizes, "doc_id"), "near-members")
    return components(confirmed(members, docs, p, id_col, text_col), "near-groups")


def with_components(feats: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of feats: the label of its class's representative, or the representative."""
    named = (
        classes.join(groups.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .where("n > 1 or label is not null")
        .select("digest", F.coalesce("label", "rep").alias("component_id"))
    )
    # Empty sets have no digest; a key of their own deals them evenly.
    feats = feats.withColumn("digest", F.coalesce("digest", F.xxhash64("doc_id").cast("string").cast("binary")))
    return feats.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(
    docs: DataFrame, params: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of near-duplicate documents by the similarity of their sets of word shingles.

    1. Documents with equal sets are one class, with the least id as its representative (a grouped minimum).
    2. Representatives that share a MinHash band are compared by odd sketch; what passes makes families.
    3. In each family, whole shingle sets are compared and links confirmed; components of confirmed links are the groups.
    In 2 and 3, what is near the first member hangs together through it, so a large group of near copies costs one comparison a member.
    Two documents that are linked directly share no band with a chance of some 1e-5, or fail the sketch with about as much.

    Returns one row per input row: doc_id, n_shingles, component_id (least id reachable), kept
    (doc_id = component_id). Null and wordless texts have an empty set and are linked with nothing. Ids are integers (others
    raise TypeError) and should be unique: rows that repeat an id share its group (those without words have none); rows with a null id are returned with component_id null and
    kept false. An empty table gives an empty one. Other columns are left out.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    feats = stored(features(docs, params, id_col, text_col), "near-features")
    classes, reps = equal_sets(feats)
    groups = linked_classes(docs, reps, screened(reps, params), params, id_col, text_col)
    rows = with_components(feats, classes, groups)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
