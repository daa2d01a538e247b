"""N-gram Jaccard join: size-banded tiles of documents, hashed bitmaps that bound the overlap, whole sorted sets that decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replen.llm.common import forest, map_sorted_groups, may_be_among, stored
from replen.llm.minhash import NearParams, _mix, equal_sets, in_blocks, linked_classes, shingles, undecided, with_components

#: Bits of the smallest bitmaps.
BITS = 2048
#: Sizes of a band lie within this ratio; 64 bands go beyond any text.
RATIO, BANDS = 1.6, 64
JOIN = NearParams(percent=85, shingle=4)


def edges_of_bands() -> list[int]:
    """Sizes at which bands begin (the first at 1)."""
    out = [1]
    while len(out) < BANDS + 1:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


EDGES = edges_of_bands()


def most_apart(size: int, percent: int) -> int:
    """The most elements in which a set of this size can differ from one linked with it that is as large or larger: of a union of at most
    size * 100 / percent, (100 - percent) percent."""
    return size * (100 - percent) // percent


@cache
def slices(band: int, percent: int) -> int:
    """Slices that the sets of a band's tiles are cut in: more than two linked sets can differ in, so that they agree in one at least, and some more,
    so that they hardly ever agree in empty ones only."""
    apart = most_apart(EDGES[band + 1] - 1, percent)
    return apart + 2 + apart // 16


def band_of(size: int) -> int:
    return int(np.searchsorted(EDGES, size, "right")) - 1


def least_partner(size: int, percent: int) -> int:
    """The size of the smallest set that can be linked with one of this size."""
    return -(-size * percent // 100)


def tile_keys(sets: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles that a set (sorted 64-bit hashes) lies in; the band is in their lowest six bits.

    Two linked sets meet in a tile. Let the smaller be of band b. Both take the tiles of b: the larger one's size may lie in a later band, so
    each set takes those of all bands that a smaller partner may have. There both are cut alike, by hash, into k slices; linked sets differ in fewer elements than
    k, so they agree in slices, and a slice's key is a hash of all it holds. Empty slices are no tiles: a set that has so few
    that it must agree with any linked one in others as well does without. The few sets with more of them also take tiles for the empty ones.
    """
    n, out = len(sets), []
    high, low = sets >> np.uint64(32), _mix(sets * np.uint64(0x9E3779B97F4A7C15))
    for band in range(band_of(least_partner(n, percent)), band_of(n) + 1):
        k, apart = slices(band, percent), most_apart(min(n, EDGES[band + 1] - 1), percent)
        part = ((high * np.uint64(k)) >> np.uint64(32)).astype(np.int64)  # in order, as the sets are sorted
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        key = np.add.reduceat(low, at) + part[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        if k - len(at) >= k - apart:  # it may agree with another in empty slices only
            empty = np.setdiff1d(np.arange(k), part[at]).astype(np.uint64)
            key = np.r_[key, _mix(empty + np.uint64(0x165667B19E3779F9))]
        out.append((_mix(key + np.uint64(band)) & ~np.uint64(63)) | np.uint64(band))
    return np.concatenate(out).view(np.int64)


@cache
def width(band: int) -> int:
    """Bits of the bitmaps that a band's tiles compare: half as many as its largest sets have elements, so that unrelated sets differ in more bits than
    linked ones may."""
    bits = BITS
    while bits < EDGES[band + 1] // 2:
        bits *= 2
    return bits


def bitmap(sets: np.ndarray) -> bytes:
    """Each element toggles one bit: two sets' bitmaps differ in no more bits than the sets in elements. Folded to a smaller width they still do not."""
    bits = width(band_of(len(sets)))
    spot = _mix(sets * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(spot.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: pd.Series, bits: int) -> np.ndarray:
    """(maps, bits / 64): bitmaps of this width or more as words, their parts of so many bits being added up without carry."""
    out = np.empty((len(maps), bits // 64), np.uint64)
    size = np.fromiter(map(len, maps), np.int64, len(maps))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        words = np.frombuffer(b"".join(maps.iloc[at]), np.uint64).reshape(len(at), -1, bits // 64)
        out[at] = np.bitwise_xor.reduce(words, 1)
    return out


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def features(docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), tile keys and bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for i, t in zip(pdf["doc_id"].array, pdf["text"]):
                s = shingles(t, p.shingle)
                own = (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), tile_keys(s, p.percent), bitmap(s)) if len(s) else (None, None, None)
                rows.append((None if pd.isna(i) else int(i), len(s), *own))
                held += len(s)
                if held >= 1 << 18:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "tiles", "bitmap"])
        return pdf.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_shingles long, digest binary, tiles array<long>, bitmap binary"
    )


def from_pivots(pairs: DataFrame, reps: DataFrame, most: int = 4096) -> DataFrame:
    """pairs (pivot, doc_id, band) with the distance of their bitmaps at the band's width. A pivot of many documents goes to blocks of them, so that no
    task gets all."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    own = reps.select("doc_id", F.col("bitmap").alias("own"))
    rows = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts").join(own, "doc_id")
    other = parts.join(own.select(F.col("doc_id").alias("pivot"), F.col("own").alias("other")), "pivot")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for band, rows in pdf.groupby("band"):
                distance = bits_apart(folded(rows["own"], width(band)), folded(rows["other"], width(band)))
                yield rows[["pivot", "doc_id", "band"]].assign(distance=distance)

    joined = rows.join(other, ["pivot", "part"]).select("pivot", "doc_id", "band", "own", "other")
    return joined.mapInPandas(run, "pivot long, doc_id long, band int, distance long")


def candidates(reps: DataFrame, p: NearParams) -> DataFrame:
    """Edges (a, b) that hold together what shares a tile and what the bitmaps let through.

    Tiles of one document are dropped. A tile's documents are compared with its first one; what lies within the band's limit hangs together
    through it, and only the others go on to be compared with the rest of the tile, block by block. Bitmaps obey the triangle inequality and never differ
    in more bits than sets in elements, so no link is lost.
    """
    rows = reps.select(F.explode("tiles").alias("tile"), "doc_id")
    shared = stored(rows.groupBy("tile").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1").select("tile", "pivot"), "join-tiles")
    rows = may_be_among(rows, "tile", shared.select("tile")).join(shared.hint("merge"), "tile").where("doc_id <> pivot")
    band = F.col("tile").bitwiseAND(F.lit(63)).cast("int")
    rows = stored(rows.withColumn("band", band), "join-placed")
    pairs = stored(from_pivots(rows.select("pivot", "doc_id", "band").distinct(), reps), "join-pivots")
    limits = F.array(*[F.lit(most_apart(EDGES[b + 1] - 1, p.percent)) for b in range(BANDS)])
    limit = F.get(limits, band)
    placed = rows.join(pairs, ["pivot", "doc_id", "band"]).select("tile", "doc_id", "pivot", "distance")
    firsts = shared.select("tile", F.col("pivot").alias("doc_id"), "pivot", F.lit(0).cast("long").alias("distance"))
    placed = placed.unionByName(firsts).withColumn("limit", limit)
    near = placed.where((F.col("distance") <= F.col("limit")) & (F.col("doc_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    rest = undecided(placed, "tile", F.col("limit")).select("tile", "doc_id", "core")
    rest = in_blocks(rest, "tile", p.block).join(reps.select("doc_id", "bitmap", "n_shingles"), "doc_id")

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, block, x, y = (pdf[c].to_numpy(np.int64) for c in ("doc_id", "a", "x", "y"))
        apart = pdf["n_shingles"].to_numpy(np.int64) * (100 - p.percent) // p.percent
        tile, found = pdf["tile"].to_numpy(np.int64), [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            own = other = np.arange(s, e)
            if x[s] != y[s]:
                own, other = own[block[own] == x[s]], other[block[other] == y[s]]
            bits = width(int(tile[s]) & 63)
            maps, many = folded(pdf["bitmap"].iloc[s:e], bits), max(1, 64 * BITS // bits)
            for at in range(0, len(own), many):
                part = own[at : at + many]
                i, j = np.nonzero(bits_apart(maps[part - s][:, None], maps[other - s][None, :]) <= np.minimum(apart[part][:, None], apart[other][None, :]))
                links = forest(part[i] - s, other[j] - s, e - s)
                if links:
                    found.append(ids[np.array(links) + s])
        pairs = np.concatenate(found)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return near.unionByName(map_sorted_groups(rest, ["tile", "x", "y"], run, "a long, b long")).distinct()


def jaccard_join(docs: DataFrame, params: NearParams = JOIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of word shingles have a Jaccard similarity of params.percent or more, none being missed.

    1. Documents with equal sets are one class, with the least id as its representative.
    2. Representatives meet in tiles of one band of sizes in which they agree on a slice of their sets (tile_keys); in a tile, bitmaps bound the
       overlap from above: |A and B| <= (|A| + |B| - differing bits) / 2. What passes makes families.
    3. In each family whole sorted sets are intersected and links confirmed; components of confirmed links are the groups.
    Only shingles' 64-bit hashes are compared.

    Returns one row per input row: doc_id, n_shingles, component_id (least id reachable). Null and wordless texts have an empty set
    and are linked with nothing. Ids are integers (others raise TypeError) and should be unique: rows that repeat an id share its group (those without
    words have none); rows with a null id have a null component_id. An empty table gives an empty one. Other columns are left out.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    feats = stored(features(docs, params, id_col, text_col), "join-features")
    classes, reps = equal_sets(feats)
    reps = stored(reps, "join-reps")
    groups = linked_classes(docs, reps, candidates(reps, params), params, id_col, text_col)
    return with_components(feats, classes, groups)
