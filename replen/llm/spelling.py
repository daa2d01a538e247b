"""Spelling variants: words one edit apart are found by probing generated edits against Bloom filters of the vocabulary, one shard a word length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replen.llm.common import ascii_lower, stored

LETTERS = r"A-Za-zÀ-ÿ"
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SpellingParams:
    """shortest: code points of a word; least: its occurrences; ratio: how often more a form occurs than its variant.

    bits: of the filters for each word. blocks: 64-bit blocks (8 bytes) that one round broadcasts at most; a larger vocabulary
    takes more rounds. probes: edits that a task makes at a time.
    """

    shortest: int = 6
    least: int = 5
    ratio: int = 5
    bits: int = 24
    blocks: int = 1 << 22
    probes: int = 1 << 19


def runs(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, run: every maximal run of letters with at least so many, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(found).alias("run"))
    return rows.select("doc_id", ascii_lower(F.col("run")).alias("run"))


def with_misspellings(rows: DataFrame, every: int = 199) -> DataFrame:
    """run without its code point at h % length where `every` divides h, the crc32 of `<doc_id>:<run>` (a null id is an empty one): the planted variants of the registered query."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("run", F.when(h % every == 0, cut).otherwise(F.col("run")))


def vocabulary(rows: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n of the runs that are long and frequent enough."""
    words = rows.where(F.length("run") >= p.shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= p.least)


# Hashes of words and of their edits


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """STEP to the power of 0..n-1, modulo 2^64."""
    out = np.full(n, STEP)
    out[:1] = 1
    return np.multiply.accumulate(out)


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def sums(codes: np.ndarray) -> np.ndarray:
    """The hash of words before it is mixed: a sum over their code points, so that an edit changes it by a few terms."""
    return (codes * powers(codes.shape[1])).sum(1, dtype=np.uint64)


def spots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits (four of its 64) of mixed hashes."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros_like(h)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), mask


Probe = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def edits(codes: np.ndarray, alphabet: np.ndarray, most: int) -> Iterator[tuple[bool, Probe]]:
    """The words' edits, some at a time, as (replaced, (word, position, new code point, hash before mixing)).

    Nearness is mutual, so deletions stand for insertions, and replacements by a greater code point for those by a lesser one. Of a
    run of one letter only the first is deleted, so no edit comes twice.
    """
    n, length = codes.shape
    power = powers(length)
    terms = codes * power
    whole = terms.sum(1, dtype=np.uint64)
    before = np.cumsum(terms, 1, dtype=np.uint64) - terms
    shifted = codes[:, 1:] * power[:-1]
    after = np.zeros_like(codes)
    after[:, :-1] = np.cumsum(shifted[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    w, at = np.nonzero(first)
    yield False, (w, at, np.zeros(len(w), np.uint64), before[w, at] + after[w, at])
    wide = max(1, most // len(alphabet))  # letters that are replaced at a time
    for start in range(0, n * length, wide):
        flat = np.arange(start, min(n * length, start + wide))
        i, letter = np.nonzero(alphabet[None, :] > codes.ravel()[flat][:, None])
        w, at = np.divmod(flat[i], length)
        new = alphabet[letter]
        yield True, (w, at, new, whole[w] + (new - codes[w, at]) * power[at])


# Filters, probed in rounds


def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths of the words of a batch, and the rows of each."""
    size = pdf["word"].str.len().to_numpy()
    for length in np.unique(size):
        yield int(length), np.flatnonzero(size == length)


def rounds(counts: dict[int, int], p: SpellingParams) -> tuple[dict[int, int], list[list[tuple[int, int, int]]]]:
    """Blocks of each length's filter, and the parts (length, first block, end) that each round broadcasts."""
    sizes = {k: max(1, math.ceil(n * p.bits / 64)) for k, n in sorted(counts.items())}
    out, room = [[]], p.blocks
    for length, size in sizes.items():
        start = 0
        while start < size:
            if not room:
                out.append([])
                room = p.blocks
            end = min(size, start + room)
            out[-1].append((length, start, end))
            room -= end - start
            start = end
    return sizes, out


def filter_rows(words: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """length, block, bits of the blocked Bloom filters of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, at in by_length(pdf):
                block, mask = spots(_mixed(sums(code_points(pdf["word"].iloc[at].tolist(), length))), sizes[length])
                yield pd.DataFrame({"length": length, "block": block, "bits": mask.view(np.int64)})

    rows = words.select("word").mapInPandas(run, "length int, block long, bits long")
    return rows.groupBy("length", "block").agg(F.bit_or("bits").alias("bits"))


def positives(words: DataFrame, filters: DataFrame, sizes: dict[int, int], part: list[tuple[int, int, int]], alphabet: list[int], p: SpellingParams) -> DataFrame:
    """word, near: the words' edits that a round's part of the filters lets through: all that are words and a few others."""
    spark = words.sparkSession
    held = {}
    for length, start, end in part:
        rows = filters.where((F.col("length") == length) & F.col("block").between(start, end - 1)).select("block", "bits").toArrow()
        bits = np.zeros(end - start, np.uint64)
        bits[rows["block"].to_numpy() - start] = rows["bits"].to_numpy().view(np.uint64)
        held[length] = (start, bits)
    shards, letters = spark.sparkContext.broadcast(held), np.array(sorted(alphabet), np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = shards.value
        for pdf in batches:
            for length, rows in by_length(pdf):
                if length not in shard and length - 1 not in shard:
                    continue
                many = max(1, p.probes // length)
                for s in range(0, len(rows), many):
                    words = pdf["word"].iloc[rows[s : s + many]].tolist()
                    for replaced, (w, at, new, h) in edits(code_points(words, length), letters, p.probes):
                        size = length if replaced else length - 1
                        if size not in shard:
                            continue
                        start, bits = shard[size]
                        block, mask = spots(_mixed(h), sizes[size])
                        inside = (block >= start) & (block < start + len(bits))
                        found = np.flatnonzero(inside)
                        found = found[(bits[block[found] - start] & mask[found]) == mask[found]]
                        if len(found):
                            own = [words[k] for k in w[found].tolist()]
                            near = [o[:i] + (chr(c) if replaced else "") + o[i + 1 :] for o, i, c in zip(own, at[found].tolist(), new[found].tolist())]
                            yield pd.DataFrame({"word": own, "near": near})

    return words.select("word").mapInPandas(run, "word string, near string")


def neighbours(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n, near, near_n: all pairs of words that differ by one inserted, deleted or replaced code point, both ways round.

    words: word, n (distinct words; a table that is cheap to read again, as it is read in each round). Filters are built from all words, and one round's are broadcast at a time, never
    more than p.blocks. Only edits that pass them are shuffled to the exact join with the vocabulary, which removes false positives.
    """
    size = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in size.collect()}  # one row a word length
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = [ord(r["c"]) for r in letters.collect()]  # the letters of the pattern at most
    sizes, parts = rounds(counts, p)
    filters = stored(filter_rows(words, sizes), "spelling-filters")
    passed = None
    for part in parts:
        if part:
            found = stored(positives(words, filters, sizes, part, alphabet, p), "spelling-positives")
            passed = found if passed is None else passed.unionByName(found)
    if passed is None:
        passed = words.select("word", F.col("word").alias("near")).where("false")
    pairs = passed.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").join(words, "word").select("word", "n", "near", "near_n")
    pairs = stored(pairs, "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: where a chain of forms ends. forms: word, form, form_n of the words that have one.

    Chains are followed by doubling. A form occurs `ratio` times as often as its word, so no chain is longer than the logarithm of the largest n.
    """
    now = forms.select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("form_n")).first()[0]  # one number
    links = math.ceil(math.log(most, ratio)) if most and ratio > 1 else 0
    for _ in range(math.ceil(math.log2(links)) if links > 1 else 0):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return now


def variants(words: DataFrame, p: SpellingParams = SpellingParams()) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n.

    words: word, n, as vocabulary() gives them. A word's form is its near word of the largest n (of equals the least in code-point order) if that is at least
    p.ratio times the word's n, else null; its root is where the forms end, the word itself without one. An empty vocabulary gives
    an empty table. ratio must be over 1, else forms could go round in circles.
    """
    if p.ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(words.select("word", "n"), "spelling-words")
    near = neighbours(words, p).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("own"), F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    is_form = F.col("best.near_n") >= p.ratio * F.col("own")
    near = stored(near.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")), "spelling-forms")
    ends = roots(near.where("form is not null"), p.ratio)
    rows = words.join(near, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group_variants(docs: DataFrame, p: SpellingParams = SpellingParams(), every: int | None = None) -> DataFrame:
    """variants() of the vocabulary of docs (doc_id, text); with `every`, some runs lose a letter first (with_misspellings).

    Null and empty texts have no words; long ones count whole; repeated rows count each time; an empty table gives an empty one; other
    columns are left out.
    """
    rows = runs(docs.select("doc_id", "text"), p.shortest)
    return variants(vocabulary(with_misspellings(rows, every) if every else rows, p), p)
