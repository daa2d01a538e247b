"""Interpolated modified Kneser-Ney models over UTF-16 code units, counted, smoothed and applied by sharded joins.

An n-gram of up to four symbols is one 64-bit code, 16 bits a symbol, so nothing is hashed
or left out of the vocabulary, and models over different texts share it as it stands. One table may hold many models, told apart by a number.

Texts are scored without being shuffled and without any table as large as a model in one place: they are written as blocks of
bounded size, each block's distinct n-grams go to the models' shards, and what they are worth comes back to the block. As n-grams
are asked for once a block, and backed off once for all blocks, no key of a join is hot.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replen.llm.common import pieces_of, shared_dir, stored

ORDER = 4
SYMBOLS = 1 << 16
#: Stands before a text; where a text has it, the next code point is read instead.
PAD = "\x01"
#: Characters of a block, which one task scores at a time; one text more may begin before the limit.
BLOCK_CHARS = 1 << 24
#: Distinct n-grams that a counting task holds before it hands them on.
MOST_HELD = 2_000_000


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of texts, one for each symbol, and the number of symbols of each text."""
    parts, sizes, pad = [], [], (PAD * (ORDER - 1)).encode("utf-16-le")
    for t in texts:
        t = t or ""
        raw = (t.replace(PAD, "\x02") if PAD in t else t).encode("utf-16-le", "surrogatepass")
        parts += [pad, raw]
        sizes.append(len(raw) // 2)
    u = np.frombuffer(b"".join(parts), np.uint16).astype(np.uint64)
    if len(u) < ORDER:
        return np.zeros(0, np.uint64), np.array(sizes, np.int64)
    code = u[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        code |= u[ORDER - 1 - k : len(u) - k] << np.uint64(16 * k)
    return code[u[ORDER - 1 :] != ord(PAD)], np.array(sizes, np.int64)


def distinct(texts: list[str | None], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the n-grams of texts, sorted, and how often each occurs."""
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in pieces_of(texts, most):
        held.append(np.unique(ngrams(texts[a:b])[0], return_counts=True))
        if sum(len(codes) for codes, _ in held) > MOST_HELD:
            held = [_merged(held)]
    return _merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, ns = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(codes, kind="stable")
    codes, ns = codes[order], ns[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[at], np.add.reduceat(ns, at) if len(at) else ns


def count(texts: DataFrame) -> DataFrame:
    """model (0), code, n over the column `text`; each task adds up its own n-grams before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pd.DataFrame]:
            codes, ns = _merged(held)
            for i in range(0, len(codes), 100_000):
                yield pd.DataFrame({"code": codes[i : i + 100_000].view(np.int64), "n": ns[i : i + 100_000]})

        for pdf in batches:
            held.append(distinct(pdf["text"].tolist()))
            if sum(len(codes) for codes, _ in held) > MOST_HELD:
                held = [_merged(held)]
                if len(held[0][0]) > MOST_HELD // 2:
                    yield from rows()
                    held = []
        if held:
            yield from rows()

    found = texts.select("text").mapInPandas(run, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(0).alias("model"), "code", "n")


def _mask(symbols: int) -> Column:
    return F.lit((1 << 16 * symbols) - 1).cast("long")


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more from the numbers of n-grams seen 1 to 4 times."""
    if not (n[1] and n[2]):
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    found = (i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3))
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


@dataclass
class Model:
    """probabilities: by order, (model, code, value) with the natural log of the interpolated probability; backoffs: by the order of
    the context (0 for the empty one), (model, code, value) with the natural log of the weight of the shorter context."""

    probabilities: dict[int, DataFrame]
    backoffs: dict[int, DataFrame]


def kneser_ney(counts: DataFrame, name: str) -> Model:
    """The models of counts (model, code, n) of the full order.

    Lower orders count distinct left neighbours. Every step is a grouping or a join on n-gram
    or context codes, so tables of any size are dealt over the shards of a shuffle, and a key meets at most as many rows as there are symbols; twelve
    numbers a model (the counts of counts) come to the driver. No text gives an empty model, which is uniform.
    """
    levels = {ORDER: stored(counts, f"{name}-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        lower = levels[k + 1].groupBy("model", F.col("code").bitwiseAND(_mask(k)).alias("code")).agg(F.count("*").alias("n"))
        levels[k] = stored(lower, f"{name}-{k}")
    lower, found, weights = None, {}, {}
    for k in range(1, ORDER + 1):
        stats = levels[k].groupBy("model").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).collect()
        each = {r["model"]: discounts({i: r[f"n{i}"] for i in range(1, 5)}) for r in stats} or {0: (0.5, 0.5, 0.5)}
        d1, d2, d3 = (F.create_map(*[F.lit(x) for m, d in sorted(each.items()) for x in (m, d[i])])[F.col("model")] for i in range(3))
        n = F.col("n")
        taken = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rows = levels[k].select("*", F.shiftrightunsigned("code", 16).alias("context"), taken.alias("taken"))
        contexts = stored(rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("weight")), f"{name}-c{k}")
        if lower is None:
            rows = rows.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.withColumn("suffix", F.col("code").bitwiseAND(_mask(k - 1))).join(lower, ["model", "suffix"])
        p = (n - F.col("taken")) / F.col("total") + F.col("weight") * F.col("q")
        rows = stored(rows.join(contexts, ["model", "context"]).select("model", "code", p.alias("p")), f"{name}-p{k}")
        found[k] = rows.select("model", "code", F.log("p").alias("value"))
        weights[k - 1] = contexts.select("model", F.col("context").alias("code"), F.log("weight").alias("value"))
        lower = rows.select("model", F.col("code").alias("suffix"), F.col("p").alias("q"))
    return Model(found, weights)


def values(asked: DataFrame, model: Model, name: str) -> DataFrame:
    """model, code, value: the natural log of the probability of the last symbol of each n-gram asked for (model, code; distinct).

    Orders are gone through from the lowest: an n-gram that a model lacks has its suffix's value and its context's weight.
    """
    levels = {ORDER: stored(asked, f"{name}-asked-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(levels[k + 1].select("model", F.col("code").bitwiseAND(_mask(k)).alias("code")).distinct(), f"{name}-asked-{k}")
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k].select("*", F.shiftrightunsigned("code", 16).alias("context"))
        rows = rows.join(model.probabilities[k].withColumnRenamed("value", "p"), ["model", "code"], "left")
        weight = model.backoffs[k - 1].select("model", F.col("code").alias("context"), F.col("value").alias("w"))
        rows = rows.join(weight, ["model", "context"], "left")
        if lower is None:
            rows = rows.withColumn("q", F.lit(-math.log(SYMBOLS)))
        else:
            suffix = lower.select("model", F.col("code").alias("suffix"), F.col("value").alias("q"))
            rows = rows.withColumn("suffix", F.col("code").bitwiseAND(_mask(k - 1))).join(suffix, ["model", "suffix"])
        value = F.coalesce("p", F.coalesce("w", F.lit(0.0)) + F.col("q"))
        lower = stored(rows.select("model", "code", value.alias("value")), f"{name}-v{k}")
    return lower


class Lookup:
    """An open-addressed table from codes to values, as arrays."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)  # four noncharacters, which no text holds

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.codes = np.full(1 << bits, self.NONE)
        self.values = np.zeros((1 << bits, values.shape[1]))
        at, left = self._home(codes), np.arange(len(codes))
        while len(left):
            spot = at[left]
            free = np.flatnonzero(self.codes[spot] == self.NONE)
            _, first = np.unique(spot[free], return_index=True)
            put = free[first]
            self.codes[spot[put]], self.values[spot[put]] = codes[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left = left[rest]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes that the table has."""
        at = self._home(codes)
        left = np.flatnonzero(self.codes[at] != codes)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            left = left[self.codes[at[left]] != codes[left]]
        return self.values[at]


def blocked(docs: DataFrame, name: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (text, _model and any other columns) written as blocks of bounded size, and `_block`.

    The table is bucketed by block: a block's rows are brought together by reading, so neither pass over the texts shuffles them.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(sizes)
            block = pa.array(first + (ends - sizes) // block_chars)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, block], [*batch.schema.names, "_block"])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_block", T.LongType())]))
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/replen/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "_block").saveAsTable(table)
    return spark.table(table)


def block_grams(blocks: DataFrame, name: str, target: DataFrame | None = None) -> DataFrame:
    """_block, _model, code, n, n_target: distinct n-grams of each block's texts of a model, and how often they occur.

    target: (block, id) of rows whose n-grams count as n_target too; blocks must then have doc_id.
    """

    def counted(rows: pa.Table, ids: pa.Table | None) -> pa.Table:
        models = rows.column("_model").to_numpy()
        chosen = pc.is_in(rows.column("doc_id"), value_set=ids.column("id").combine_chunks()).to_numpy() if ids is not None else np.zeros(len(models), bool)
        out = []
        for m in np.unique(models).tolist():
            found = []
            for among in (False, True):
                which = np.flatnonzero((models == m) & (chosen == among))
                codes, ns = distinct(rows.column("text").take(which).to_pylist()) if len(which) else _merged([(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
                found.append((codes, np.stack([ns, ns * among], 1)))
            codes, ns = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            codes, place = np.unique(codes, return_inverse=True)
            both = np.zeros((len(codes), 2), np.int64)
            for i in range(2):
                both[:, i] = np.bincount(place, ns[:, i], len(codes))
            out.append(pa.table({"_model": np.full(len(codes), m, np.int32), "code": codes.view(np.int64), "n": both[:, 0], "n_target": both[:, 1]}))
        found = pa.concat_tables(out)
        return found.add_column(0, "_block", pa.array(np.full(len(found), rows.column("_block")[0].as_py(), np.int64)))

    def alone(rows: pa.Table) -> pa.Table:
        return counted(rows, None)

    def together(rows: pa.Table, ids: pa.Table) -> pa.Table:
        return counted(rows, ids) if len(rows) else SCHEMA.empty_table()

    schema = "_block long, _model int, code long, n long, n_target long"
    if target is None:
        return stored(blocks.select("_block", "_model", "text").groupBy("_block").applyInArrow(alone, schema), name)
    rows = blocks.select("_block", "_model", "doc_id", "text").groupBy("_block")
    return stored(rows.cogroup(target.groupBy("block")).applyInArrow(together, schema), name)


SCHEMA = pa.schema([("_block", pa.int64()), ("_model", pa.int32()), ("code", pa.int64()), ("n", pa.int64()), ("n_target", pa.int64())])


def scored(blocks: DataFrame, grams: DataFrame, model: Model, name: str, sides: int = 1, folds: int = 1, keep_text: bool = False) -> DataFrame:
    """blocks' columns (text is dropped unless keep_text), n_symbols, and bits_0, bits_1, ...: each side's loss over the whole text.

    A row is scored by the models _model, _model + folds, ... of `sides` sides.
    """
    asked = grams.select(F.explode(F.array(*[F.col("_model") + i * folds for i in range(sides)])).alias("model"), "code").distinct()
    worth = values(asked, model, name)
    side = F.floor(F.col("model") / folds)
    worth = worth.groupBy(F.pmod("model", F.lit(folds)).cast("int").alias("_model"), "code").agg(
        *[F.max(F.when(side == i, F.col("value"))).alias(f"v{i}") for i in range(sides)]
    )
    back = grams.select("_block", "_model", "code").join(worth.hint("merge"), ["_model", "code"])
    others = [c for c in blocks.columns if c not in ("_block", "_model") and (keep_text or c != "text")]

    def run(rows: pa.Table, worth: pa.Table) -> pa.Table:
        texts, models = rows.column("text"), rows.column("_model").to_numpy()
        of = worth.column("_model").to_numpy()
        codes = worth.column("code").to_numpy().view(np.uint64)
        value = np.stack([worth.column(f"v{i}").to_numpy() for i in range(sides)], 1) if len(worth) else np.zeros((0, sides))
        sizes, bits = np.zeros(len(rows), np.int64), np.zeros((len(rows), sides))
        for m in np.unique(models).tolist():
            which = np.flatnonzero(models == m)
            table = Lookup(codes[of == m], value[of == m])
            chosen = texts.take(which)
            for at in range(0, len(which), 1024):
                strings = chosen.slice(at, 1024).to_pylist()
                for a, b in pieces_of(strings, 1 << 18):
                    grams, n = ngrams(strings[a:b])
                    worths, full = table.get(grams), np.flatnonzero(n)
                    sums = np.zeros((b - a, sides))
                    if len(full):  # summed text by text, so that equal texts have equal losses
                        sums[full] = np.add.reduceat(worths, (np.cumsum(n) - n)[full], axis=0)
                    sizes[which[at + a : at + b]] = n
                    bits[which[at + a : at + b]] = sums / -math.log(2)
        out = rows.select(others)
        for column, name in ((sizes, "n_symbols"), *((bits[:, i], f"bits_{i}") for i in range(sides))):
            out = out.append_column(name, pa.array(column))
        return out

    more = [T.StructField("n_symbols", T.LongType()), *[T.StructField(f"bits_{i}", T.DoubleType()) for i in range(sides)]]
    schema = T.StructType([*[blocks.schema[c] for c in others], *more])
    return blocks.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(run, schema)


def losses(docs: DataFrame, model: Model, name: str, keep_text: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' columns (text is dropped unless keep_text), n_symbols, and bits_0: the loss of whole texts under model number 0."""
    blocks = blocked(docs.withColumn("_model", F.lit(0)), f"{name}-blocks", block_chars)
    return scored(blocks, block_grams(blocks, f"{name}-grams"), model, name, keep_text=keep_text)
