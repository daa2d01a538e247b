"""Mixing sources to target weights by entropy balancing: tilted document rates that meet each source's words, rounded into copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replen.llm.common import map_sorted_groups, n_words, stored


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in code-point order, null last; total: words of the mix as a share of all words; most: times
    that a document is taken at most. slices: parts that the documents of one size class are dealt in. exact: sizes up to which a class
    holds one size only; longer documents share classes of 1/64 octave, so that a source has at most some 67,000 of them at any scale."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total: float = 1.5
    most: int = 2
    slices: int = 4096
    exact: int = 65_536
    tolerance: float = 1e-9
    rounds: int = 60


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """source, source_size, target for sizes (source, source_size): the water level of the capped weights.

    Sources fill in order of cap / weight; the level is where the words left over, shared by the weights left
    over, cap no further source. The unpartitioned windows hold one row a source, which groupings have made.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, p.weights)), F.pmod(F.row_number().over(line) - 1, F.lit(len(p.weights))))
    rows = sizes.withColumns({"weight": weight, "cap": p.most * F.col("source_size")}).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = p.total * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, prior: Column, most: int) -> Column:
    """The tilted rate: most / (1 + (most - prior) / prior * exp(-tilt)), between 0 and most."""
    return most / (1 + (most - prior) / prior * F.exp(-tilt))


def balance(masses: DataFrame, goals: DataFrame, p: MixParams) -> DataFrame:
    """source, tilt, scale: the dual solution of least relative entropy of documents' rates from their priors, words being constrained.

    masses: source, prior, size, n (documents). A document's rate is tilted by exp(tilt * size / scale), scale being the mean size of its source.
    A constraint binds one source's documents, so the dual separates, and Newton's step for every source is two sums over its rows: a round
    is one grouped join of all sources. A step that leaves the bracket of what is known to be too low and too high halves it (or doubles the tilt
    while one end is open). A source at its cap or with target 0 has no row: its tilt is infinite.
    """
    free = goals.where((F.col("target") > 0) & (F.col("target") < p.most * F.col("source_size") * (1 - 1e-12)))
    scale = masses.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    none = F.lit(None).cast("double")
    now = free.join(scale, free["source"].eqNullSafe(scale["source"])).select(
        free["source"], "target", "scale", F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high")
    )
    now = stored(now, "mix-tilts")
    rows = masses.where("size > 0").withColumnRenamed("source", "of")
    for _ in range(p.rounds):
        rate = _rate(F.col("tilt") * F.col("size") / F.col("scale"), F.col("prior"), p.most)
        words = F.col("n") * F.col("size") * rate
        sums = now.join(rows, F.col("source").eqNullSafe(F.col("of"))).groupBy(*now.columns).agg(
            F.sum(words).alias("got"), F.sum(words * F.col("size") / F.col("scale") * (1 - rate / p.most)).alias("slope")
        )
        tilt, low, high = F.col("tilt"), F.col("low"), F.col("high")
        sums = sums.withColumns(
            {
                "low": F.when(F.col("got") < F.col("target"), tilt).otherwise(low),
                "high": F.when(F.col("got") > F.col("target"), tilt).otherwise(high),
                "newton": tilt + F.try_divide(F.col("target") - F.col("got"), F.col("slope")),
                "off": F.abs(F.col("target") - F.col("got")) / F.col("target"),
            }
        )
        inside = (F.coalesce(F.col("newton") > low, F.lit(True)) & F.coalesce(F.col("newton") < high, F.lit(True))) & F.col("newton").isNotNull()
        safe = F.coalesce((low + high) / 2, low + F.greatest(F.lit(1.0), F.abs(low)), high - F.greatest(F.lit(1.0), F.abs(high)), tilt)
        done = F.col("off") <= p.tolerance
        sums = stored(sums.select("source", "target", "scale", F.when(done, tilt).when(inside, F.col("newton")).otherwise(safe).alias("tilt"), "low", "high", "off"), "mix-tilts")
        now = sums.drop("off")
        if (sums.agg(F.max("off").alias("off")).first()["off"] or 0.0) <= p.tolerance:
            break
    return now.select("source", "tilt", "scale")


def mix(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior: Column | None = None) -> DataFrame:
    """Decide how often the mix takes each document.

    prior: an optional rate for each document, between 0 and most (exclusive); 1 by default.
    Rates are balanced (see balance()), so documents of one source and prior differ by their sizes. Documents of one source and size are a class.
    A class gets the whole number of copies nearest to its rates' sum, larger sizes first, and what this misses in words passes on to the
    source's next class, so a source ends within about its shortest documents of its
    target. Copies fall to the documents of a class by running totals of their rates, in an order by a hash of the id; totals of slices are
    taken first, so that no task goes through a whole class. A document gets its rate rounded down or up, or one less or more where its class made up for others.

    Returns one row per input row: doc_id, size (words, null text 0), source_size, target (of its source; a null source is one,
    the last), rate, copies, taken = copies * size. The same rows give the same result. Rows that repeat an id count as often as
    they come. An empty table gives an empty one. Other columns are left out.
    """
    p = params
    size = n_words(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), (F.lit(1.0) if prior is None else prior).cast("double").alias("prior")
    )
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(23))
    step = F.when(F.col("size") <= p.exact, F.col("size")).otherwise(p.exact + F.floor(64 * F.log2(F.col("size") / p.exact)).cast("long") + 1)
    rows = stored(rows.withColumns({"draw": draw, "slice": F.pmod(F.shiftright(draw, 20), F.lit(p.slices)), "step": step}), "mix-rows")
    cells = stored(rows.groupBy("source", "step", "slice", "prior", "size").agg(F.count("*").alias("n")), "mix-cells")
    masses = stored(cells.groupBy("source", "prior", "size").agg(F.sum("n").alias("n")), "mix-masses")
    sizes = masses.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stored(targets(sizes, p), "mix-targets")
    tilts = balance(masses, goals, p).withColumnRenamed("source", "of")
    known = goals.join(tilts, goals["source"].eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of")
    full = F.when(F.col("target") > 0, float(p.most)).otherwise(0.0)
    rate = F.coalesce(_rate(F.col("tilt") * F.col("size") / F.col("scale"), F.col("prior"), p.most), full)
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rated = cells.join(known, cells["source"].eqNullSafe(F.col("of"))).drop("of").withColumns({"rate": rate, "named": named})
    rated = stored(rated.select("named", "step", "slice", "prior", "size", "n", "rate", "source_size", "target"), "mix-rated")
    total = lambda c: F.sum(F.col("n") * c)
    classes = rated.groupBy("named", "step").agg(
        F.sum("n").alias("n"), total(F.col("rate")).alias("wanted"), total(F.col("rate") * F.col("size")).alias("words"), total(F.col("size")).alias("sizes")
    )
    allotted = stored(rounded(classes, p), "mix-allotted")
    # A class's rates are moved towards most, or towards 0, so that they add up to its copies.
    key = ["named", "step"]
    more = F.col("copies") > F.col("wanted")
    up = F.try_divide(F.col("copies") - F.col("wanted"), p.most * F.col("n_class") - F.col("wanted"))
    down = F.try_divide(F.col("copies"), F.col("wanted"))
    moved = F.when(more, F.col("rate") + F.coalesce(up, F.lit(0.0)) * (p.most - F.col("rate"))).otherwise(F.col("rate") * F.coalesce(down, F.lit(0.0)))
    cells = rated.join(allotted.select(*key, "copies", "wanted", F.col("n").alias("n_class")), key).withColumn("moved", moved)
    cells = stored(cells.select(*key, "slice", "prior", "size", "n", "rate", "moved", "source_size", "target"), "mix-moved")
    parts = cells.groupBy(*key, "slice").agg(total(F.col("moved")).alias("here"))
    before = F.sum("here").over(Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0.0))).drop("here")
    cells = cells.join(parts, [*key, "slice"])
    rows = rows.select("doc_id", named.alias("named"), "step", "slice", "prior", "size", "draw").join(cells, [*key, "slice", "prior", "size"])
    line = Window.partitionBy(*key, "slice").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("before") + F.sum("moved").over(line)
    whole = lambda c: F.floor(c + 1e-6)  # noqa: E731  running totals are exact to far less than that
    return (
        rows.withColumn("until", until)
        .withColumn("copies", (whole(F.col("until")) - whole(F.col("until") - F.col("moved"))).cast("long"))
        .select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def rounded(classes: DataFrame, p: MixParams) -> DataFrame:
    """Whole copies of every class (named, step, n, wanted, words, sizes); a source's classes, at most some 67,000, meet in one group."""

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values(["named", "step"], ascending=[True, False], kind="stable").reset_index(drop=True)
        copies, now, carry = [], None, 0.0
        for source, n, wanted, words, sizes in zip(pdf["named"], pdf["n"], pdf["wanted"], pdf["words"], pdf["sizes"]):
            if source != now:
                now, carry = source, 0.0
            size = sizes / n
            k = int(min(max(np.floor(wanted + (carry / size if size else 0.0) + 0.5), 0), n * p.most))
            carry += words - k * size
            copies.append(k)
        yield pdf.assign(copies=np.array(copies, np.int64))

    columns = ["named", "step", "n", "wanted", "words", "sizes"]
    schema = "named string, step long, n long, wanted double, words double, sizes long, copies long"
    return map_sorted_groups(classes.select(columns), ["named"], run, schema)
