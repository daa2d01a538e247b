"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, with a limit per language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replen.llm import ngram
from replen.llm.common import stored


@dataclass(frozen=True)
class QualityParams:
    """One in `folds` of the trusted texts is left out of the counts and sets the limits. quantile: the share of these texts of a language that lie
    under its limit before `slack` is added (in bits a symbol). prior: symbols at the trusted mean that are mixed
    into every score, since the perplexity of a few words says little. least: texts that a language needs for a limit of its own."""

    folds: int = 5
    quantile: float = 0.99
    slack: float = 0.25
    prior: int = 100
    least: int = 20


@dataclass
class Fitted:
    model: ngram.Model
    limits: DataFrame  # lang, limit: few rows, one for each language of the trusted texts
    mean: float
    limit: float  # for other languages and for none


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all rows labelled as good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Fitted:
    """Count n-grams of all trusted texts but those left out, smooth them, and read the limits off the texts left out.

    docs: doc_id, text, lang.
    """
    rows = docs.select("doc_id", "lang", "text").join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi")
    return _fitted(rows, labels, params)[0]


def _fitted(docs: DataFrame, labels: DataFrame, p: QualityParams, keep_text: bool = False) -> tuple[Fitted, DataFrame]:
    """What fit() returns, and docs (doc_id, lang, text and other columns; without text unless keep_text) with their losses under it.

    The texts are written as blocks once, for counting and for scoring, and only ids meet the labels, so no text is shuffled.
    """
    trusted, fold = trusted_ids(labels).hint("merge"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(p.folds))
    blocks = ngram.blocked(docs.withColumn("_model", F.lit(0)), "quality-blocks")
    counted = blocks.where(fold != 0).select("_block", "doc_id").join(trusted, "doc_id", "left_semi")
    grams = ngram.block_grams(blocks, "quality-grams", counted.select(F.col("_block").alias("block"), F.col("doc_id").alias("id")))
    counts = grams.where("n_target > 0").groupBy("code").agg(F.sum("n_target").alias("n")).select(F.lit(0).alias("model"), "code", "n")
    model = ngram.kneser_ney(counts, "quality")
    scored = stored(ngram.scored(blocks, grams, model, "quality", keep_text=keep_text), "quality-scored")
    held = scored.where((fold == 0) & (F.col("n_symbols") > 0)).select("doc_id", "lang", "bits_0", "n_symbols")
    held = stored(held.join(trusted, "doc_id", "left_semi"), "quality-held")
    mean = held.agg((F.sum("bits_0") / F.sum("n_symbols")).alias("m")).first()["m"] or 0.0
    groups = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("whole"), "lang")))
    scores = held.select(groups.alias("of"), score("bits_0", "n_symbols", mean, p.prior).alias("score")).select("of.*", "score")
    found = quantiles(scores.where("whole or lang is not null"), ["whole", "lang"], p.quantile).withColumn("limit", F.col("limit") + p.slack)
    found = stored(found, "quality-limits")
    limits = found.where(~F.col("whole") & (F.col("n") >= p.least)).select("lang", "limit")
    whole = found.where("whole").first()
    return Fitted(model, limits, mean, float("inf") if whole is None else whole["limit"]), scored


def quantiles(rows: DataFrame, by: list[str], q: float, few: int = 10_000, margin: float = 0.005) -> DataFrame:
    """by, n, limit: the exact quantile of `score` in each group (few groups, no null keys), as percentile() has it.

    percentile() holds a group's values in one task. Here a sketch of bounded size brackets the quantile, fifty times its error on each side, and
    only the values between are put in order; a group of under `few` rows is put in order as a whole.
    """
    sketch = F.percentile_approx("score", F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))), 10_000)
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), sketch.alias("s"))
    ends = ends.withColumns({c: F.when(F.col("n") < few, F.col(c)).otherwise(F.get("s", i)) for i, c in enumerate(("low", "high"))}).drop("s")
    # Values under the bracket count as one value, which the quantile is not.
    joined = rows.join(F.broadcast(ends), by).where("score <= high").withColumn("score", F.when(F.col("score") >= F.col("low"), F.col("score")))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("score")))
    ranked = joined.groupBy(*by, "n", "score").agg(F.count("*").alias("c")).withColumn("upto", upto)
    at = q * (F.col("n") - 1)
    least = [F.min(F.when(F.col("upto") > f(at), F.col("score"))) for f in (F.floor, F.ceil)]
    return ranked.groupBy(*by, "n").agg(least[0].alias("a"), least[1].alias("b")).select(*by, "n", (F.col("a") + (at - F.floor(at)) * (F.col("b") - F.col("a"))).alias("limit"))


def score(bits: str, n: str, mean: float, prior: int):
    return (F.col(bits) + prior * mean) / (F.col(n) + prior)


def classify(docs: DataFrame, fitted: Fitted, params: QualityParams = QualityParams()) -> DataFrame:
    """Score whole texts; keep those at or under their language's limit.

    Returns one row per input row: doc_id, lang, n_symbols, log2_perplexity (per symbol; null for
    null and empty texts, which are not kept), limit, kept. A null or rare language has the limit of all trusted texts; if no
    text is trusted there is no limit and every text with a symbol is kept. Repeated rows repeat; other columns are left out.
    """
    return _judged(ngram.losses(docs.select("doc_id", "lang", "text"), fitted.model, "quality"), fitted, params)


def fit_and_classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """classify(docs, fit(docs, labels)) with one reading of the texts for both."""
    fitted, scored = _fitted(docs.select("doc_id", "lang", "text"), labels, params)
    return _judged(scored, fitted, params)


def keep_good(docs: DataFrame, fitted: Fitted, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, without shuffling a text."""
    scored = ngram.losses(_nested(docs), fitted.model, "quality", keep_text=True)
    return _judged(scored, fitted, params, "row", "text").where("kept").select("row.*", "text").select(docs.columns)


def fit_and_keep(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """keep_good(docs, fit(docs, labels)) with one reading of the texts for both."""
    fitted, scored = _fitted(_nested(docs), labels, params, keep_text=True)
    return _judged(scored, fitted, params, "row", "text").where("kept").select("row.*", "text").select(docs.columns)


def _nested(docs: DataFrame) -> DataFrame:
    """row (all columns but text), doc_id, lang, text."""
    return docs.select(F.struct([c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "lang", "text")


def _judged(scored: DataFrame, fitted: Fitted, params: QualityParams, *more: str) -> DataFrame:
    limits = F.broadcast(fitted.limits)  # one row a language
    has = F.col("n_symbols") > 0
    limit = F.coalesce("limit", F.lit(fitted.limit))
    return scored.join(limits, "lang", "left").select(
        "doc_id",
        "lang",
        "n_symbols",
        F.when(has, F.col("bits_0") / F.col("n_symbols")).alias("log2_perplexity"),
        limit.alias("limit"),
        (has & (score("bits_0", "n_symbols", fitted.mean, params.prior) <= limit)).alias("kept"),
        *more,
    )
