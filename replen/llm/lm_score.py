"""LM scoring: cross-entropy difference between matched target and background models over one vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replen.llm import ngram

#: Folds that the corpus is dealt into at most. A target under 1 / MOST_FOLDS of the corpus meets larger backgrounds.
MOST_FOLDS = 64


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_folds: int = MOST_FOLDS
) -> DataFrame:
    """Score every document by its loss per token under a target model less that under a background model.

    The corpus is dealt into folds of about the target's size by a hash of the text (the target is the rows whose id is in target
    (doc_id, distinct or not); there are 2 to most_folds folds). A text is scored by the target's rows of all folds but its own and by all rows of the next fold:
    both models have about the same size, order, smoothing and vocabulary (UTF-16 code units), neither has seen the text or an exact copy of it,
    and every document is counted by one background. Tokens are the symbols. A low difference means
    that a text is more like the target than like the corpus.

    Returns one row per input row: doc_id, n_tokens, target_loss and background_loss (bits a token), difference. The last three are null
    for null and empty texts. With an empty target its models are uniform. Repeated rows repeat (and count as often); other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = target.select("doc_id").where("doc_id is not null").distinct()
    # Sizes by id alone: no text is shuffled.
    sizes = texts.select("doc_id", F.length("text").alias("size")).join(ids.withColumn("chosen", F.lit(1)), "doc_id", "left")
    whole, part = sizes.agg(F.sum("size"), F.sum(F.col("size") * F.col("chosen"))).first()
    folds = max(2, min(most_folds, round(whole / part))) if whole and part else 2
    dealt = texts.withColumn("_model", F.pmod(F.xxhash64("text", F.lit(29)), F.lit(folds)).cast("int"))
    blocks = ngram.blocked(dealt, "lm-blocks")
    placed = blocks.select(F.col("_block").alias("block"), F.col("doc_id").alias("id"))
    chosen = placed.join(ids.hint("merge"), F.col("id") == ids["doc_id"], "left_semi")
    grams = ngram.block_grams(blocks, "lm-grams", chosen)
    counted = grams.groupBy("_model", "code").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda m: m != F.col("_model")))
    targets = counted.where("n_target > 0").select(other.alias("model"), "code", "n_target")
    targets = targets.groupBy("model", "code").agg(F.sum("n_target").alias("n"))
    backgrounds = counted.select((F.pmod(F.col("_model") - 1, F.lit(folds)) + folds).alias("model"), "code", "n")
    model = ngram.kneser_ney(targets.unionByName(backgrounds), "lm")
    n = F.when(F.col("n_symbols") > 0, F.col("n_symbols"))
    return ngram.scored(blocks, grams, model, "lm", sides=2, folds=folds).select(
        "doc_id",
        F.col("n_symbols").alias("n_tokens"),
        (F.col("bits_0") / n).alias("target_loss"),
        (F.col("bits_1") / n).alias("background_loss"),
        ((F.col("bits_0") - F.col("bits_1")) / n).alias("difference"),
    )
