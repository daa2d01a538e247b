"""Line-first cleaning with DataFrame functions only: rules per line, then a verdict on how much text is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replen.llm.common import SPACE

HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: A line without a sentence end fails, unless it has at most MOST_HEADING words (a heading).
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
MOST_HEADING = 3
#: Menus and bread crumbs: three separators or more between short items.
NAVIGATION = r"^[^|»›]{0,60}([|»›][^|»›]{0,60}){3,}$"
#: Lines that shout: runs of exclamation marks after three words or more.
SHOUTING = r"!![\x20\x09-\x0D].*!![\x20\x09-\x0D].*!!"
#: Notices and calls to act in English, German, French and Spanish, anywhere in a line of at most MOST_NOTICE characters.
NOTICE = (
    r"(?i)(all rights reserved|licensed under|copyright (\(c\)|©|[0-9]{4})|cookie policy|privacy policy|terms of (use|service)"
    r"|click here|sign up (now|for)|subscribe (now|to)|enable javascript|lorem ipsum|share on (facebook|twitter)"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookie-richtlinie|nutzungsbedingungen|hier klicken|jetzt (anmelden|abonnieren)"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|conditions d['’]utilisation|cliquez ici|(inscrivez|abonnez)-vous"
    r"|todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|aviso legal|(condiciones|t[éÉ]rminos) de uso|haga clic aqu[íÍ]|suscr[íÍ]b(ete|ase))"
)
MOST_NOTICE = 200


@dataclass(frozen=True)
class LineParams:
    """A document is rejected when over most_lost percent of its word characters stood in removed lines."""

    most_lost: int = 50
    least_words: int = 50
    most_repeat: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for the row, also where lambdas in body use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Number of words that lie in a window of `width` words that occurs twice or more, each counted once.

    Windows are sorted by hash with their places; neighbours with one hash are repeats, and
    the union of the repeats' places is added up in order: n log n for a text of n words.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        row = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(places, row))

    def repeats(s: Column) -> Column:
        same = lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + width).alias("end"), (a["n"] + p + width - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(places, start, step)["n"]

    found = let(words, lambda w: let(windows(w), lambda s: covered(repeats(s))))
    return F.when(F.size(words) > width, found).otherwise(0).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails the punctuation, navigation or boilerplate rules."""
    dense = 10 * (F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))) > F.length(line)
    heading = F.size(F.array_remove(F.split(line, SPACE, -1), "")) <= MOST_HEADING
    unended = ~line.rlike(SENTENCE_END) & ~heading
    return unended | dense | line.rlike(NAVIGATION) | line.rlike(SHOUTING) | ((F.length(line) <= MOST_NOTICE) & line.rlike(NOTICE))


def clean(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove failing lines from whole texts and give a verdict on each document.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (of the
    text as it came), base_failed, kept, clean_text (lines without a word and lines that pass, in order), n_removed,
    lost_chars (word characters of removed lines). Null text counts as empty and, as other texts under least_words
    words, is base_failed. Repeated rows repeat; other columns are left out.
    """
    p = params
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": F.split("text", "\n", -1)})
    full = F.filter("lines", lambda x: x.rlike(HAS_WORD))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), (x.rlike(HAS_WORD) & line_fails(x)).alias("fails"))).alias("lines"),
    )
    chars = lambda x: F.length(F.regexp_replace(x["line"], SPACE, ""))
    rows = rows.withColumns(
        {
            "clean_text": F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
            "n_removed": F.size(F.filter("lines", lambda x: x["fails"])).cast("long"),
            "lost_chars": F.aggregate(F.filter("lines", lambda x: x["fails"]), F.lit(0), lambda a, x: a + chars(x)).cast("long"),
            "base_failed": (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeat * F.col("n_words")),
        }
    ).drop("lines")
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= p.most_lost * F.col("word_chars")))
