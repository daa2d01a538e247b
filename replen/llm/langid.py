"""Language ID by cross-parsing: the language whose labelled text covers a text in the fewest normalised phrases wins."""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replen.llm.common import pieces_of

SPACE = 32


@dataclass(frozen=True)
class LangParams:
    """The fit reads up to max_rows labelled rows of each language, drawn by a hash of id and text, and of each the first max_chars characters
    up to a word's end. window: characters that are parsed in one go; a phrase ends there at the latest."""

    max_rows: int = 64
    max_chars: int = 6_000
    window: int = 512


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks that go with letters, 0 for all else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, one after another, every run of anything but letters being one space, and each text's length.

    A text begins and ends with a space; one without a letter has length 0.
    """
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    kind = _kinds()[codes]
    codes = np.where(kind > 0, codes, SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    starts = ends - [len(t) for t in lowered]
    keep[starts] = True  # also where the text before ended with a space
    letters = np.add.reduceat(kind == 2, starts) if len(starts) else np.zeros(0, np.int64)
    for i in np.flatnonzero(letters == 0).tolist():
        keep[starts[i] : ends[i]] = False
    sizes = np.add.reduceat(keep, starts) if len(starts) else np.zeros(0, np.int64)
    return codes[keep].astype(np.int64), sizes.astype(np.int64)


class SuffixAutomaton:
    """All substrings of a text (code points): a walk from the root along a string stays inside as long as the text has the string.

    Transitions are one open-addressed array of 64-bit entries, state << 42 | symbol << 21 | next, so that many texts are
    walked at a time. The root's transitions are an array of their own.
    """

    def __init__(self, codes: np.ndarray):
        alphabet, text = np.unique(codes, return_inverse=True)
        self.bits = math.log2(len(codes) + 2)
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        following: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in (text + 1).tolist():
            state = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = state
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    clone = len(following)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
        if len(following) >= 1 << 21:
            raise ValueError("the text is too long for one automaton")
        self.root = np.zeros(len(alphabet) + 1, np.int64)
        for c, to in following[0].items():
            self.root[c] = to
        moves = np.array([(s << 42) | (c << 21) | to for s, go in enumerate(following) if s for c, to in go.items()], np.int64)
        self.shift = np.uint64(64 - max(4, int(4 * len(moves)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int64)
        at, left = self._home(moves >> 21), np.arange(len(moves))
        while len(left):
            free = np.flatnonzero(self.table[at[left]] == 0)
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free[first]]
            self.table[at[put]] = moves[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.table) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that symbols lead to, and whether a phrase ended before them."""
        key = (state << 21) | symbol
        at = self._home(key)
        entry = self.table[at]
        hit = (entry >> 21) == key
        left = np.flatnonzero(~hit & (entry != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.table) - 1)
            entry[left] = again = self.table[at[left]]
            hit[left] = (again >> 21) == key[left]
            left = left[~hit[left] & (again != 0)]
        return np.where(hit, entry & ((1 << 21) - 1), self.root[symbol]), ~hit & (state != 0)

    def phrases(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Longest matches, one after another, that each of many strings falls into; a symbol that the text lacks is a phrase of its own.

        The strings (starts and sizes in codes) come longest first.
        """
        symbols = self.symbol[codes].astype(np.int64)
        n, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        for k, m in enumerate(active.tolist()):
            to, ended = self.step(state[:m], symbols[starts[:m] + k])
            n[:m] += ended
            n[:m] += to == 0
            state[:m] = to
        return n + (state != 0)


class Parser:
    """Totals of normalised phrases of texts in every language."""

    def __init__(self, texts: dict[str, np.ndarray], window: int):
        self.langs, self.window = sorted(texts), window
        self.automata = [SuffixAutomaton(texts[k]) for k in self.langs]

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): phrases times the bits that point into a language's text; and which texts have a letter."""
        codes, sizes = normalised(texts)
        windows = -(-sizes // self.window)
        of = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(np.cumsum(sizes) - sizes, windows) + place * self.window
        width = np.minimum(self.window, sizes[of] - place * self.window)
        order = np.argsort(-width, kind="stable")
        out = np.zeros((len(texts), len(self.langs)))
        for i, a in enumerate(self.automata):
            out[:, i] = np.bincount(of[order], a.phrases(codes, starts[order], width[order]), len(texts)) * a.bits
        return out, sizes > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, has = self.totals(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmin(1)
        least = total[np.arange(len(texts)), best]
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            second = np.partition(total, 1, 1)[:, 1]
            score = second / np.maximum(second + least, 1e-300)
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], np.where(has, score, 0.0)


def fit(labelled: DataFrame, params: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Suffix automata over the running text of each language's labelled rows (null labels, and texts without a letter, teach nothing).

    Rows that repeat an id and text count once. What comes to the driver is bounded by max_rows * max_chars for each label.
    """
    p = params
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not n:
        return Parser({}, p.window)
    # Enough rows to choose from, whatever the estimate's error; then the least hashes of each language.
    shares = F.create_map(*[F.lit(x) for k, v in sorted(n.items()) for x in (k, min(1.0, 3 * p.max_rows / v))])
    few = rows.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < shares[F.col("lang")])
    start = F.substring("text", 1, p.max_chars)
    whole = F.coalesce(F.nullif(F.regexp_replace(start, r"\S+$", ""), F.lit("")), start)
    few = few.withColumn("text", F.when(F.length("text") > p.max_chars, whole).otherwise(F.col("text"))).dropDuplicates(["lang", "draw"])
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= p.max_rows)
    texts: dict[str, list[tuple]] = {}
    for r in few.select("lang", "draw", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return Parser({k: normalised([t for _, t in sorted(found)])[0] for k, found in texts.items()}, p.window)


_made: dict[str, Parser] = {}


def _parser(shared: Broadcast) -> Parser:
    """One per worker process and broadcast."""
    key, parser = shared.value
    if key not in _made:
        _made.clear()
        _made[key] = parser
    return _made[key]


def predict(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of whole texts from nothing but the text.

    Letters and marks are lower-cased, every run of anything else is one space, and phrases run on across words. Phrases are normalised by
    the bits that point into a language's text (log2 of its length), so that languages
    with less text are not favoured. Returns one row per input row: doc_id, lang_pred, score. `und` and 0 if the text is null or has no letter
    (or nothing was learned); else score = second / (best + second) of the two least totals, 0.5 for a tie, which
    the label that comes first by code point wins. Repeated rows repeat; an empty table gives an empty one; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, parser))  # grows with the labels, not with the rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shared)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in pieces_of(texts, 1 << 20):
                langs, score = parser.predict(texts[a:b])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "lang_pred": langs, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double"
    )
