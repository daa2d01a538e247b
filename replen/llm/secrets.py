"""Secret scans: a trigram inverted index narrows each rule to candidate documents, which are then verified.

DataFrame functions only. Python derives the rules' trigram queries once, before the plan is made.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replen.llm.common import may_be_among, stored
from replen.llm.line_rules import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that group `measured` of a match must have, else the match is dropped."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


#: The base kinds, in their order of listing; [Aa] stands for a letter in either case.
BASE = [
    Rule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    # Runs of 24 or more are the same matches as runs of any length with short ones dropped.
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Kinds of fixed form that the index finds beside them.
ADDED = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login_url", r"[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@[a-z0-9]"),
]


def _strings(items: list, most: int = 256) -> set[str] | None:
    """All strings that a sequence of parsed items matches, letters lower-cased; None if they are too many."""
    found = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            options = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            spans = [(a, a) if str(o) == "LITERAL" else a for o, a in arg]
            if sum(b - a + 1 for a, b in spans) > 16:
                return None
            options = {chr(c).lower() for a, b in spans for c in range(a, b + 1)}
        elif name == "SUBPATTERN":
            options = _strings(list(arg[3]), most)
        elif name == "BRANCH":
            each = [_strings(list(b), most) for b in arg[1]]
            options = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and arg[1] != re._constants.MAXREPEAT and arg[1] <= 4:
            one = _strings(list(arg[2]), most)
            options = None
            if one is not None:
                options = set().union(*({"".join(t) for t in itertools.product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
        else:
            options = None
        if options is None or len(options) * len(found) > most:
            return None
        found = {a + b for a in found for b in options}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What every match of pattern must hold: for each clause, all trigrams of one of its alternatives.

    Runs of items that match few strings give a clause each, unless one of the strings is shorter than a trigram.
    An empty query means that the pattern has no mandatory trigram.
    """
    clauses, run = [], []
    for item in [*re._parser.parse(pattern), None]:
        longer = None if item is None else _strings([*run, item])
        if longer is not None:
            run.append(item)
            continue
        if run and min(map(len, found := _strings(run))) >= 3:
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in found}, key=sorted))
        run = [item] if item is not None and _strings([item]) is not None else []
    return clauses


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's leftmost non-overlapping matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    around = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured))
    kind = "struct<start:int,order:int,end:int,kind:string>"

    def walk(parts: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(F.get(parts["around"], i))
            end = start + F.length(F.get(parts["hits"], i))
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            enough = F.length(F.get(parts["measured"], i)) >= rule.least
            return F.struct(end.alias("at"), F.when(enough, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts["hits"]) - 1), start, step)["out"]

    none = F.array().cast(f"array<{kind}>")
    parts = F.struct(around.alias("around"), hits.alias("hits"), measured.alias("measured"))
    return F.when(text.rlike(rule.pattern), let(parts, walk)).otherwise(none)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: postings of the given trigrams (letters lower-cased, once a text) over docs (doc_id, text)."""
    has = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return docs.select(F.explode(has).alias("trigram"), "doc_id")


def candidates(postings: DataFrame, queries: dict[str, list]) -> DataFrame:
    """doc_id, kinds: the rules of whose query a document has every clause, by intersecting postings."""
    rows = [
        (kind, c, a, len(alternative), t)
        for kind, clauses in queries.items()
        for c, alternatives in enumerate(clauses)
        for a, alternative in enumerate(alternatives)
        for t in sorted(alternative)
    ]
    terms = F.broadcast(  # as many rows as the rules' queries have trigrams
        postings.sparkSession.createDataFrame(rows, "kind string, clause int, alternative int, needed int, trigram string")
    )
    clauses = F.create_map(*[F.lit(x) for kind, q in queries.items() for x in (kind, len(q))])
    met = postings.join(terms, "trigram").groupBy("doc_id", "kind", "clause", "alternative", "needed").agg(F.count_distinct("trigram").alias("n"))
    met = met.where("n = needed").groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("n"))
    return met.where(F.col("n") == clauses[F.col("kind")]).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, added: list[Rule] = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in whole texts.

    Rules with mandatory trigrams are verified in the documents whose postings meet their query;
    the others scan every text. Only texts that may be candidates, by a bitmap of fixed size, are shuffled to meet their rules.

    Returns one row per input row: doc_id, base and spans, arrays of struct<start, order, end, kind> sorted by start and then the
    rules' order; base holds the base kinds only. Null text counts as empty. Rows that repeat an id should repeat its text; each is
    returned. Rows with a null id are scanned fully. Other columns are left out.
    """
    rules = [*BASE, *added]
    order = {r.kind: i for i, r in enumerate(rules)}
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    trigrams = sorted({t for q in queries.values() for c in q for a in c for t in a})
    postings = stored(build_index(known, trigrams), "secret-postings")
    asked = stored(candidates(postings, queries), "secret-candidates")
    found = may_be_among(known, "doc_id", asked).join(asked.hint("merge"), "doc_id")
    kind = "struct<start:int,order:int,end:int,kind:string>"
    none = F.array().cast(f"array<{kind}>")
    indexed = [r for r in rules if r.kind in queries]
    verified = found.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        F.concat(
            *[F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, order[r.kind])).otherwise(none) for r in indexed]
        ).alias("found"),
    )
    verified = verified.where(F.size("found") > 0).dropDuplicates(["doc_id", "same"])
    full = [r for r in rules if r.kind not in queries]
    every = F.concat(*[spans_of(F.col("text"), r, order[r.kind]) for r in full]) if full else none
    unindexed = F.concat(*[spans_of(F.col("text"), r, order[r.kind]) for r in indexed])
    scanned = rows.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        F.concat(every, F.when(F.col("doc_id").isNull(), unindexed).otherwise(none)).alias("scanned"),
    )
    both = scanned.join(verified, ["doc_id", "same"], "left")
    spans = F.sort_array(F.concat("scanned", F.coalesce("found", none)))
    return both.select("doc_id", spans.alias("spans")).select(
        "doc_id", F.filter("spans", lambda s: s["order"] < len(BASE)).alias("base"), "spans"
    )


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()'s rows."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[number(r.kind) for r in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
