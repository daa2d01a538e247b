"""Conversation structure repair: turns are aligned with the strings of an alternating grammar, and the cheapest audit of edits wins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A turn's code is CODES[3 * role + fault]: roles s, u, a, other; faults none, truncated, blank or duplicate.
CODES, ROLES = "abcdefghijkl", "sua"
SOUND, CUT, BAD = 0, 1, 2
#: Turns that the alignment's table holds at a time; longer conversations take the same costs over the string's parity, turn by turn.
MOST_ALIGNED = 2048
#: Turns whose codes are gathered first, before those of a whole conversation.
BLOCK = 4096
FAR = np.int64(1) << 40
#: Where a repaired string may stand; the role that is due there, what it leads to, and what the end costs there.
NOTHING, OPENED, WHOLE, HALF = range(4)
DUE, NEXT, END = (1, 1, 1, 2), (HALF, HALF, HALF, WHOLE), (0, 2 * INSERT, 0, INSERT)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of the rows that a damage by crc32 of `conv_id:turn` leaves (dropped rows stay, marked).

    Of 20 remainders: 0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("dropped"), "hit")
    return rows.withColumn("_copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "hit")


def _key() -> Column:
    """A text that tells conversations apart, also where the id is null."""
    return F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))


def coded(rows: DataFrame) -> DataFrame:
    """_key, conv_id, the counts of a conversation's faults, and its turns in order as a string of codes (one character each).

    rows: conv_id, turn, role, text, dropped. Turns of equal number are taken by role and text. One exchange by conversation serves all windows.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.withColumns({"_key": _key(), "_blank": trimmed == "", "_cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "_role": F.substring("role", 1, 1)})
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    by = Window.partitionBy("_key", "dropped")
    inside = by.orderBy(*order)
    rows = rows.repartition("_key").withColumns(
        {
            "_at": F.row_number().over(inside).cast("long") - 1,
            "_before": F.lag("_role").over(inside),
            "_fresh": F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(inside) == F.col("turn"), F.lit(False)),
        }
    )
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy("_key", "dropped", "role", "text").orderBy("_at")) > 1)
    live = ~F.col("dropped")
    role = F.when(F.col("_role") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.col("_role")), F.lit(0)) - 1, F.lit(3)))
    fault = F.when(F.col("_blank") | F.col("_again"), BAD).when(F.col("_cut"), CUT).otherwise(SOUND)
    rows = rows.withColumn("_code", F.substring(F.lit(CODES), 3 * role + fault + 1, F.lit(1)))
    legal = F.concat("_before", "_role").isin("su", "ua", "au")
    counted = {"blank": F.col("_blank"), "duplicate": ~F.col("_blank") & F.col("_again"), "truncated": ~F.col("_blank") & ~F.col("_again") & F.col("_cut"),
               "illegal": ~legal, "fresh": F.col("_fresh")}
    joined = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(name)), lambda x: x["code"]), "")
    part = rows.groupBy("_key", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(
        F.first("conv_id").alias("conv_id"), F.min(F.when(live, F.col("turn"))).alias("lo"), F.max(F.when(live, F.col("turn"))).alias("hi"),
        *[F.count_if(live & v).alias(k) for k, v in counted.items()],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(live, F.struct(F.col("_at").alias("at"), F.col("_code").alias("code"))))), lambda x: x["code"]), "").alias("_codes"),
    )
    return part.groupBy("_key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("fresh"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        joined(F.struct(F.col("_block").alias("at"), F.col("_codes").alias("code"))).alias("codes"),
    )


def turned(codes: str) -> tuple[np.ndarray, np.ndarray]:
    """Roles (0 s, 1 u, 2 a, 3 other) and faults of a string of codes."""
    both = np.frombuffer(codes.encode(), np.uint8).astype(np.int64) - ord(CODES[0])
    return both // 3, both % 3


def incumbent(role: list[int], fault: list[int]) -> int:
    """The cost of a simple repair: faulty rows go, a leading s stays, and every other row takes the role that is due."""
    cost, state = 0, NOTHING
    for r, f in zip(role, fault):
        if f == BAD:
            cost += DELETE
        elif state == NOTHING and r == 0:
            state, cost = OPENED, cost + TRUNCATED * (f == CUT)
        else:
            cost += TRUNCATED * (f == CUT) + REROLE * (r != DUE[state])
            state = NEXT[state]
    return min(cost + END[state], DELETE * len(role))


def aligned(role: np.ndarray, fault: np.ndarray) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, by alignment with every feasible target.

    Targets of all lengths share their ends (..uaua), so one Wagner-Fischer table holds them all: cost[i][r] of making the last r symbols of
    turns i and on. Ukkonen's bands: with the sound turns left (u) and the spare cost of the incumbent, r lies between u - spare / 3 and
    u + spare / 2, else the repair costs more than the incumbent. The targets of the least cost are traced forward, each time by the least letter that keeps the
    cost, and the least audit is taken.
    """
    n, t = len(role), np.where(fault == CUT, TRUNCATED, 0)
    if not n:
        return 0, ""
    bad = fault == BAD
    spare = incumbent(role.tolist(), fault.tolist()) - DELETE * int(bad.sum())
    left = np.concatenate([np.cumsum(~bad[::-1])[::-1], [0]])
    low, wide = spare // DELETE, spare // DELETE + spare // INSERT + 1
    base = left - low  # the first r of each line of the table
    offset = np.arange(wide)
    cost = np.full((n + 1, wide + 2), FAR)  # a column of FAR at each side
    r = base[n] + offset
    cost[n, 1:-1] = np.where(r >= 0, INSERT * r, FAR)
    for i in range(n - 1, -1, -1):
        r = base[i] + offset
        shift = 0 if bad[i] else 1  # how much the band moves from this line to the next
        deleted = cost[i + 1, 1 + shift : 1 + shift + wide] + DELETE
        line = deleted
        if not bad[i]:
            fits = role[i] == np.where(r % 2 == 0, 1, 2)
            used = cost[i + 1, shift : shift + wide] + t[i] + np.where(fits, 0, REROLE)
            line = np.minimum(deleted, np.where(r >= 1, used, FAR))
        line = np.where(r >= 0, line, FAR)
        slope = INSERT * offset
        cost[i, 1:-1] = np.minimum.accumulate(line - slope) + slope  # insertions run along the line
    cost = np.minimum(cost, FAR)

    def at(i: int, r: int) -> int:
        k = r - int(base[i])
        return int(cost[i, k + 1]) if 0 <= k < wide and r >= 0 else int(FAR)

    def trace(i: int, r: int) -> str:
        out = []
        while i < n or r:
            now = at(i, r)
            if i < n and at(i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and at(i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if role[i] == (1 if r % 2 == 0 else 2) else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    # starts: (cost, turns deleted before, whether an s is kept there, length after it)
    starts = [(at(0, int(r)), 0, False, int(r)) for r in base[0] + offset if r >= 0 and r % 2 == 0]
    for i in np.flatnonzero((role == 0) & ~bad).tolist():
        if DELETE * i > spare + DELETE * int(bad.sum()):
            break
        starts += [(DELETE * i + int(t[i]) + at(i + 1, int(r)), i, True, int(r)) for r in base[i + 1] + offset if r >= 2 and r % 2 == 0]
    best = min(s[0] for s in starts)
    return best, min("D" * i + "K" + trace(i + 1, r) if kept else trace(0, r) for c, i, kept, r in starts if c == best)


def automaton(role: list[int], fault: list[int]) -> tuple[int, str]:
    """The same cost and audit in linear time and a few numbers a turn: targets of all lengths are told apart by their state only."""
    lines, after = [], list(END)
    for r, f in zip(reversed(role), reversed(fault)):
        t = TRUNCATED * (f == CUT)
        line = [c + DELETE for c in after]
        if f != BAD:
            for s in range(4):
                line[s] = min(line[s], after[NEXT[s]] + t + REROLE * (r != DUE[s]))
            if r == 0:
                line[NOTHING] = min(line[NOTHING], after[OPENED] + t)
        for _ in range(2):  # insertions move between states at one turn
            line = [min(line[s], line[NEXT[s]] + INSERT) for s in range(4)]
        lines.append(line)
        after = line
    lines = [*reversed(lines), list(END)]
    out, s, i, n = [], NOTHING, 0, len(role)
    while i < n or lines[n][s]:
        now = lines[i][s]
        if i < n and lines[i + 1][s] + DELETE == now:
            out.append("D")
            i += 1
        elif lines[i][NEXT[s]] + INSERT == now:
            out.append("I")
            s = NEXT[s]
        else:
            opens = s == NOTHING and role[i] == 0 and lines[i + 1][OPENED] + TRUNCATED * (fault[i] == CUT) == now
            out.append("K" if opens or role[i] == DUE[s] else "R")
            s = OPENED if opens else NEXT[s]
            i += 1
    return int(lines[0][NOTHING]), "".join(out)


def tokens(audit: str, role: list[int]) -> str:
    """What becomes of each turn, in order: K, D, U and A (given to the user, the assistant), after u and a for each turn inserted before it."""
    out, i, state = [], 0, NOTHING
    for e in audit:
        if e == "I":
            out.append("ua"[DUE[state] - 1])
            state = NEXT[state]
            continue
        if e == "R":
            out.append("UA"[DUE[state] - 1])
        else:
            out.append(e)
        if e != "D":
            state = OPENED if e == "K" and role[i] == 0 else NEXT[state]
        i += 1
    return "".join(out)


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known: dict[str, tuple[int, str, str]] = {}  # conversations of equal codes have one repair
        for codes in pdf["codes"].unique():
            role, fault = turned(codes)
            cost, audit = aligned(role, fault) if len(codes) <= MOST_ALIGNED else automaton(role.tolist(), fault.tolist())
            known[codes] = (cost, audit, tokens(audit, role.tolist()))
        for k, name in enumerate(("cost", "audit", "tokens")):
            pdf[name] = [known[c][k] for c in pdf["codes"]]
        yield pdf.drop(columns="codes")


class _Digest:
    """The digest of one repaired conversation, its turns taken one after another."""

    def __init__(self, tokens: str):
        self.tokens, self.at, self.hash, self.empty = tokens, 0, hashlib.sha256(), True

    def line(self, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(text.encode())

    def inserted(self) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at] in "ua":
            self.line("user:" if self.tokens[self.at] == "u" else "assistant:")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.tokens[self.at]
        self.at += 1
        if edit != "D":
            self.line({"K": role, "U": "user", "A": "assistant"}[edit] + ":" + text)

    def close(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text and, if given, dropped (rows that count only for the conversation to be listed). A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated. Edits are Keep, Rerole, Delete and Insert, the audit their initials; the repaired roles
    spell `(s?(ua)+)?`; of audits of the least cost the least one in ASCII wins.

    Null ids are one conversation; null turns come first and count in no gap; a null role or text is one space; turns of equal
    number are taken by role and text; a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty
    table gives an empty one; other columns are left out. Turns are aligned as one character each. Texts are hashed as they stream by in order,
    never held: a digest is sequential, so one conversation's texts pass through one task, in bounded memory, whatever its length.
    """
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    kind = rows.schema["conv_id"].dataType.simpleString()
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", known("role"), known("text"), "dropped")
    done = coded(rows).select("_key", F.col("conv_id").cast("string").alias("conv_id"), F.array(*COUNTS[:-1]).alias("counts"), "codes")
    done = done.mapInPandas(_repairs, "_key string, conv_id string, counts array<long>, cost long, audit string, tokens string")
    live = rows.where(~F.col("dropped")).select(_key().alias("_key"), F.lit(1).alias("kind"), "turn", "role", "text")
    both = done.withColumn("kind", F.lit(0)).unionByName(live, allowMissingColumns=True)
    both = both.repartition("_key").sortWithinPartitions("_key", "kind", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, digest = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.kind == 0:
                    if head is not None:
                        out.append((*head, digest.close()))
                    head, digest = (row.conv_id, *map(int, row.counts), int(row.cost), row.audit), _Digest(row.tokens)
                else:
                    digest.turn(row.role, row.text)
            if out:
                yield pd.DataFrame(out, columns=names)
        if head is not None:
            yield pd.DataFrame([(*head, digest.close())], columns=names)

    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    both = both.select("kind", "conv_id", "counts", "cost", "audit", "tokens", "role", "text")
    out = both.mapInPandas(run, f"conv_id string, {', '.join(c + ' long' for c in COUNTS)}, audit string, repaired_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
