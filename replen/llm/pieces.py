"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs for merge-type vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Segments whose merges a worker keeps before it starts anew (only speed depends on it).
MOST_SEGMENTS = 600_000
#: Symbols of a segment that is merged together with others of its length.
WIDEST = 64
#: The rank of a pair that makes no piece.
NONE = np.int32(1 << 30)
#: Compatibility forms, combining marks, spaces and cases, which other normalisers than the identity change.
PROBE = "\ufb01 \u2460 A\u0301 \uff21 \u00df  \u00a0X"


class Agenda:
    """Encodes and decodes with the pieces and scores of one merge-type (BPE) model with byte fallback.

    A text is cut where no piece can span the cut: before a space mark that follows another symbol, and around line feeds. Segments repeat, so those
    that a worker has not met yet are merged together, in arrays, and kept. The library checks every new segment.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, n = self.library, self.library.get_piece_size()
        if sp.normalize(PROBE) != SPACE_MARK + PROBE.replace(" ", SPACE_MARK):
            raise ValueError("the model changes texts before it encodes them; only identity normalisers are supported")
        self.pieces = sp.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece spans words or lines; texts cannot be cut there")
        self.cut = re.compile(rf"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n").findall
        self.lead = len(sp.encode("\n"))
        plain_bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        plain_bytes[self.unknown], plain_bytes[self.end] = sp.decode([self.unknown]).encode(), b""
        self.text = Ragged(map(len, plain_bytes), np.frombuffer(b"".join(plain_bytes), np.uint8))
        # Symbols are piece ids; characters that are only parts of pieces get ids beyond them, others are negative.
        symbol = dict(self.id)
        for c in sorted({c for p in self.id for c in p} - self.id.keys()):
            symbol[c] = n + len(symbol)
        self.single = {i: c for c, i in symbol.items() if i >= n}
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        best_first = sorted(plain, key=lambda i: -sp.get_score(i))
        scores = [sp.get_score(i) for i in best_first]
        if len(set(scores)) < len([i for i in best_first if len(self.pieces[i]) > 1]):
            raise ValueError("pieces share scores; ranks cannot stand for them")
        self.by_rank = np.array(best_first, np.int32)
        rank: dict[int, int] = {}
        for r, i in enumerate(best_first):
            p = self.pieces[i]
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    rank[left << 32 | right] = r
        self.pair_keys = np.array(sorted(rank), np.int64)
        self.pair_ranks = np.array([rank[k] for k in self.pair_keys.tolist()], np.int32)
        self.forget()

    def forget(self) -> None:
        """Start anew with no segment known but the end of a text."""
        self.number: dict[str, int] = {"": 0}
        self.known = Ragged([1], np.array([self.end], np.int32))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs of symbols make; NONE where they make none."""
        keys = left.astype(np.int64) << 32 | right  # a negative symbol makes a key that is not listed
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge(self, segments: list[str]) -> Ragged:
        """Ids of each segment: merge the adjacent pair with the best score, the leftmost of equals, until none is a piece.

        The agenda of a segment is a row of pair ranks; each round takes the least of every row at once. Segments over
        WIDEST symbols have an agenda of their own (a heap), as a row as long would be gone through for each of its merges.
        """
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[points]
        starts = np.cumsum(sizes) - sizes
        found = [(np.array([i]), self._merge_long(symbols[starts[i] : starts[i] + sizes[i]].tolist())[None]) for i in np.flatnonzero(sizes > WIDEST)]
        for size in np.unique(sizes[sizes <= WIDEST]).tolist():
            members = np.flatnonzero(sizes == size)
            for at in range(0, len(members), 1 << 13):
                which = members[at : at + (1 << 13)]
                found += [(which[k], rows) for k, rows in self._merge_rows(symbols[starts[which][:, None] + np.arange(size)])]
        place = np.concatenate([which for which, _ in found])
        widths = np.concatenate([np.full(len(which), rows.shape[1]) for which, rows in found])
        merged = Ragged(widths, np.concatenate([rows.ravel() for _, rows in found]))
        order = np.empty_like(place)
        order[place] = np.arange(len(place))
        _, flat = merged.take(order)
        return self._with_bytes(Ragged(widths[order], flat))

    def _with_bytes(self, merged: Ragged) -> Ragged:
        """Piece ids of merged symbols; characters without a piece are their bytes, or unknown."""
        odd = np.flatnonzero((merged.flat < 0) | (merged.flat >= len(self.pieces)))
        if not len(odd):
            return merged
        sizes, spelt = np.ones(len(merged.flat), np.int64), {}
        for k in odd.tolist():
            i = int(merged.flat[k])
            c = chr(-1 - i) if i < 0 else self.single[i]
            spelt[k] = [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
            sizes[k] = len(spelt[k])
        flat = np.repeat(merged.flat, sizes)
        ends = np.cumsum(sizes)
        for k, ids in spelt.items():
            flat[ends[k] - len(ids) : ends[k]] = ids
        total = np.r_[0, ends]
        return Ragged(total[merged.starts + merged.sizes] - total[merged.starts], flat)

    def _merge_rows(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The merges of segments of one length, a row each: (rows' places, merged rows) for those that end in the same round."""
        of = np.arange(len(rows))
        agenda = self.ranks(rows[:, :-1], rows[:, 1:])
        while len(of):
            if not agenda.shape[1]:
                yield of, rows
                return
            i = agenda.argmin(1)
            best = agenda[np.arange(len(of)), i]
            done = best == NONE
            if done.any():
                yield of[done], rows[done]
                go = ~done
                of, rows, agenda, i, best = of[go], rows[go], agenda[go], i[go], best[go]
            line, width = np.arange(len(of)), rows.shape[1] - 1
            rows[line, i] = self.by_rank[best]
            rest = np.ones(rows.shape, bool)
            rest[line, i + 1] = False
            rows = rows[rest].reshape(len(of), width)
            rest = np.ones(agenda.shape, bool)
            rest[line, i] = False
            agenda = agenda[rest].reshape(len(of), width - 1)
            right, left = np.flatnonzero(i < width - 1), np.flatnonzero(i > 0)
            at = i[right]
            agenda[right, at] = self.ranks(rows[right, at], rows[right, at + 1])
            at = i[left]
            agenda[left, at - 1] = self.ranks(rows[left, at - 1], rows[left, at])

    def _merge_long(self, symbols: list[int]) -> np.ndarray:
        """The agenda as a heap of (rank, place); entries whose pair is gone are skipped."""
        n = len(symbols)
        first = self.ranks(np.array(symbols[:-1], np.int32), np.array(symbols[1:], np.int32)).tolist()

        def pair(i: int, j: int) -> int:
            return int(self.ranks(np.array([symbols[i]], np.int32), np.array([symbols[j]], np.int32))[0])

        agenda = [(r, i) for i, r in enumerate(first) if r != NONE]
        now = {i: r for r, i in agenda}  # the rank of the pair that begins at a place
        heapify(agenda)
        right, left, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        while agenda:
            r, i = heappop(agenda)
            if gone[i] or now.get(i) != r:
                continue
            j = right[i]
            symbols[i], gone[j] = int(self.by_rank[r]), 1
            now.pop(j, None)
            k, h = right[j], left[i]
            right[i] = k
            if k < n:
                left[k] = i
            for a, b in ((i, k), (h, i)):
                if a < 0:
                    continue
                now.pop(a, None)
                if b < n and (q := pair(a, b)) != NONE:
                    now[a] = q
                    heappush(agenda, (q, a))
        return np.array([s for s, g in zip(symbols, gone) if not g], np.int32)

    def segments(self, text: str) -> list[str]:
        """Cuts of a text; a segment without a line feed in front stands for itself after a space mark, one with a carriage return for what follows it."""
        if not text:
            return []
        if "  " in text or " \n" in text or SPACE_MARK in text or "\r" in text or text[0] in " \n" or text[-1] == " ":
            return ["\r" + s for s in self.cut(SPACE_MARK + text.replace(" ", SPACE_MARK))]
        return text.replace("\n", " \n").split(" ")

    def expand(self, key: str) -> str:
        """The symbols that a key of segments() stands for."""
        return key[1:] if key[0] == "\r" else key if key[0] == "\n" else SPACE_MARK + key

    def learn(self, fresh: list[str]) -> None:
        """Merge segments that are not known yet; the library must give the same ids for every one."""
        expanded = [self.expand(k) for k in fresh]
        found = self.merge(expanded)
        expected = self.library.encode(["\n" + e for e in expanded], num_threads=1)
        checked = Ragged(map(len, expected), np.fromiter(chain.from_iterable(expected), np.int32))
        body = np.ones(len(checked.flat), bool)
        for k in range(self.lead):
            body[checked.starts + k] = False
        if not (np.array_equal(found.sizes, checked.sizes - self.lead) and np.array_equal(found.flat, checked.flat[body])):
            raise RuntimeError("the agenda and the library differ on a segment")
        self.number.update(zip(fresh, range(len(self.known.sizes), len(self.known.sizes) + len(fresh))))
        self.known = Ragged(np.concatenate([self.known.sizes, found.sizes]), np.concatenate([self.known.flat, found.flat]))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of each text's ids, all ids one after another (an end id closes each text), ends of each decoded text and all their bytes."""
        if len(self.number) > MOST_SEGMENTS:
            self.forget()
        cut = [self.segments(t) + [""] for t in texts]
        flat = list(chain.from_iterable(cut))
        which = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(which < 0)):
            new = [flat[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            which[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        ends, ids = self.known.take(which)
        ends = ends[np.cumsum(list(map(len, cut))) - 1]
        until, raw = self.text.take(ids)
        # A space mark that stands before a text is no part of it.
        starts = np.r_[0, ends[:-1]]
        first = np.r_[0, until][starts]
        until = until[ends - 1]
        lead = first[(first < until)]
        lead = lead[raw[lead] == 32]
        keep = np.ones(len(raw), bool)
        keep[lead] = False
        until = until - np.searchsorted(lead, until, "left")
        raw = raw[keep]
        whole = ids[: ends[0] - 1].tolist()
        if whole != self.library.encode(texts[0]) or raw[: until[0]].tobytes().decode() != self.library.decode(whole):
            raise RuntimeError("the agenda and the library differ on a whole text")
        return np.r_[0, ends], ids, np.r_[0, until], raw


class Ragged:
    """Arrays of unequal sizes, one after another."""

    def __init__(self, sizes: Iterable[int], flat: np.ndarray):
        self.sizes = sizes if isinstance(sizes, np.ndarray) else np.fromiter(sizes, np.int64)
        self.flat, self.starts = flat, np.cumsum(self.sizes) - self.sizes

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends and the contents of the chosen arrays."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return ends, self.flat[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


_made: dict[int, Agenda] = {}


def agenda_for(model: bytes) -> Agenda:
    """One per worker process and model."""
    if (key := hash(model)) not in _made:
        _made.clear()
        _made[key] = Agenda(model)
    return _made[key]


def runs_of(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver (a few hundred kB: its size is that of the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with an end id and decode them again.

    Returns one row per input row: doc_id, ids array<int> (end id last), decoded string.
    Null text counts as empty (its ids are the end id alone); repeated rows repeat;
    other columns of docs are left out; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_for(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in runs_of(texts):
                ends, flat, until, raw = agenda.encode_batch(texts[start:end])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                decoded = pa.StringArray.from_buffers(end - start, pa.py_buffer(until.astype(np.int32)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), ids, decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string"
    )


def with_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
