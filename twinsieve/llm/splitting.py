"""Problem 9: splitting oversized texts at natural boundaries.

A text above a limit is cut where its tokens can be parted without changing them: at the beginnings of
pre-tokens, and inside a pre-token between two bytes that stand side by side in no token. Each such
place has a strength (blank line, line, sentence, clause, word, none). A sparse table answers which
place in a window is the strongest, the rightmost on a tie; the window runs from half the limit to the
limit behind the start of the piece, and where it has no natural boundary, from the overlap on. The next piece starts as many tokens before the cut as the
overlap says. Only where no such place exists, within a run of letters longer than the limit, a cut
goes between two characters, and the pieces beside it are encoded again and shortened if need be.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinsieve.llm import tokenizer
from twinsieve.llm.tokenizer import SPACE, Encoder

MAX_LIMITS = 100
SHORT, MAX_COUNTS = 32, 100_000

# Characters that end a sentence or a clause, and closing marks that may follow them.
SENTENCE = "。！？!?…｡．.;；"
CLAUSE = "，,、:：﹐､"
CLOSERS = "」』”’\"')）】》〉］]"


def _table(chars: str) -> np.ndarray:
    return np.array(sorted(map(ord, chars)), dtype=np.uint32)


def strengths(codes: np.ndarray, at: np.ndarray, kinds: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point at[i] > 0: 5 blank line, 4 line, 3 sentence, 2 clause, 1 word, 0."""
    before = codes[at - 1]
    two = codes[np.maximum(at - 2, 0)]
    after = codes[np.minimum(at, len(codes) - 1)]
    last = np.where(np.isin(before, _table(CLOSERS)), two, before)
    open_end = ~((kinds[after] < SPACE) & np.isin(last, _table(".．")))  # a point inside a number or a name
    out = word.astype(np.int64)
    out[np.isin(last, _table(CLAUSE))] = 2
    out[np.isin(last, _table(SENTENCE)) & open_end] = 3
    line = (before == 10) | (before == 13)
    out[line] = 4
    out[line & ((two == 10) | (two == 13))] = 5
    return out


class RangeMax:
    """Sparse table: position of the greatest value in a range, the rightmost on a tie."""

    def __init__(self, values: np.ndarray, longest: int):
        level = values.astype(np.int64) << 40 | np.arange(len(values))
        self.levels = [level]
        step = 1
        while 2 * step <= min(longest, len(values)):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def strongest(self, wide: int, first: int, last: int) -> int:
        """argmax(first, last), or from wide on if all values from first on are 0."""
        at = self.argmax(first, last)
        return at if wide >= first or int(self.levels[0][at]) >> 40 else self.argmax(wide, last)

    def argmax(self, first: int, last: int) -> int:
        """first <= last, both inclusive."""
        k = min((last - first + 1).bit_length() - 1, len(self.levels) - 1)
        level = self.levels[k]
        best = max(int(level[first]), int(level[last - (1 << k) + 1]))
        at = first + (1 << k)
        while at + (1 << k) <= last:  # only for ranges longer than the table was built for
            best = max(best, int(level[at]))
            at += 1 << k
        return best & (1 << 40) - 1


class Splitter:
    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.counts: dict[str, int] = {}  # of short texts, such as runs of white space

    def block(self, texts: list[str], limits: list[tuple[str, int, int]]) -> Iterator[tuple[int, str, int, int, int, int, int]]:
        """(text number, limit name, piece number, start, end, tokens, overlap tokens) of all pieces."""
        v = self.encoder.v
        e = self.encoder.block(texts)
        if not len(e.ids) or not any(np.diff(e.text_tokens).max() > m for _, m, _ in limits):
            return
        codes, chars = e.codes, len(e.codes)
        data = np.frombuffer("".join(texts).encode("utf-8"), dtype=np.uint8)
        ends = np.concatenate([[0], np.cumsum(v.length[e.ids])])
        kind = v.kinds[codes]
        start = np.zeros(chars + 1, dtype=bool)
        start[e.pretoken_chars] = True
        # Inside runs of anything but white space, between bytes that no token joins, not before an apostrophe.
        byte = e.char_bytes[1:-1]
        inner = np.zeros(chars + 1, dtype=bool)
        inner[1:-1] = ~v.joins[data[byte - 1], data[byte]] & (kind[1:] == kind[:-1]) & (kind[1:] != SPACE) & (codes[1:] != 39) & (codes[:-1] != 39)
        place = start | inner
        place[e.text_chars] = True
        at = np.flatnonzero(place)
        before = np.searchsorted(ends, e.char_bytes[at], side="left")  # tokens before each place
        words = start[at] & ~inner[at]
        power = strengths(codes, np.maximum(at, 1), v.kinds, words)
        best = RangeMax(power, max(m for _, m, _ in limits) + 1)
        # The first code point of the run of white space that ends at each place, if one does.
        fresh = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if chars else np.zeros(0, np.int64)
        first = np.searchsorted(at, e.text_chars[:-1])
        last = np.searchsorted(at, e.text_chars[1:])
        sizes = np.diff(e.text_tokens).tolist()
        for i, size in enumerate(sizes):
            todo = [x for x in limits if size > x[1]]
            if not todo:
                continue
            a, b = int(first[i]), int(last[i])
            tokens = before[a : b + 1].tolist()
            where = at[a : b + 1].tolist()
            for name, most, overlap in todo:
                cuts = self._cuts(tokens, best, a, most, overlap)
                base = int(e.text_chars[i])
                if cuts is None:
                    for k, (s, t, n, o) in enumerate(self._characters(texts[i], most, overlap)):
                        yield i, name, k, s, t, n, o
                    continue
                pieces = []
                for s, t, o in cuts:
                    n = tokens[t] - tokens[s]
                    if kind[where[t] - 1] == SPACE:
                        run = max(int(fresh[np.searchsorted(fresh, where[t] - 1, side="right") - 1]), where[s])
                        j = bisect_left(where, run)
                        if j < len(where) and where[j] == run:
                            n += self._count(texts[i][run - base : where[t] - base]) - (tokens[t] - tokens[j])
                        else:
                            n = self._count(texts[i][where[s] - base : where[t] - base])
                    pieces.append((where[s] - base, where[t] - base, n, o))
                if any(n > most for _, _, n, _ in pieces):
                    pieces = self._characters(texts[i], most, overlap)
                for k, (s, t, n, o) in enumerate(pieces):
                    yield i, name, k, s, t, n, o

    @staticmethod
    def _cuts(tokens: list[int], best: RangeMax, offset: int, most: int, overlap: int) -> list[tuple[int, int, int]] | None:
        """(start, cut, overlap with the piece before) as places of one text; None if a place is missing."""
        out, s, shared, final = [], 0, 0, len(tokens) - 1
        done = 0
        while True:
            begun = tokens[s]
            if tokens[final] - begun <= most:
                out.append((s, final, shared))
                return out
            hi = bisect_right(tokens, begun + most) - 1
            lo = max(bisect_left(tokens, begun + max(most // 2, overlap + 1)), done + 1)
            if lo > hi:
                lo = max(done, bisect_left(tokens, begun + overlap + 1)) if done else s + 1
                lo = max(lo, done + 1)
                if lo > hi:
                    return None
            wide = max(bisect_left(tokens, begun + overlap + 1), done + 1)
            cut = best.strongest(offset + wide, offset + lo, offset + hi) - offset
            out.append((s, cut, shared))
            s = bisect_right(tokens, tokens[cut] - overlap) - 1
            shared = tokens[cut] - tokens[s]
            # An overlap far above what was asked for means that no place lies near: characters decide.
            if s <= out[-1][0] or shared > overlap + max(8, most // 8):
                return None
            done = cut

    def _count(self, text: str) -> int:
        if len(text) > SHORT:
            return len(self.encoder.block([text]).ids)
        if text not in self.counts:
            if len(self.counts) >= MAX_COUNTS:
                self.counts.clear()
            self.counts[text] = len(self.encoder.block([text]).ids) if text else 0
        return self.counts[text]

    def _characters(self, text: str, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """Pieces of a text with runs longer than the limit, cut between characters; every count is encoded."""
        e = self.encoder.block([text])
        ends = np.cumsum(self.encoder.v.length[e.ids])
        upto = np.searchsorted(ends, e.char_bytes, side="left").tolist()  # tokens that end before each character
        upto[0] = 0
        place = np.zeros(len(text) + 1, dtype=bool)
        place[e.pretoken_chars] = True
        power = strengths(e.codes, np.arange(1, len(text) + 1), self.encoder.v.kinds, place[1:])
        best = RangeMax(np.concatenate([[0], power]), most + 1)
        out, s, shared, done, total = [], 0, 0, 0, len(text)
        while True:
            room = most
            while True:
                if upto[total] - upto[s] <= room:
                    cut = total
                else:
                    hi = max(bisect_right(upto, upto[s] + room) - 1, done + 1)
                    lo = min(max(bisect_left(upto, upto[s] + max(room // 2, overlap + 1)), done + 1), hi)
                    cut = best.strongest(max(bisect_left(upto, upto[s] + overlap + 1), done + 1), lo, hi)
                n = self._count(text[s:cut])
                if n <= most or cut <= done + 1:
                    break
                room -= max(1, n - most)
            out.append((s, cut, n, shared))
            if cut == total:
                return out
            done = cut
            back = max(bisect_right(upto, upto[cut] - overlap) - 1, s + 1)
            s = min(back, cut)
            shared = self._count(text[s:cut])


def split(docs: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", folder: str = tokenizer.TOKENIZER_DIR, file: str = tokenizer.RANKS_FILE) -> DataFrame:
    """Pieces of every text above a limit, for each row of limits (limit_name, max_tokens, overlap_tokens).

    Columns: limit_name, key, piece_no (from 0), char_start, char_end (code points), n_tokens (of the
    piece encoded by itself, at most max_tokens), overlap_tokens (shared with the piece before, at
    least the overlap asked for where the piece before has as many), text. The pieces cover the text
    without a gap. Texts at or below a limit, null and empty ones give no piece; repeated rows are cut
    repeatedly. A limit must be at least 8 tokens and its overlap below half of it. No shuffle.
    """
    asked = limits.limit(MAX_LIMITS + 1).collect()
    if len(asked) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    bounds = [(r["limit_name"], int(r["max_tokens"]), int(r["overlap_tokens"] or 0)) for r in asked]
    if any(m < 8 or o < 0 or 2 * o >= m for _, m, o in bounds):
        raise ValueError("a limit must be at least 8 and its overlap below half of it")
    tables = tokenizer.broadcast_vocabulary(docs.sparkSession, folder, file)
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["limit_name", key, "piece_no", "char_start", "char_end", "n_tokens", "overlap_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer.worker_encoder(tables))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tokenizer.blocks(texts):
                got = list(splitter.block(texts[a:b], bounds)) if bounds else []
                if got:
                    which, name, no, s, t, n, o = zip(*got)
                    parts = [texts[a + i][x:y] for i, x, y in zip(which, s, t)]
                    keys = batch.column(0).take(pa.array([a + i for i in which]))
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), keys, *(pa.array(c, pa.int32()) for c in (no, s, t, n, o)), pa.array(parts, pa.string())], names=names)

    return rows.mapInArrow(run, f"limit_name string, `{key}` {kind}, piece_no int, char_start int, char_end int, n_tokens int, overlap_tokens int, text string")
