"""Problem 7: encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens. A
pre-token that is none is split at byte pairs that stand side by side in no token, which no merge can
ever cross, so the parts are independent; the parts are looked up the same way, and what is left is
merged by a heap over linked bytes, once per distinct part. All lookups are vectorised over a block of
documents, and no text is cut: a block holds whole documents.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from twinsieve.session import ship

TOKENIZER_DIR = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 400_000
MEMO_LIMIT = 200_000

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_EMPTY32 = np.zeros(0, dtype=np.int32)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        got = np.full(1 << max(16, n.bit_length()), base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 1 << 22:
            _POWERS[int(base)] = got
    return got[:n]


@dataclass
class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys take the slots 0..n-1, one each."""

    displacement: np.ndarray
    size: int

    @staticmethod
    def build(keys: np.ndarray) -> tuple["PerfectHash", np.ndarray]:
        """keys: distinct 64-bit hashes. Returns the hash and the slot of each key."""
        n = len(keys)
        buckets = max(1, n // 3)
        bucket = (_mix(keys, 1) % np.uint64(buckets)).astype(np.int64)
        one, two = _mix(keys, 2), _mix(keys, 3) | np.uint64(1)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        taken = np.zeros(n, dtype=bool)
        slots = np.empty(n, dtype=np.int64)
        displacement = np.zeros(buckets, dtype=np.int64)
        sizes = np.diff(starts)
        singles = []
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, int(own[0])))
                continue
            base = np.uint64(0)
            while True:
                at = ((one[own][None, :] + (tries + base)[:, None] * two[own][None, :]) % np.uint64(n)).astype(np.int64)
                free = ~taken[at].any(axis=1)
                for row in np.flatnonzero(free).tolist():
                    if len(set(at[row].tolist())) == len(own):
                        break
                else:
                    base += np.uint64(64)
                    if base > 1 << 24:
                        raise ValueError("two keys have the same hashes")
                    continue
                slots[own] = at[row]
                taken[at[row]] = True
                displacement[b] = int(base) + row
                break
        for (b, key), slot in zip(singles, np.flatnonzero(~taken).tolist()):
            slots[key] = slot
            displacement[b] = -slot - 1
        return PerfectHash(displacement, n), slots

    def slot(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacement[(_mix(keys, 1) % np.uint64(len(self.displacement))).astype(np.int64)]
        at = (_mix(keys, 2) + d.astype(np.uint64) * (_mix(keys, 3) | np.uint64(1))) % np.uint64(self.size)
        return np.where(d < 0, -d - 1, at.astype(np.int64))


@dataclass
class Vocabulary:
    """Vocabulary tables; their size is that of the vocabulary, whatever the corpus."""

    tokens: list[bytes]
    hashes: PerfectHash
    id_at: np.ndarray  # slot -> token id
    hash_at: np.ndarray  # slot -> 64-bit hash of the token's bytes
    kinds: np.ndarray  # code point -> kind of character for the pre-token pattern
    length: np.ndarray  # id -> number of bytes
    joins: np.ndarray  # 256 x 256: the two bytes stand side by side in some token

    @staticmethod
    def load(folder: str = TOKENIZER_DIR, file: str = RANKS_FILE) -> "Vocabulary":
        """Reads a rank file; a token's rank is its id and the order of its merge."""
        ranks: dict[int, bytes] = {}
        with open(os.path.join(folder, file), "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
        return Vocabulary.of([ranks[i] for i in range(len(ranks))])

    @staticmethod
    def of(tokens: list[bytes]) -> "Vocabulary":
        length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        joins = np.zeros((256, 256), dtype=bool)
        inner = np.ones(len(data), dtype=bool)
        inner[start] = False
        at = np.flatnonzero(inner)
        joins[data[at - 1], data[at]] = True
        keys = _segment_hashes(data, start, start + length)
        hashes, slots = PerfectHash.build(keys)
        id_at = np.empty(len(tokens), dtype=np.int64)
        id_at[slots] = np.arange(len(tokens))
        return Vocabulary(tokens, hashes, id_at, keys[id_at], character_kinds(), length, joins)


def _segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each data[start:end], from prefix sums; equal bytes give equal hashes."""
    n = len(data)
    if not n:
        return np.zeros(len(start), dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _R), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(n + 1, _RI)[start]
    return _mix(h ^ (end - start).astype(np.uint64) << np.uint64(48), 7)


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def character_kinds() -> np.ndarray:
    """Kind of every code point, by the classes that PATTERN uses."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(rule, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 < b:
                kinds[a:0xD800] = kind
                a = 0xE000
            kinds[a : b + 1] = kind
    return kinds


def pretoken_starts(codes: np.ndarray, text_starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Code-point offsets at which the matches of PATTERN begin, for texts laid end to end.

    A match is a run of one kind; the last space of white space before another run belongs to that
    run, if it is a plain space, else it stands alone; a lone apostrophe takes its English ending.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = kinds[codes]
    fresh = np.zeros(n + 1, dtype=bool)  # a text begins here, or the block ends
    fresh[text_starts[text_starts < n]] = True
    fresh[n] = True
    run = fresh.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    out = run[:n].copy()
    # White space before another run of the same text: its last character leaves the run.
    joint = np.flatnonzero(run[1:n] & ~fresh[1:n] & (kind[:-1] == SPACE)) + 1
    out[joint - 1] = True
    plain = joint[codes[joint - 1] == 32]
    out[plain] = False
    # An apostrophe alone in its run, with no space taken in, and the ending after it.
    quote = np.flatnonzero(out & run[:n] & (codes == 39) & run[1:] & ~fresh[1:])
    for q in quote.tolist():
        stop = q + 1
        after = [int(c) for c in codes[q + 1 : q + 3]]
        if after[0] in (115, 116, 109, 100):  # s t m d
            stop = q + 2
        elif len(after) == 2 and not fresh[q + 2] and after in ([114, 101], [118, 101], [108, 108]):  # re ve ll
            stop = q + 3
        if stop > q + 1:
            out[q + 1] = False
            if stop < n:
                # What follows the ending: letters go on as a run of their own; other starts are as they are.
                out[stop] |= kind[stop] == LETTER and not fresh[stop]
    return np.flatnonzero(out)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each range, one after another."""
    total = int(count.sum())
    out = np.ones(total, dtype=np.int64)
    some = count > 0
    start, count = start[some], count[some]
    if not len(start):
        return out
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    out[at] = start
    out[at[1:]] -= start[:-1] + count[:-1] - 1
    return np.cumsum(out)


def merge_bytes(part: bytes, rank: dict[bytes, int]) -> list[int]:
    """Byte-pair merges in order of rank, leftmost first, with a heap over a doubly linked list of parts."""
    n = len(part)
    ends = list(range(1, n + 1))
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, right, end = heapq.heappop(heap)
        if not alive[left] or right >= n or not alive[right] or following[left] != right or ends[right] != end:
            continue
        ends[left] = end
        alive[right] = False
        after = following[left] = following[right]
        if after < n:
            previous[after] = left
            if (r := rank.get(part[left : ends[after]])) is not None:
                heapq.heappush(heap, (r, left, after, ends[after]))
        before = previous[left]
        if before >= 0 and (r := rank.get(part[before:end])) is not None:
            heapq.heappush(heap, (r, before, left, end))
    out, i = [], 0
    while i < n:
        out.append(rank[part[i : ends[i]]])
        i = following[i]
    return out


@dataclass
class Encoded:
    """Tokens of a block of texts."""

    ids: np.ndarray  # int32, all texts in order
    text_tokens: np.ndarray  # text i has ids[text_tokens[i]:text_tokens[i + 1]]
    pretoken_chars: np.ndarray  # code-point offset, in the block, at which each pre-token begins
    text_chars: np.ndarray  # text i has the code points text_chars[i]:text_chars[i + 1] of the block
    codes: np.ndarray  # code points of the block
    char_bytes: np.ndarray  # byte offset of each code point, and the end


class Encoder:
    """Encodes blocks of texts; holds the memo of parts that needed merges, bounded by MEMO_LIMIT."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rank = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.memo: dict[bytes, np.ndarray] = {}

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Token id of each segment that is one token as a whole, else -1.

        Each segment is held against one slot only, by its length and a hash of 64 bits, so a segment
        that is no token passes for one with a probability of 2^-64.
        """
        v = self.v
        slot = v.hashes.slot(hashes)
        ids = v.id_at[slot]
        return np.where((v.hash_at[slot] == hashes) & (v.length[ids] == end - start), ids, -1)

    def block(self, texts: list[str]) -> Encoded:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        text_chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
        pre = np.concatenate([pretoken_starts(codes, text_chars[:-1], self.v.kinds), [len(codes)]])
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        char_bytes = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        bounds = char_bytes[pre]
        ids, ends = self._segments(data, bounds[:-1], bounds[1:])
        text_tokens = np.searchsorted(ends, char_bytes[text_chars], side="right")
        text_tokens[0] = 0
        return Encoded(ids, text_tokens, pre[:-1], text_chars, codes, char_bytes)

    def _segments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in order, and the byte at which each token ends."""
        if not len(start):
            return _EMPTY32, np.zeros(0, dtype=np.int64)
        ids = self.whole(data, start, end, _segment_hashes(data, start, end))
        missed = ids < 0
        if missed.any():
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[start] = True
            inside = _ranges(start[missed] + 1, end[missed] - start[missed] - 1)
            cut[inside] = ~self.v.joins[data[inside - 1], data[inside]]
            start = np.flatnonzero(cut[:-1])
            end = np.concatenate([start[1:], [len(data)]])
            hashes = _segment_hashes(data, start, end)
            ids = self.whole(data, start, end, hashes)
        count = np.ones(len(ids), dtype=np.int64)
        left = np.flatnonzero(ids < 0)
        flat = _EMPTY32
        if len(left):
            values, inverse = self._distinct(data, start[left], end[left])
            merged = [self._merged(p) for p in values]
            sizes = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
            flat = np.concatenate(merged)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            count[left] = sizes[inverse]
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(int(at[-1]), dtype=np.int32)
        hit = ids >= 0
        out[at[:-1][hit]] = ids[hit]
        if len(left):
            out[_ranges(at[left], count[left])] = flat[_ranges(first[inverse], sizes[inverse])]
        return out, np.cumsum(self.v.length[out])

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct segments, and for each segment the number of its value; exact."""
        size = end - start
        if int(size.max()) <= 7:  # byte values and length fit in 64 bits: exact
            key = size.astype(np.uint64) << np.uint64(56)
            for k in range(int(size.max())):
                more = size > k
                key[more] |= data[start[more] + k].astype(np.uint64) << np.uint64(8 * k)
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            raw = data.tobytes()
            return [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], inverse
        short = size <= 7
        raw = data.tobytes()
        inverse = np.empty(len(start), dtype=np.int64)
        values: list[bytes] = []
        if short.any():
            values, inverse[short] = self._distinct(data, start[short], end[short])
        number: dict[bytes, int] = {}
        for i in np.flatnonzero(~short).tolist():
            inverse[i] = len(values) + number.setdefault(raw[start[i] : end[i]], len(number))
        return values + list(number), inverse

    def _merged(self, part: bytes) -> np.ndarray:
        got = self.memo.get(part)
        if got is None:
            got = np.array(merge_bytes(part, self.rank), dtype=np.int32)
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            if len(part) <= 64:
                self.memo[part] = got
        return got


_CURRENT: list = []


def worker_encoder(tables: Broadcast) -> Encoder:
    """The encoder of this Python worker for a broadcast vocabulary; it keeps its memo between tasks."""
    if not _CURRENT or _CURRENT[0] is not tables:
        _CURRENT[:] = [tables, Encoder(tables.value)]
    return _CURRENT[1]


def broadcast_vocabulary(spark: SparkSession, folder: str = TOKENIZER_DIR, file: str = RANKS_FILE) -> Broadcast:
    """Vocabulary tables for the workers: about 2 MB for 50,256 tokens, independent of the corpus."""
    ship(spark)
    return spark.sparkContext.broadcast(Vocabulary.load(folder, file))


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit code points; a longer text is a block of its own."""
    first = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > limit:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, file: str = RANKS_FILE) -> DataFrame:
    """Token ids of every row's text, without special tokens: columns key and ``ids`` ARRAY<INT>.

    Null and empty texts give an empty list; a null key is kept; repeated rows come out repeatedly; an
    empty table gives no rows. Strings of special tokens inside a text are ordinary text. No shuffle.
    """
    tables = broadcast_vocabulary(docs.sparkSession, folder, file)
    source = docs.select(docs[key], docs[text].alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tables)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                e = encoder.block(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(e.text_tokens, type=pa.int32()), pa.array(e.ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
