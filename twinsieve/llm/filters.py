"""Filters of bounded size that partitions build on their own and that merge into one.

RepeatFilter keeps two bitmaps, of positions that one key set and of positions that more than one
set: the Bloom filters of once- and of repeatedly-seen keys. FrequencySketch keeps 8-bit counters.
Both are cut into segments; a map task sends only the segments it touched, compressed, and each
segment is merged by one task in a stream, so no task and no driver ever holds the partial filters
of all tasks. A bitmap has at most 2^MAX_BITS positions; more keys than that serves are cut by their hash into
slices, each with bitmaps of its own that are gone through one after the other, so the share of keys that
pass by chance stays the same at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from twinsieve.session import ship

MAX_BITS = 28
MIN_BITS = 14
SEGMENTS = 64
HASHES = 4
PER_KEY = 10


@dataclass(frozen=True)
class Layout:
    """Slices of 2^bits positions each, for about ``capacity`` keys: at least PER_KEY positions a key."""

    bits: int
    slices: int
    capacity: int

    @staticmethod
    def of(keys: int, max_bits: int = MAX_BITS) -> "Layout":
        wanted = max(keys, 1) * PER_KEY
        bits = min(max_bits, max(MIN_BITS, (wanted - 1).bit_length()))
        slices = 1 << max(0, ((wanted + (1 << bits) - 1 >> bits) - 1).bit_length())
        return Layout(bits, slices, (slices << bits) // PER_KEY)

    @property
    def segments(self) -> int:
        return min(SEGMENTS, 1 << max(0, self.bits - 13))

    @property
    def span(self) -> int:
        """Positions of a segment."""
        return (1 << self.bits) // self.segments

    def in_slice(self, h: Column, number: int) -> Column:
        return h.bitwiseAND(F.lit(self.slices - 1).cast("long")) == number


def positions(keys: np.ndarray, bits: int, k: int = HASHES) -> np.ndarray:
    """k positions of each 64-bit key, shape (k, n)."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = (h * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    shift = np.uint64(64 - bits)
    return np.stack([((h + np.uint64(i) * step) >> shift).astype(np.int64) for i in range(k)])


def _mark(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Enters positions into both bitmaps."""
    at, n = np.unique(at, return_counts=True)
    if not len(at):
        return
    byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
    starts = np.flatnonzero(np.diff(byte, prepend=-1))
    cells, new = byte[starts], np.bitwise_or.reduceat(bit, starts)
    again = np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint8(0)), starts)
    twice[cells] |= again | (once[cells] & new)
    once[cells] |= new


PARTS = "segment int, bytes binary"


def merge_segments(parts: DataFrame, layout: Layout) -> DataFrame:
    """One row per segment of the rows of PARTS (compressed bitmaps of the same layout), merged in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        half = layout.span // 8
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
                old = state.get(i)
                if old is None:
                    state[i] = new.copy()
                else:
                    old[half:] |= new[half:] | (old[:half] & new[:half])
                    old[:half] |= new[:half]
        for i, v in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(v, 1)], pa.binary())], names=["segment", "bytes"])

    return parts.repartition(min(layout.segments, 16), "segment").mapInArrow(run, PARTS)


class RepeatFilter:
    """Which keys may have been seen, and which may have been seen at least twice. No false negatives."""

    def __init__(self, once: np.ndarray, twice: np.ndarray, layout: Layout):
        self.once, self.twice, self.layout = once, twice, layout

    def _all(self, bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in positions(keys, self.layout.bits):
            out &= (bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def maybe_repeated(self, keys: np.ndarray) -> np.ndarray:
        return self._all(self.twice, keys)

    def maybe_seen(self, keys: np.ndarray) -> np.ndarray:
        return self._all(self.once, keys)

    def merged(self, other: "RepeatFilter") -> "RepeatFilter":
        return RepeatFilter(self.once | other.once, self.twice | other.twice | (self.once & other.once), self.layout)

    @staticmethod
    def parts(keys: DataFrame, column: str, layout: Layout, number: int = 0) -> DataFrame:
        """The bitmaps of one slice of all non-null 64-bit keys of a column as rows of PARTS, every row of keys counting as one sighting."""
        ship(keys.sparkSession)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            once, twice = (np.zeros((1 << layout.bits) // 8, dtype=np.uint8) for _ in range(2))
            for batch in batches:
                for p in positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), layout.bits):
                    _mark(once, twice, p)
            size = layout.span // 8
            for i in range(layout.segments):
                seen = once[i * size : (i + 1) * size]
                if seen.any():
                    packed = zlib.compress(np.concatenate([seen, twice[i * size : (i + 1) * size]]), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "bytes"])

        h = F.col(column).cast("long")
        return keys.select(h.alias("h")).filter(F.col("h").isNotNull() & layout.in_slice(F.col("h"), number)).mapInArrow(local, PARTS)

    @staticmethod
    def load(parts: DataFrame, layout: Layout) -> "RepeatFilter":
        """The filter of one slice, brought to the driver segment by segment; at most 2^(MAX_BITS - 2) bytes."""
        size = layout.span // 8
        once, twice = (np.zeros((1 << layout.bits) // 8, dtype=np.uint8) for _ in range(2))
        for row in merge_segments(parts, layout).toLocalIterator():
            v, at = np.frombuffer(zlib.decompress(row["bytes"]), dtype=np.uint8), row["segment"] * size
            once[at : at + size] = v[:size]
            twice[at : at + size] = v[size:]
        return RepeatFilter(once, twice, layout)

    @staticmethod
    def build(keys: DataFrame, column: str, layout: Layout, number: int = 0) -> "RepeatFilter":
        return RepeatFilter.load(RepeatFilter.parts(keys, column, layout, number), layout)


def flag_by_filter(rows: DataFrame, column: str, filters: Broadcast, twice: bool, alias: str = "maybe") -> DataFrame:
    """Adds a boolean: the 64-bit key may be in the filter. Null keys give false."""

    def judge(h: pd.Series) -> pd.Series:
        f: RepeatFilter = filters.value
        keys = h.to_numpy(dtype=np.int64).view(np.uint64)
        return pd.Series(f.maybe_repeated(keys) if twice else f.maybe_seen(keys))

    # Nulls would reach pandas as floats, which cannot hold 64 bits.
    known = F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn(alias, F.pandas_udf(judge, "boolean")(known) & F.col(column).isNotNull())


class FrequencySketch:
    """Upper bounds of the number of rows that hold a key, in 2^bits 8-bit counters.

    Up to 127 a counter is the exact sum of its keys' rows, above that it grows in quarters of an octave,
    which reach beyond 10^11. A count of 1 is a proof that one row only holds the key.
    """

    LINEAR = 128

    def __init__(self, counts: np.ndarray, bits: int):
        self.counts, self.bits = counts, bits

    def __reduce__(self):
        """Goes to the workers compressed: most counters are small."""
        return FrequencySketch._unpickled, (zlib.compress(self.counts.tobytes(), 1), self.bits)

    @staticmethod
    def _unpickled(raw: bytes, bits: int) -> "FrequencySketch":
        return FrequencySketch(np.frombuffer(zlib.decompress(raw), dtype=np.uint8), bits)

    @staticmethod
    def _packed(v: np.ndarray) -> np.ndarray:
        """Counts as bytes: from LINEAR by their logarithm in steps of 1/4 octave, rounded up."""
        big = FrequencySketch.LINEAR + np.ceil(4 * np.log2(np.maximum(v, FrequencySketch.LINEAR) / FrequencySketch.LINEAR)).astype(np.int64)
        return np.where(v < FrequencySketch.LINEAR, v, np.minimum(big, 255)).astype(np.uint8)

    def may_exceed(self, count: int) -> int:
        """The least byte of keys that more than ``count`` rows may hold."""
        return int(self._packed(np.array([count + 1]))[0])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The bytes of the counters: they order keys as the counts do."""
        return self.counts[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]

    @staticmethod
    def build(rows: DataFrame, keys_of, bits: int) -> "FrequencySketch":
        """keys_of: list of the first column's values -> one uint64 array of the keys of all of them."""
        ship(rows.sparkSession)
        segments = min(SEGMENTS, 1 << max(0, bits - 12))
        span = (1 << bits) // segments

        def send(state: dict[int, np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
            for i, v in state.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(v.astype(kind), 1)], pa.binary())], names=["segment", "bytes"])

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << bits, dtype=np.uint32)
            for batch in batches:
                at, n = np.unique((keys_of(batch.column(0).to_pylist()) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] += n.astype(np.uint32)
            parts = {i: counts[i * span : (i + 1) * span] for i in range(segments)}
            for i, v in parts.items():
                if v.any():
                    # Most counters of a task are small; they go as bytes, the few others as pairs behind them.
                    high = np.flatnonzero(v > 254)
                    small = np.minimum(v, 255).astype("<u1").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(small + high.astype("<u4").tobytes() + v[high].astype("<u4").tobytes(), 1)], pa.binary())], names=["segment", "bytes"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = zlib.decompress(raw)
                    total = state.setdefault(i, np.zeros(span, dtype=np.int64))
                    small, more = np.frombuffer(raw[:span], dtype="<u1"), np.frombuffer(raw[span:], dtype="<u4")
                    total += np.where(small == 255, 0, small)
                    at, n = more[: len(more) // 2], more[len(more) // 2 :]
                    total[at] += n
            yield from send({i: FrequencySketch._packed(v) for i, v in state.items()}, "<u1")

        out = np.zeros(1 << bits, dtype=np.uint8)
        merged = rows.mapInArrow(local, PARTS).repartition(min(segments, 16), "segment").mapInArrow(merge, PARTS)
        for row in merged.toLocalIterator():
            out[row["segment"] * span : (row["segment"] + 1) * span] = np.frombuffer(zlib.decompress(row["bytes"]), dtype="<u1")
        return FrequencySketch(out, bits)


def key64(*columns: Column) -> Column:
    """64-bit key of some columns for a filter."""
    return F.xxhash64(*columns)
