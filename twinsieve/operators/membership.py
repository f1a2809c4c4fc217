"""Approximate membership of stored documents, kept as tables beside a generation.

A filter is a Bloom filter cut into parts of bounded size, one row each, and has layers: what is added
later goes into a layer of its own, so a filter keeps its error rate however much is added. There are four
exact filters (external, raw, content, title) and one per scope, day and MinHash band. Answers have
three values: true (may be stored), false (is not stored), null (a filter is missing, so ask the store).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinsieve.functions import scalars
from twinsieve.params import EXACT_FPP, MINHASH_FPP
from twinsieve.session import ship

FILTERS = "filter string, layer int, parts int, part int, hashes int, bytes binary"
PART_KEYS = 1 << 20
KEYS = {"external": "external_id", "raw": "raw_hash", "content": "exact_hash", "title": "title_hash"}


def exact_keys(docs: DataFrame, *carry: str) -> DataFrame:
    """B1: filter, h of the ids and hashes of documents (external_id, raw_hash, exact_hash, title_hash); nulls are no keys."""
    each = F.array(*[F.struct(F.lit(name).alias("filter"), F.xxhash64(F.lit(name), F.col(c)).alias("h"), F.col(c).isNotNull().alias("_there")) for name, c in KEYS.items()])
    return docs.select(*carry, F.explode(each).alias("_k")).filter("_k._there").select(*carry, "_k.filter", "_k.h")


def _band_filter(day: Column) -> Column:
    return F.concat_ws(":", "scope", day, "band_index")


def band_keys(bands: DataFrame, timezone: str = "Asia/Shanghai") -> DataFrame:
    """Filter (scope, day and band), h of stored MinHash band rows; rows without a creation time are no keys."""
    rows = bands.filter((F.col("kind") == "minhash") & F.col("created_at").isNotNull())
    return rows.select(_band_filter(scalars.day_bucket(F.col("created_at"), timezone)).alias("filter"), F.xxhash64("band_value").alias("h"))


def band_names(days: DataFrame) -> DataFrame:
    """Names of all band filters of some days (column day), for reserving them."""
    scopes = F.explode(F.array(F.lit("content"), F.lit("title"))).alias("scope")
    return days.select("day", scopes).select("day", "scope", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("band_index")).select(_band_filter(F.col("day")).alias("filter"))


def _places(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of 64-bit keys in a filter part, shape (hashes, keys)."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = ((x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return np.stack([((x + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(bits) for i in range(hashes)]).astype(np.int64)


def build(keys: DataFrame, error: float, layer: int = 0, reserve: DataFrame | None = None) -> DataFrame:
    """Filters of the keys (filter, h) as rows of FILTERS. ``reserve`` (column filter): filters that exist without keys.

    Keys are made distinct with partial sums first, so a value of many documents is one key, and each part is made
    by one task from about PART_KEYS keys. The numbers of filters, which are joined by broadcast, are
    bounded by the days kept (64 a day) or four.
    """
    ship(keys.sparkSession)
    hashes = scalars.bloom_hashes(error)
    own = keys.filter("filter is not null and h is not null").distinct()
    sizes = own.groupBy("filter").agg(F.count(F.lit(1)).alias("_n")).withColumn("parts", F.ceil(F.col("_n") / PART_KEYS).cast("int"))
    placed = own.join(F.broadcast(sizes.select("filter", "parts")), "filter").withColumn("part", F.pmod("h", "parts").cast("int"))
    per_key = scalars.bloom_bits_per_key(error)

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        bits = 8 * max(8, math.ceil(len(h) * per_key / 8))
        marks = np.zeros(bits, dtype=bool)
        marks[_places(h, bits, hashes).ravel()] = True
        first = lambda c: table.column(c)[0].as_py()
        return pa.table({"filter": [first("filter")], "layer": pa.array([layer], pa.int32()), "parts": pa.array([first("parts")], pa.int32()), "part": pa.array([first("part")], pa.int32()),
                         "hashes": pa.array([hashes], pa.int32()), "bytes": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = placed.groupBy("filter", "part").applyInArrow(run, FILTERS)
    if reserve is not None:
        empty = reserve.select("filter").distinct().join(sizes.select("filter"), "filter", "left_anti")
        out = out.unionByName(empty.select("filter", F.lit(layer).alias("layer"), F.lit(1).alias("parts"), F.lit(0).alias("part"), F.lit(hashes).alias("hashes"), F.lit(None).cast("binary").alias("bytes")))
    return out


def exact_filters(store: DataFrame, layer: int = 0) -> DataFrame:
    """The four exact filters of stored documents; all four exist even where nothing has such a key."""
    names = store.sparkSession.createDataFrame([(n,) for n in KEYS], "filter string")
    return build(exact_keys(store), EXACT_FPP, layer, names)


def band_filters(bands: DataFrame, layer: int = 0, reserve: DataFrame | None = None, timezone: str = "Asia/Shanghai") -> DataFrame:
    """The filters of all days on which band rows were created, and of the days (column day) to reserve."""
    return build(band_keys(bands, timezone), MINHASH_FPP, layer, None if reserve is None else band_names(reserve))


def probe(asks: DataFrame, filters: DataFrame) -> DataFrame:
    """asks (any columns, filter, h) with ``maybe``: true, false, or null where there is no such filter.

    Distinct keys meet the parts of their filter, each part in one task; nothing is broadcast but the names of
    the filters and layers.
    """
    ship(asks.sparkSession)
    layers = filters.select("filter", "layer", "parts").distinct()
    wanted = asks.select("filter", "h").distinct().join(F.broadcast(layers), "filter").withColumn("part", F.pmod("h", "parts").cast("int"))

    def run(keys: pa.Table, parts: pa.Table) -> pa.Table:
        if not keys.num_rows or not parts.num_rows or parts.column("bytes")[0].as_py() is None:
            return pa.table({"filter": pa.array([], pa.string()), "h": pa.array([], pa.int64())})
        marks = np.frombuffer(parts.column("bytes")[0].as_py(), dtype=np.uint8)
        h = keys.column("h").to_numpy()
        at = _places(h, 8 * len(marks), parts.column("hashes")[0].as_py())
        hit = (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool).all(axis=0)
        return keys.select(["filter", "h"]).filter(pa.array(hit))

    by = ["filter", "layer", "part"]
    pieces = filters.toDF(*filters.columns)  # columns of their own: wanted has some of filters
    hits = wanted.groupBy(*by).cogroup(pieces.groupBy(*by)).applyInArrow(run, "filter string, h long").distinct().withColumn("_hit", F.lit(True))
    known = F.broadcast(layers.select("filter").distinct().withColumn("_known", F.lit(True)))
    out = asks.join(known, "filter", "left").join(hits, ["filter", "h"], "left")
    return out.withColumn("maybe", F.when(F.col("_known"), F.coalesce("_hit", F.lit(False)))).drop("_known", "_hit")


def exact_maybe(probes: DataFrame, filters: DataFrame, key: str = "probe") -> DataFrame:
    """B2: key, exact_maybe of probes (key, external_id, raw_hash, exact_hash, title_hash).

    Null if a filter that the probe asks for is missing, else whether any of its keys may be stored.
    """
    judged = probe(exact_keys(probes, key), filters).groupBy(key).agg(F.bool_or(F.col("maybe").isNull()).alias("_open"), F.bool_or("maybe").alias("_any"))
    return judged.select(key, F.when(~F.col("_open"), F.col("_any")).alias("exact_maybe"))


def band_maybe(probe_bands: DataFrame, filters: DataFrame, as_of: Column, days: int, scope: str = "content", key: str = "probe", timezone: str = "Asia/Shanghai") -> DataFrame:
    """Key, band_index, band_value, band_maybe of the MinHash bands of probes, over the days that end with as_of.

    True if the filter of any of the days may hold the band; null for all bands of a probe if one of the
    filters it needs is missing.
    """
    own = probe_bands.filter(F.col("kind") == "minhash").select(key, "band_index", "band_value", F.lit(scope).alias("scope"))
    own = own.withColumn("_day", F.explode(scalars.query_buckets(as_of, days, timezone)))
    asks = own.select(key, "band_index", "band_value", _band_filter(F.col("_day")).alias("filter"), F.xxhash64("band_value").alias("h"))
    judged = probe(asks, filters).groupBy(key, "band_index", "band_value").agg(F.bool_or(F.col("maybe").isNull()).alias("_open"), F.bool_or("maybe").alias("_any"))
    missing = judged.groupBy(key).agg(F.bool_or("_open").alias("_missing"))
    return judged.join(missing, key).select(key, "band_index", "band_value", F.when(~F.col("_missing"), F.col("_any")).alias("band_maybe"))


def without_absent_bands(probe_bands: DataFrame, judged: DataFrame, key: str = "probe") -> DataFrame:
    """Probe bands without the MinHash bands that band_maybe() rules out; those it knows nothing about stay."""
    absent = judged.filter(~F.col("band_maybe")).select(key, F.lit("minhash").alias("kind"), "band_index", "band_value")
    return probe_bands.join(absent, [key, "kind", "band_index", "band_value"], "left_anti")
