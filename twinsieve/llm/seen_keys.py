"""Problem 1: has this key been seen before?

Filter then verify. The known keys lie in a bucketed table, with a Bloom filter beside it into which every
append is merged. A RepeatFilter of the batch over that filter tells at once which keys cannot have been
seen: they stand in no earlier request and not twice in the batch. Only the others are shuffled, to the
buckets of the full keys on disk and to the earliest request of the batch that holds them, and each
first sighting among them is a positive that the exact stage disproves: it is logged as a measured
error, with the kind recurs (a later request of the batch holds the key) or collision (none does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinsieve.llm.filters import Layout, RepeatFilter, flag_by_filter, key64, merge_segments
from twinsieve.operators.bucketed import BucketedTable
from twinsieve.session import folders, new_path, ship, written

HASH_FIELDS = ("raw_hash", "content_hash")
FIELDS = ("id", *HASH_FIELDS)
KINDS = ("recurs", "collision")


def key_bytes(field: Column, value: Column) -> Column:
    """The key of a value: 16 bytes of a hash of 32 hex digits, the bytes of an id; null if it is no key.

    Blanks and tabs around a hash and the case of its letters do not matter; ids count exactly.
    """
    bare = F.regexp_replace(value, "^[ \\t]+|[ \\t]+$", "")
    is_hash = field.isin(*HASH_FIELDS)
    return F.when(is_hash & bare.rlike("^[0-9a-fA-F]{32}\\z"), F.unhex(bare)).when(~is_hash, F.encode(value, "UTF-8"))


def request_keys(requests: DataFrame, order: str = "request_no") -> DataFrame:
    """One row per request and field with a key: order, key_field, key."""
    # A literal per field keeps the three cases in one projection, without an Expand of all columns.
    each = F.array(*[F.struct(F.lit(f).alias("key_field"), key_bytes(F.lit(f), F.col(f)).alias("key")) for f in FIELDS])
    out = requests.select(F.col(order), F.explode(each).alias("_k"))
    return out.select(order, "_k.key_field", "_k.key").filter(F.col("key").isNotNull() & F.col(order).isNotNull())


def _kind(order: str) -> Column:
    """Why the filter let a first sighting through, by its latest request."""
    return F.when(F.col("_last") > F.col(order), F.lit(KINDS[0])).otherwise(F.lit(KINDS[1])).alias("kind")


class SeenKeyStore:
    """Known keys on disk: a bucketed table of key_field, key (distinct), their filter, and the log of disproved keys.

    With the path of an earlier store it goes on from there; without one it is temporary. One writer at a time;
    keys whose append failed are appended again with the batch.
    """

    LOG = "key_field string, key binary, request long, kind string, batch int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        ship(spark)
        self.spark, self.path = spark, (path or new_path(spark, "seen-keys")).rstrip("/")
        self.table = BucketedTable(spark, f"{self.path}/keys", "key_field STRING, key BINARY", ["key_field", "key"])
        self._layout: Layout | None = None
        found = folders(spark, f"{self.path}/filters", "filter-")
        self._version = int(found[-1].rpartition("-")[2]) + 1 if found else 0
        if found:
            row = spark.read.parquet(found[-1]).first()
            self._layout = Layout(row["bits"], row["slices"], row["capacity"])

    def keys(self) -> DataFrame:
        return self.table.read()

    # -- the stored filter ----------------------------------------------------------------------

    def _stored(self, number: int) -> DataFrame:
        """The segments of one slice of the filter of the known keys."""
        rows = self.spark.read.parquet(f"{self.path}/filters/filter-{self._version - 1:06d}")
        return rows.filter((F.col("slice") == number) & F.col("bytes").isNotNull()).select("segment", "bytes")

    def _save(self, layout: Layout, added: DataFrame | None) -> None:
        """Writes the filter in a layout: all known keys where it is a new one, else the stored one with what is added."""
        old = self._layout
        rows = self.spark.createDataFrame([(-1, 0, None)], "slice int, segment int, bytes binary")  # keeps the layout of an empty filter
        for number in range(layout.slices):
            if layout == old:
                parts = self._stored(number).unionByName(RepeatFilter.parts(added, "h", layout, number))
            else:
                known = self.keys().select(key64("key_field", "key").alias("h"))
                parts = RepeatFilter.parts(known if added is None else known.unionByName(added.select("h")), "h", layout, number)
            rows = rows.unionByName(merge_segments(parts, layout).select(F.lit(number).alias("slice"), "segment", "bytes"))
        for name, value in (("bits", layout.bits), ("slices", layout.slices), ("capacity", layout.capacity)):
            rows = rows.withColumn(name, F.lit(value).cast("long" if name == "capacity" else "int"))
        rows.write.parquet(f"{self.path}/filters/filter-{self._version:06d}")
        self._version += 1
        self._layout = layout

    def _fit(self, more: int, added: DataFrame | None = None) -> Layout:
        """The layout for the known keys and so many more, with the hashes of added keys merged into the filter.

        Beyond its capacity the filter is made anew, for twice as many if there was one.
        """
        wanted, layout = self.table.rows + more, self._layout
        if layout is None or wanted > layout.capacity:
            layout = Layout.of(wanted if layout is None else 2 * wanted)
        if layout != self._layout or added is not None:
            self._save(layout, added)
        return layout

    # -- batches --------------------------------------------------------------------------------

    def _judged(self, keys: DataFrame) -> DataFrame:
        """The batch's keys with ``maybe``: false is a proof that the key was not seen before.

        The filter is sized for store and batch together. Each slice of it is broadcast, judges the keys of
        the slice, and goes; there is one slice up to 2^MAX_BITS / PER_KEY keys.
        """
        hashed = keys.drop("h", "maybe").withColumn("h", key64("key_field", "key"))
        layout = self._fit(keys.count())
        out = None
        for number in range(layout.slices):
            both = self._stored(number).unionByName(RepeatFilter.parts(hashed, "h", layout, number))
            shared = self.spark.sparkContext.broadcast(RepeatFilter.load(both, layout))
            part = flag_by_filter(hashed.filter(layout.in_slice(F.col("h"), number)), "h", shared, twice=True).drop("h")
            if layout.slices > 1:
                part = written(part, "judged-slice")
                shared.destroy()
            out = part if out is None else out.unionByName(part)
        return out

    def _firsts(self, maybe: DataFrame, order: str) -> DataFrame:
        """Each possible key that is not on disk once, with its earliest and latest request.

        Partial minima leave one row per key and map task, so a key of a third of all rows is no burden.
        Those rows go to the buckets of the table, which itself is not shuffled.
        """
        per_key = maybe.groupBy("key_field", "key").agg(F.min(order).alias(order), F.max(order).alias("_last"))
        if self.table.rows == 0:
            return per_key
        return self.table.placed(per_key).join(self.keys(), ["key_field", "key"], "left_anti")

    def _sightings(self, keys: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(judged keys, first sightings that passed the filter, marks); the first sightings go to the log."""
        judged = self._judged(keys)
        maybe = judged.filter("maybe").drop("maybe")
        number = len(folders(self.spark, f"{self.path}/log", "batch-"))
        log = self._firsts(maybe, order).select("key_field", "key", F.col(order).cast("long").alias("request"), _kind(order), F.lit(number).alias("batch"))
        log.write.option("compression", "zstd").parquet(f"{self.path}/log/batch-{number:06d}")
        first = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log/batch-{number:06d}").select("key_field", "key", F.col("request").alias(order))
        # A request has one key per field, so a first sighting is named by (order, field): it is taken away
        # by an anti join on those, which no hot key can skew.
        marks = maybe.select(order, "key_field").distinct().join(first.select(order, "key_field"), [order, "key_field"], "left_anti")
        return judged, first, marks

    def found(self, keys: DataFrame, order: str = "request_no") -> DataFrame:
        """(order, key_field) of each key that is on disk or in a request with a smaller order; nothing is stored.

        Redelivered requests count once, and are never their own predecessors. Every first sighting that
        passed the filter is logged; errors() gives them.
        """
        return self._sightings(keys, order)[2]

    def check(self, keys: DataFrame, order: str = "request_no") -> DataFrame:
        """found(), and then the keys of the batch are known. Returns a written table.

        New are the keys that the filter rules out, each of which stands in one row only, and the first
        sightings; so they are distinct and not on disk without another look.
        """
        judged, first, marks = self._sightings(keys, order)
        out = written(marks, "seen-keys")
        fresh = judged.filter(~F.col("maybe")).select("key_field", "key").unionByName(first.select("key_field", "key"))
        self._add(written(fresh, "new-keys"))
        return out

    def append(self, keys: DataFrame) -> None:
        """Adds the keys (columns key_field, key) that are not yet there."""
        fresh = keys.select("key_field", "key").filter(F.col("key").isNotNull()).distinct()
        if self.table.rows:
            fresh = self.table.placed(fresh).join(self.keys(), ["key_field", "key"], "left_anti")
        self._add(written(fresh, "new-keys"))

    def _add(self, fresh: DataFrame) -> None:
        """The filter gets the keys first: a key in the filter that is not on disk costs a lookup, the reverse a wrong mark."""
        count = fresh.count()
        if count:
            self._fit(count, fresh.select(key64("key_field", "key").alias("h")))
        self.table.append(fresh, count)

    def errors(self) -> DataFrame:
        """The log: key_field, key, request, kind and batch of every first sighting that the filter let through."""
        parts = folders(self.spark, f"{self.path}/log", "batch-")
        return self.spark.read.schema(self.LOG).parquet(*parts) if parts else self.spark.createDataFrame([], self.LOG)

    def close(self) -> None:
        """Takes the table out of the session's catalog; the store can be opened again from its path."""
        self.table.drop()

    def mark(self, requests: DataFrame, order: str = "request_no") -> DataFrame:
        """check() as one row per request: seen_id, seen_raw_hash and seen_content_hash; false where there is no key."""
        found = self.check(request_keys(requests, order), order)
        wide = found.groupBy(order).agg(*[F.bool_or(F.col("key_field") == f).alias(f"seen_{f}") for f in FIELDS])
        out = requests.select(order).filter(F.col(order).isNotNull()).distinct().join(wide, order, "left")
        return out.select(order, *[F.coalesce(f"seen_{f}", F.lit(False)).alias(f"seen_{f}") for f in FIELDS])

    def error_report(self, keys: DataFrame, order: str = "request_no") -> DataFrame:
        """Per field: keys probed, keys the filter ruled out, keys shuffled, keys disproved by kind, and rates.

        A disproved key passed the filter, but is not on disk and in no earlier request; that is the
        filter's measured error. wrong_mark_rate is the share of (request, field) whose mark differs from
        the one found without the filter, by shuffling all keys.
        """
        judged = written(self._judged(keys), "judged")
        probes = judged.groupBy("key_field").agg(F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("maybe")).alias("ruled_out"))
        firsts = written(self._firsts(judged.filter("maybe"), order).select(order, "key_field", _kind(order)), "first-sightings")
        kinds = [F.count_if(F.col("kind") == k).alias(f"disproved_{k}") for k in KINDS]
        wrong = firsts.groupBy("key_field").agg(F.count(F.lit(1)).alias("disproved"), *kinds)
        new = self._firsts(judged, order).select(order, "key_field", F.lit(True).alias("_new"))
        marks = judged.groupBy(order, "key_field").agg(F.bool_or("maybe").alias("_maybe"))
        marks = marks.join(firsts.select(order, "key_field", F.lit(True).alias("_first")), [order, "key_field"], "left").join(new, [order, "key_field"], "left")
        marked = F.col("_maybe") & F.col("_first").isNull()
        compared = marks.groupBy("key_field").agg(F.avg((marked != F.col("_new").isNull()).cast("int")).alias("wrong_mark_rate"))
        out = probes.join(wrong, "key_field", "left").join(compared, "key_field", "left")
        counts = ["disproved", *[f"disproved_{k}" for k in KINDS]]
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
        return out.select("key_field", "probes", "ruled_out", (F.col("probes") - F.col("ruled_out")).alias("verified"), *counts,
                          (F.col("disproved") / F.col("probes")).alias("filter_error_rate"), "wrong_mark_rate")


def seeded_store(spark: SparkSession, seeded: DataFrame) -> SeenKeyStore:
    """A store with the keys known beforehand: columns key_field, key_value; other fields are no keys."""
    store = SeenKeyStore(spark)
    known = seeded.filter(F.col("key_field").isin(*FIELDS))
    store.append(known.select("key_field", key_bytes(F.col("key_field"), F.col("key_value")).alias("key")))
    return store
