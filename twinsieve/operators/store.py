"""Batch sink, deletion, retention and band upkeep (S10 to S15, J5 to J8, A6, B15), and keyed reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinsieve.functions import scalars
from twinsieve.operators.fingerprint import band_rows
from twinsieve.operators.greedy import first_wins
from twinsieve.session import written

UNIQUE = ("external_id", "exact_hash")


def first_by_keys(rows: DataFrame, rank: str, keys: Sequence[str] = UNIQUE) -> DataFrame:
    """The rows that an insert in order of rank, skipping every conflict on one of the keys, would store.

    Ranks are distinct; a null key conflicts with nothing.
    """
    tagged = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys])
    values = rows.select(F.col(rank).alias("id"), F.explode(tagged).alias("value"))
    none = rows.select(F.col(rank).alias("a"), F.col(rank).alias("b")).limit(0)
    kept = first_wins(rows.select(F.col(rank).alias("id"), F.col(rank).alias("rank")), none, values, values)
    return rows.join(kept.select(F.col("id").alias(rank)), rank, "left_semi")


def ingest(batch: DataFrame, store: DataFrame, order: str = "doc_pk") -> tuple[DataFrame, DataFrame]:
    """(inserted, resolved). inserted: the new rows of the batch, in their own columns.

    batch and store have external_id and exact_hash. A row is new if neither is stored and it is the
    first of the batch in order of ``order`` with both. resolved: order, doc_pk, inserted: the document
    that stands for each row: itself, else the one of its external_id, else the one of its exact_hash.
    A null external_id or exact_hash conflicts with nothing.
    """
    fresh = batch.join(store.select("external_id").filter("external_id is not null"), "external_id", "left_anti")
    fresh = fresh.join(store.select("exact_hash").filter("exact_hash is not null"), "exact_hash", "left_anti")
    inserted = written(first_by_keys(fresh, order).select(batch.columns), "inserted")
    all_rows = store.select("doc_pk", *UNIQUE).unionByName(inserted.select(F.col(order).alias("doc_pk"), *UNIQUE))
    by = lambda k: all_rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("doc_pk").alias(f"_{k}"))
    out = batch.select(order, *UNIQUE).join(inserted.select(order).withColumn("_new", F.lit(True)), order, "left")
    out = out.join(by("external_id"), "external_id", "left").join(by("exact_hash"), "exact_hash", "left")
    new = F.coalesce("_new", F.lit(False))
    return inserted, out.select(order, F.when(new, F.col(order)).otherwise(F.coalesce("_external_id", "_exact_hash")).alias("doc_pk" if order != "doc_pk" else "resolved_pk"), new.alias("inserted"))


def bulk_bands(prints: DataFrame, key: str = "doc_pk", created: str | None = None) -> DataFrame:
    """Band rows of both scopes, repeated rows once, sorted within partitions by bucket."""
    carry = (created,) if created else ()
    both = None
    for scope in ("content", "title"):
        rows = band_rows(prints, key, scope, carry).withColumn("scope", F.lit(scope))
        both = rows if both is None else both.unionByName(rows)
    keys = ["scope", "kind", "band_index", "band_value", key]
    return both.dropDuplicates(keys).select(*keys, *carry).sortWithinPartitions(*keys)


def save_bands(bands: DataFrame, path: str, mode: str = "append") -> None:
    """Band rows in leaves by scope, kind and band, each sorted by value and document.

    A search of one scope and kind reads its leaves only, and row groups of other values are skipped.
    """
    leaf = ["scope", "kind", "band_index"]
    bands.repartition(*leaf, F.pmod("band_value", F.lit(16))).sortWithinPartitions(*leaf, "band_value", "doc_pk").write.partitionBy(*leaf).option("compression", "zstd").mode(mode).parquet(path)


def missing_bands(prints: DataFrame, bands: DataFrame) -> DataFrame:
    """Band rows of known documents that are not stored yet."""
    return bulk_bands(prints).join(bands, ["scope", "kind", "band_index", "band_value", "doc_pk"], "left_anti")


def without_documents(rows: DataFrame, victims: DataFrame) -> DataFrame:
    """Rows whose doc_pk is not among the victims."""
    return rows.join(victims.select("doc_pk").distinct(), "doc_pk", "left_anti")


def expired(store: DataFrame, as_of: Column, days: int, batch: int = 1000, max_batches: int = 10) -> DataFrame:
    """doc_pk of the oldest documents created before as_of minus days, at most batch * max_batches.

    Oldest first, ties by doc_pk. days <= 0 expires nothing, as does a null creation time.
    """
    if days <= 0:
        return store.select("doc_pk").limit(0)
    old = store.filter(F.col("created_at") < as_of - F.expr(f"interval {int(days)} days"))
    return old.orderBy("created_at", "doc_pk").limit(batch * max_batches).select("doc_pk")


def backfill_created_at(bands: DataFrame, store: DataFrame) -> DataFrame:
    """Band rows with the creation time of their document where they have none."""
    times = store.select("doc_pk", F.col("created_at").alias("_created"))
    return bands.join(times, "doc_pk", "left").withColumn("created_at", F.coalesce("created_at", "_created")).drop("_created").select(bands.columns)


def band_counts(bands: DataFrame) -> DataFrame:
    """A6 by scope and kind: rows, rows without creation time."""
    return bands.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("created_at").isNull()).alias("n_undated"))


def inspect_bands(bands: DataFrame) -> dict:
    """Whether the band table has creation times, and its estimated rows and bytes from file statistics.

    Cheap: only schema and statistics are looked at; without row statistics ``rows`` is None, and the number of
    undated rows is known only where there is no such column at all (all of them).
    """
    stats = bands._jdf.queryExecution().optimizedPlan().stats()
    rows = int(str(stats.rowCount().get())) if stats.rowCount().isDefined() else None
    dated = "created_at" in bands.columns
    return {"has_created_at": dated, "rows": rows, "bytes": int(str(stats.sizeInBytes())), "undated": None if dated else rows}


def with_created_at(bands: DataFrame) -> DataFrame:
    """The band table with a column for creation times, null where there was none."""
    return bands if "created_at" in bands.columns else bands.withColumn("created_at", F.lit(None).cast("timestamp"))


def validate_bands(bands: DataFrame) -> DataFrame:
    """band_counts(), after an exact scan; raises if a row has no creation time."""
    counts = band_counts(with_created_at(bands))
    for r in counts.collect():  # four rows: scope and kind
        if r["n_undated"]:
            raise ValueError(f"{r['scope']} {r['kind']} still has {r['n_undated']} rows without created_at")
    return counts


def enforced(bands: DataFrame) -> DataFrame:
    """The band table as it may be written from now on: a row without a creation time is an error."""
    missing = F.raise_error(F.lit("a band row has no created_at")).cast(bands.schema["created_at"].dataType)
    return bands.withColumn("created_at", F.coalesce("created_at", missing))


def bands_by_day(bands: DataFrame, timezone: str = "Asia/Shanghai") -> DataFrame:
    """Band rows and documents by scope, kind and day bucket."""
    return bands.groupBy("scope", "kind", scalars.day_bucket(F.col("created_at"), timezone).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_pk").alias("n_docs"))


def lookup(store: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Stored rows of the wanted values (columns ordinal, value), in the order of their first mention.

    Adds ``ordinal``; repeated values count once, unknown and null ones give no row.
    """
    first = wanted.filter("value is not null").groupBy("value").agg(F.min("ordinal").alias("ordinal"))
    return store.join(first, store[column] == first["value"]).drop("value").orderBy("ordinal", "doc_pk")


def by_exact_hash(store: DataFrame, texts: DataFrame, value: str, limit: int, column: str = "exact_hash") -> DataFrame:
    """Documents of a hash in order of doc_pk, with their texts; the filter reaches the scan."""
    return store.filter(F.col(column) == value).orderBy("doc_pk").limit(limit).join(texts, "doc_pk", "left").orderBy("doc_pk")


def after(rows: DataFrame, last: dict[str, object], limit: int) -> DataFrame:
    """The next rows of a keyset scan, ordered by the key columns of ``last``.

    The condition is written out column by column, so that a bound on the first one reaches the scan.
    """
    keys, beyond, equal = list(last), F.lit(False), F.lit(True)
    for k in keys:
        beyond = beyond | (equal & (F.col(k) > F.lit(last[k])))
        equal = equal & (F.col(k) == F.lit(last[k]))
    return rows.filter(F.col(keys[0]) >= F.lit(last[keys[0]])).filter(beyond).orderBy(*keys).limit(limit)


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of each key numbered from 1; for keys with few rows."""
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
