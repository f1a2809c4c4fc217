"""Structured Streaming: continuous intake of documents with batch ingest, and the exact-only path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from twinsieve.operators.fingerprint import fingerprints
from twinsieve.operators.store import bulk_bands, ingest
from twinsieve.session import folders, ship

STORED = ("doc_pk", "external_id", "source_from", "exact_hash", "title_hash", "raw_hash", "created_at")


def exact_first(stream: DataFrame, hash_column: str = "exact_hash", created: str = "created_at", grace: str = "2 days") -> DataFrame:
    """First document of each hash on a stream; state is dropped once the watermark has passed."""
    return stream.withWatermark(created, grace).dropDuplicatesWithinWatermark([hash_column])


def daily_counts(stream: DataFrame, created: str = "created_at", grace: str = "2 days") -> DataFrame:
    """Documents per UTC day, final once the watermark has passed."""
    return stream.withWatermark(created, grace).groupBy(F.window(created, "1 day")).agg(F.count(F.lit(1)).alias("n_docs"))


def ingest_stream(spark: SparkSession, docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Ingests a stream of documents (doc_pk, external_id, source_from, title, content, created_at).

    Each micro-batch writes its bands first and its fingerprints last, into folders named by the batch,
    which a repeated batch overwrites; so a restart neither loses nor repeats a document.
    """
    ship(spark)

    def run(batch: DataFrame, number: int) -> None:
        done = [f for f in folders(spark, f"{store}/fingerprints", "batch=") if int(f.rpartition("=")[2]) < number]
        prints = fingerprints(batch)
        known = spark.read.parquet(*done) if done else prints.select("doc_pk", "external_id", "exact_hash").limit(0)
        new, _ = ingest(prints.filter("primary_text <> ''"), known)
        bulk_bands(new, created="created_at").write.mode("overwrite").parquet(f"{store}/bands/batch={number}")
        new.select("doc_pk", "normalized_title", "normalized_content", "primary_text").write.mode("overwrite").parquet(f"{store}/texts/batch={number}")
        new.select(*STORED).write.mode("overwrite").parquet(f"{store}/fingerprints/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
