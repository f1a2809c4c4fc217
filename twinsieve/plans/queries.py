"""Core queries over the test tables, by name; their SQL counterparts are in oracles.py."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinsieve.functions import hashing, scalars, text
from twinsieve.operators import fingerprint, matching, membership, metrics, skew, store
from twinsieve.params import EXACT_FPP, MINHASH_FPP
from twinsieve.plans.oracles import ORACLES
from twinsieve.session import distinct_by, written
from twinsieve.sources import intake
from twinsieve.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


BUCKET = ["scope", "kind", "band_index", "band_value"]


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct baseline records: doc_pk, source_from, title, content."""
    rows = table(spark, sf_dir, "baseline_record")
    rows = rows.select("doc_pk", "source_from", F.col("canonical_input.title").alias("title"), F.col("canonical_input.content").alias("content"))
    return distinct_by(rows, "doc_pk")


def baseline_prints(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = baseline(spark, sf_dir)
    own = scalars.stable_document_id(F.lit(None).cast("string"), F.col("source_from"), F.col("title"), F.col("content"))
    return fingerprint.fingerprints(rows.withColumn("external_id", own), **options)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with more distinct documents than the smallest valid max_bucket_size of the requests."""
    limit = table(spark, sf_dir, "check_request").filter("max_bucket_size >= 1").agg(F.min("max_bucket_size")).scalar()
    sizes = skew.salted_count_distinct(table(spark, sf_dir, "bands"), BUCKET, "doc_pk", "n_docs")
    return sizes.filter(F.col("n_docs") > limit).select(*BUCKET)


@query
def p6_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every bucket."""
    return skew.salted_count_distinct(table(spark, sf_dir, "bands"), BUCKET, "doc_pk", "n_docs")


# -- fingerprints of the baseline (F1 to F16, Q1, Q7) ---------------------------------------------


@query
def doc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline(spark, sf_dir).select("doc_pk", text.normalized(F.col("title")).alias("normalized_title"), text.normalized(F.col("content")).alias("normalized_content"))


@query
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline(spark, sf_dir).withColumns({"t": text.normalized(F.col("title")), "c": text.normalized(F.col("content"))})
    title_hash, content_hash = scalars.text_hash(F.col("t")), scalars.text_hash(F.col("c"))
    return rows.select("doc_pk", F.md5(scalars.raw_hash_text(F.col("title"), F.col("content"))).alias("raw_hash"), content_hash.alias("content_hash"),
                       title_hash.alias("title_hash"), scalars.exact_hash(content_hash, title_hash).alias("exact_hash"))


@query
def doc_scope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline(spark, sf_dir).select("doc_pk", text.scope_text(text.normalized(F.col("content")), text.normalized(F.col("title"))).alias("primary_text"))
    return rows.withColumns({"text_len": F.length("primary_text"), "low_information": text.low_information(F.col("primary_text"))})


@query
def doc_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = baseline_prints(spark, sf_dir, title_scope=False)
    return prints.select("doc_pk", hashing.simhash_hex(F.col("content_simhash_hi"), F.col("content_simhash_lo")).alias("simhash_hex"))


@query
def doc_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.band_rows(baseline_prints(spark, sf_dir, title_scope=False), "doc_pk", "content")


@query
def fingerprint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = written(fingerprint.verify(table(spark, sf_dir, "baseline_record")), "verified")
    return fingerprint.report(checked).withColumn("failures", F.array_join(F.col("failures").cast("array<string>"), ","))


@query
def stored_simhash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of the stored texts in the MD5 family, which SQL can follow bit by bit."""
    rows = table(spark, sf_dir, "texts").select("doc_pk", hashing.fingerprint(F.col("primary_text"), family="md5").alias("f"))
    return rows.select("doc_pk", F.col("f.simhash_hi").alias("simhash_hi"))


@query
def raw_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.raw_hash_text(F.col("title"), F.col("text"))).alias("raw_hash"))


@query
def stable_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "check_request").dropDuplicates(["request_no"])
    return rows.select("request_no", scalars.stable_document_id(F.col("id"), F.col("source_from"), F.col("title"), F.col("content")).alias("external_id"))


@query
def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "texts").select("doc_pk", scalars.sample_text(F.col("primary_text")).alias("sample"))


@query
def stored_low_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "texts").select("doc_pk", text.low_information(F.col("primary_text")).alias("low_information"))


@query
def ngram_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = text.ngrams(F.col("primary_text"))
    return table(spark, sf_dir, "texts").select("doc_pk", F.size(grams).alias("n_grams"), F.size(F.array_distinct(grams)).alias("n_distinct"))


@query
def ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 50 most frequent 5-grams."""
    grams = table(spark, sf_dir, "texts").select(F.explode(text.ngrams(F.col("primary_text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query
def stored_simhash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fingerprints").select("doc_pk", hashing.simhash_hex(F.col("simhash_hi"), F.col("simhash_lo")).alias("simhash_hex"))


@query
def uint64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bands").select("band_value").distinct().withColumn("digits", scalars.to_unsigned(F.col("band_value")))
    return rows.select("band_value", "digits", scalars.from_unsigned(F.col("digits")).alias("back"))


@query
def band_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bands")
    return rows.groupBy("scope", "kind", scalars.valid_band(F.col("kind"), F.col("band_index"), F.col("band_value")).alias("valid")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def valid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24 over the largest table: requests with a well-formed hash, by field."""
    rows = table(spark, sf_dir, "prefilter_request").dropDuplicates(["request_no"])
    return rows.agg(*[F.count(scalars.hash_hex(F.col(c))).alias(c) for c in ("raw_hash", "content_hash", "title_hash")])


# -- days and retention (F26 to F29, A6, A8, B15, B16, S14, S15) ----------------------------------


@query
def day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("created_at")
    return table(spark, sf_dir, "fingerprints").select("doc_pk", scalars.day_bucket(at).alias("day"), scalars.bucket_expiry(at, 10, 2).cast("timestamp_ntz").alias("expires_at"))


@query
def query_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fingerprints").select("doc_pk", F.posexplode(scalars.query_buckets(F.col("created_at"), 3)).alias("no", "day"))


@query
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the ten days that end with the latest creation time."""
    rows = table(spark, sf_dir, "fingerprints")
    latest = rows.agg(F.max("created_at")).scalar()
    return rows.filter(scalars.in_window(F.col("created_at"), latest, 10)).select("doc_pk")


@query
def expire_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fingerprints")
    as_of = F.lit(rows.agg(F.max("created_at")).first()[0])
    return store.expired(rows, as_of, 4)


@query
def bands_after_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = store.without_documents(table(spark, sf_dir, "bands"), expire_documents(spark, sf_dir))
    return left.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def backfill_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.backfill_created_at(table(spark, sf_dir, "bands"), table(spark, sf_dir, "fingerprints"))
    return rows.distinct().withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.band_counts(table(spark, sf_dir, "bands"))


@query
def bands_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bands_by_day(table(spark, sf_dir, "bands"))


@query
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, e, round(scalars.bloom_bits_per_key(e), 6), scalars.bloom_hashes(e), round(scalars.bloom_union_error(e), 6)) for name, e in (("exact", EXACT_FPP), ("minhash", MINHASH_FPP))]
    return spark.createDataFrame(rows, "filter string, error double, bits_per_key double, n_hashes int, union_error double")


# -- exact lookups, ingest, keyed reads (J1, S3 to S12, K9) ---------------------------------------


@query
def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fingerprints").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_hashes(spark, sf_dir).filter("exact_hash is not null")
    return rows.groupBy("exact_hash").agg(F.min("doc_pk").alias("first_pk"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")


@query
def exact_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = doc_hashes(spark, sf_dir).join(baseline(spark, sf_dir), "doc_pk")
    own = scalars.stable_document_id(F.lit(None).cast("string"), F.col("source_from"), F.col("title"), F.col("content"))
    both = F.col("content_hash").isNotNull()
    probes = prints.select(F.col("doc_pk").alias("probe"), own.alias("external_id"), "raw_hash", F.col("exact_hash").alias("content_hash"), F.when(both, F.col("title_hash")).alias("title_hash"))
    return matching.prefilter(probes, table(spark, sf_dir, "fingerprints"))


@query
def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the baseline that a batch insert into the store would add."""
    prints = doc_hashes(spark, sf_dir).join(baseline(spark, sf_dir), "doc_pk").filter("exact_hash is not null")
    own = scalars.stable_document_id(F.lit(None).cast("string"), F.col("source_from"), F.col("title"), F.col("content"))
    inserted, _ = store.ingest(prints.select("doc_pk", own.alias("external_id"), "exact_hash"), table(spark, sf_dir, "fingerprints"))
    return inserted


@query
def ingest_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stands for each baseline record after the batch insert: itself, or the one it repeats."""
    prints = doc_hashes(spark, sf_dir).join(baseline(spark, sf_dir), "doc_pk").filter("exact_hash is not null")
    own = scalars.stable_document_id(F.lit(None).cast("string"), F.col("source_from"), F.col("title"), F.col("content"))
    _, resolved = store.ingest(prints.select("doc_pk", own.alias("external_id"), "exact_hash"), table(spark, sf_dir, "fingerprints"))
    return resolved


@query
def prefilter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents, with texts, of every exact hash that a baseline record has."""
    asked = doc_hashes(spark, sf_dir).filter("exact_hash is not null").select("exact_hash").distinct()
    found = table(spark, sf_dir, "fingerprints").join(asked, "exact_hash", "left_semi").select("doc_pk", "exact_hash")
    return found.join(table(spark, sf_dir, "texts").select("doc_pk", "normalized_title", "normalized_content"), "doc_pk")


@query
def missing_band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band rows stored, and rows that a back-fill from the stored texts would add, by scope and kind."""
    texts = table(spark, sf_dir, "texts").select("doc_pk", F.col("normalized_title").alias("title"), F.col("normalized_content").alias("content"))
    prints = written(fingerprint.of_normalized(texts), "stored-prints")
    bands = table(spark, sf_dir, "bands")
    lacking = store.missing_bands(prints, bands).groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_missing"))
    held = bands.select(*BUCKET, "doc_pk").distinct().groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_stored"))
    return held.join(lacking, ["scope", "kind"], "left").select("scope", "kind", "n_stored", F.coalesce("n_missing", F.lit(0).cast("long")).alias("n_missing"))


@query
def gram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the gram sets of title and primary text of every stored document, to 4 digits."""
    score = scalars.jaccard(text.ngrams(F.col("normalized_title")), text.ngrams(F.col("primary_text")))
    return table(spark, sf_dir, "texts").select("doc_pk", F.round(score, 4).alias("score"))


@query
def strict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict decoding of requests says to every raw line; all of them have fields that no request has."""
    return intake.decode_requests(table(spark, sf_dir, "raw_record"), "payload").select("record_id", "error")


@query
def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents of the ids that requests name, in the order of the requests."""
    wanted = table(spark, sf_dir, "check_request").select(F.col("request_no").alias("ordinal"), F.col("id").alias("value"))
    return store.lookup(table(spark, sf_dir, "fingerprints"), wanted, "external_id").select("ordinal", "doc_pk", "external_id")


@query
def lookup_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents of the content hashes that prefilter requests name, in the order of their first mention."""
    wanted = table(spark, sf_dir, "prefilter_request").select(F.col("request_no").alias("ordinal"), scalars.hash_hex(F.col("content_hash")).alias("value"))
    return store.lookup(table(spark, sf_dir, "fingerprints"), wanted, "exact_hash").select("ordinal", "doc_pk", "exact_hash")


@query
def hash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of one hash with texts: of the title hash that comes first in order, at most 20 documents; the limit is the feature."""
    stored = table(spark, sf_dir, "fingerprints")
    value = stored.agg(F.min("title_hash")).first()[0]
    found = store.by_exact_hash(stored, table(spark, sf_dir, "texts"), value if value is not None else "", 20, "title_hash")
    return found.select("doc_pk", "title_hash", "normalized_title", "normalized_content")


@query
def band_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 dated rows of a MinHash leaf with a positive value, by value, time and document: paging is the feature."""
    leaf = table(spark, sf_dir, "bands").filter("scope = 'content' and kind = 'minhash' and band_index = 0 and created_at is not null")
    start = {"band_value": 0, "created_at": datetime.datetime(1970, 1, 1), "doc_pk": 0}
    return store.after(leaf.select("band_value", "created_at", "doc_pk").distinct(), start, 100).select("band_value", "doc_pk")


@query
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 100 documents after the middle one of the store: paging is the feature."""
    rows = table(spark, sf_dir, "fingerprints")
    middle = rows.agg(F.floor((F.min("doc_pk") + F.max("doc_pk")) / 2)).first()[0]
    return store.after(rows, {"doc_pk": middle if middle is not None else 0}, 100).select("doc_pk", "external_id")


@query
def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.payload_fields(table(spark, sf_dir, "raw_record")).select("record_id", "title", "content")


# -- candidates, matching, check (J2 to J4, P4, A3 to A5, K1 to K6, Q2 to Q4) ---------------------


@query
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = matching.bucket_sizes(table(spark, sf_dir, "bands"))
    return sizes.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n_buckets"), F.max("n_docs").alias("largest"), F.sum("n_docs").alias("n_rows"))


def _probes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return written(baseline_prints(spark, sf_dir, **options).withColumnRenamed("doc_pk", "probe"), "probes")


def _baseline_store(spark: SparkSession, sf_dir: str, title_scope: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(probes, bands, store, texts) of the baseline held against itself, each record under its own id."""
    probes = _probes(spark, sf_dir, title_scope=title_scope).withColumn("external_id", F.col("probe").cast("string"))
    docs = probes.withColumnRenamed("probe", "doc_pk")
    columns = ["doc_pk", "external_id", F.col("content_simhash_hi").alias("simhash_hi"), F.col("content_simhash_lo").alias("simhash_lo")]
    if title_scope:
        bands = store.bulk_bands(docs)
        columns += [F.col("title_simhash_hi"), F.col("title_simhash_lo")]
    else:
        bands = fingerprint.band_rows(docs, "doc_pk", "content").withColumn("scope", F.lit("content"))
    return probes, written(bands, "bands"), docs.select(*columns), docs.select("doc_pk", "normalized_title", "normalized_content")


def _baseline_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content bands of the baseline records as probes with the default limits."""
    asks = fingerprint.band_rows(baseline_prints(spark, sf_dir, title_scope=False), "doc_pk", "content").withColumnRenamed("doc_pk", "probe")
    return asks.withColumn("max_bucket", F.lit(None).cast("int"))


def _last_days(spark: SparkSession, sf_dir: str) -> matching.Since:
    """The ten days that end with the latest creation time of the store."""
    return matching.Since(F.lit(table(spark, sf_dir, "fingerprints").agg(F.max("created_at")).first()[0]), 10)


@query
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash buckets that every baseline record meets in the store, hot ones counted as skipped."""
    return metrics.candidate_stats(_baseline_asks(spark, sf_dir), table(spark, sf_dir, "bands"), "content", "simhash")


@query
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both matchers of the content scope do for every baseline record against the store."""
    probes = _probes(spark, sf_dir, title_scope=False)
    return metrics.match_stats(probes, *[table(spark, sf_dir, t) for t in ("bands", "fingerprints", "texts")])


@query
def band_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored MinHash candidates of every baseline record with the number of bands they share."""
    return matching.candidates(_baseline_asks(spark, sf_dir), table(spark, sf_dir, "bands"), "content", "minhash")


@query
def simhash_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored SimHash candidates of every baseline record with the number of bands they share."""
    return matching.candidates(_baseline_asks(spark, sf_dir), table(spark, sf_dir, "bands"), "content", "simhash")


@query
def recent_band_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for band rows of the last ten days."""
    return matching.candidates(_baseline_asks(spark, sf_dir), table(spark, sf_dir, "bands"), "content", "minhash", since=_last_days(spark, sf_dir))


@query
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates before the cut, most bands hit, and whether candidates are cut, for every baseline record."""
    return matching.ranking_summary(band_hits(spark, sf_dir))


@query
def exact_maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline records with a stored id or hash: those the membership filters let through, confirmed by lookup."""
    stored = table(spark, sf_dir, "fingerprints")
    prints = doc_hashes(spark, sf_dir).join(baseline(spark, sf_dir), "doc_pk")
    own = scalars.stable_document_id(F.lit(None).cast("string"), F.col("source_from"), F.col("title"), F.col("content"))
    probes = written(prints.select(F.col("doc_pk").alias("probe"), own.alias("external_id"), "raw_hash", "exact_hash", F.col("exact_hash").alias("content_hash"), "title_hash"), "probes")
    filters = written(membership.exact_filters(stored), "exact-filters")
    let_through = membership.exact_maybe(probes, filters).filter(F.coalesce("exact_maybe", F.lit(True))).select("probe")
    return matching.prefilter(probes.join(let_through, "probe", "left_semi"), stored).select("probe")


@query
def band_maybe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash bands of the baseline that were stored in the last ten days: those the day filters let through, confirmed."""
    since, bands = _last_days(spark, sf_dir), table(spark, sf_dir, "bands")
    asks = _baseline_asks(spark, sf_dir)
    days = table(spark, sf_dir, "fingerprints").agg(F.max("created_at").alias("at")).select(F.explode(scalars.query_buckets(F.col("at"), since.days)).alias("day"))
    filters = written(membership.band_filters(bands, reserve=days), "band-filters")
    judged = membership.band_maybe(asks, filters, since.as_of, since.days)
    left = membership.without_absent_bands(asks.filter("kind = 'minhash'"), judged)
    stored = bands.filter("scope = 'content' and kind = 'minhash'").filter(scalars.in_window(F.col("created_at"), since.as_of, since.days))
    return left.join(stored.select("band_index", "band_value").distinct(), ["band_index", "band_value"], "left_semi").select("probe", "band_index")


@query
def match_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash matches of every baseline record among the others."""
    probes, bands, held, _ = _baseline_store(spark, sf_dir)
    return matching.match_simhash(probes, bands, held)


@query
def match_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash matches of every baseline record among the others."""
    return matching.match_minhash(*_baseline_store(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query
def match_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title scope of both matchers."""
    probes, bands, held, texts = _baseline_store(spark, sf_dir, title_scope=True)
    probes = probes.filter("normalized_title <> '' and normalized_content <> ''")
    sim = matching.match_simhash(probes, bands, held, "title").select("probe", "doc_pk", F.lit("simhash").alias("method"), F.col("hamming_distance").cast("double").alias("value"), "rank")
    return sim.unionByName(matching.match_minhash(probes, bands, held, texts, "title").select("probe", "doc_pk", F.lit("minhash").alias("method"), F.round("score", 6).alias("value"), "rank"))


def _rounded(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("score", F.round("score", 6))


@query
def check_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade without the title chain, for every baseline record."""
    return _rounded(matching.check(_probes(spark, sf_dir, title_scope=True), *[table(spark, sf_dir, t) for t in ("bands", "fingerprints", "texts")], title_chain=False))


def _request_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the distinct check requests with their own limits and levels."""
    rows = distinct_by(table(spark, sf_dir, "check_request"), "request_no")
    own = scalars.stable_document_id(F.col("id"), F.col("source_from"), F.col("title"), F.col("content"))
    bucket = F.when(F.col("max_bucket_size") >= 1, F.col("max_bucket_size"))
    rows = rows.select(F.col("request_no").alias("probe"), own.alias("external_id"), "title", "content", "max_hamming", bucket.alias("max_bucket"), "levels", F.col("insert_on_check").alias("insert"))
    return fingerprint.fingerprints(rows)


@query
def check_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade for every check request that has text, nothing stored."""
    return _rounded(matching.check(_request_prints(spark, sf_dir), *[table(spark, sf_dir, t) for t in ("bands", "fingerprints", "texts")]))


@query
def check_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes, match and sample text of the answer to every check request that has text."""
    prints = written(_request_prints(spark, sf_dir), "request-prints")
    held = [table(spark, sf_dir, t) for t in ("bands", "fingerprints", "texts")]
    out = matching.details(matching.check(prints, *held), prints, *held[1:])
    return out.select("probe", "raw_hash", "content_hash", "title_hash", "match_id", "match_raw_hash", "match_content_hash", "match_title_hash", "sample_text")


@query
def check_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade in order of arrival, new requests stored where they ask for it."""
    return matching.check_and_insert(_request_prints(spark, sf_dir), *[table(spark, sf_dir, t) for t in ("bands", "fingerprints", "texts")])
