"""Queries of the problems over the test tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinsieve.functions.text import normalized, scope_text
from twinsieve.llm import collapse, history, lookalike, mixing, seen_keys, simjoin, splitting, tokenizer
from twinsieve.llm.oracles import ORACLES
from twinsieve.session import spread, written
from twinsieve.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = seen_keys.seeded_store(spark, table(spark, sf_dir, "seeded_key"))
    return store.check(seen_keys.request_keys(table(spark, sf_dir, "prefilter_request")))


def p1_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = seen_keys.seeded_store(spark, table(spark, sf_dir, "seeded_key"))
    return store.mark(table(spark, sf_dir, "prefilter_request"))


def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = seen_keys.seeded_store(spark, table(spark, sf_dir, "seeded_key"))
    return store.error_report(seen_keys.request_keys(table(spark, sf_dir, "prefilter_request")))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p1_error measures and no filter changes: probes, first sightings that recur, keys of one row that are new, wrong marks."""
    report = p1_error(spark, sf_dir)
    return report.select("key_field", "probes", "disproved_recurs", (F.col("ruled_out") + F.col("disproved_collision")).alias("new_once"), "wrong_mark_rate")


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "baseline_record")).select("doc_pk", F.col("canonical_input.title").alias("title"), F.col("canonical_input.content").alias("content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_baseline(spark, sf_dir), "doc_pk", "title", "content")


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalized_records(_baseline(spark, sf_dir), "doc_pk", "title", "content")


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_no, batch_no, primary text and insert of the check requests."""
    rows = spread(table(spark, sf_dir, "check_request"))
    text = scope_text(normalized(F.col("content")), normalized(F.col("title")))
    return rows.select("request_no", "batch_no", text.alias("text"), F.col("insert_on_check").alias("insert"))


def _in_order(batches: list[tuple[int, int, int | None]]) -> list[list[int | None]]:
    """Batches (first, last request, number) in order of arrival; those whose requests overlap go together."""
    out, last = [], None
    for first, end, number in sorted(batches, key=lambda b: b[:2]):
        if last is not None and first <= last:
            out[-1].append(number)
        else:
            out.append([number])
        last = end if last is None else max(last, end)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches in order of arrival, each against the stored texts and all that was accepted before."""
    stored = spread(table(spark, sf_dir, "texts")).select(F.col("doc_pk").alias("id"), F.col("primary_text").alias("text"))
    requests = written(request_texts(spark, sf_dir), "requests")
    held, out = history.History(spark, stored), spark.createDataFrame([], "request_no long")
    per_batch = requests.filter("request_no is not null").groupBy("batch_no").agg(F.min("request_no").alias("first"), F.max("request_no").alias("last"))
    for numbers in _in_order([(r["first"], r["last"], r["batch_no"]) for r in per_batch.toLocalIterator()]):
        batch = requests.filter(F.coalesce(F.col("batch_no").isin([n for n in numbers if n is not None]), F.lit(None in numbers)))
        out = out.unionByName(held.check(batch).filter("duplicate").select("request_no"))
    held.close()
    return out


def primary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_pk and primary text of the baseline records; recomputed where the expectation is null."""
    rows = spread(table(spark, sf_dir, "baseline_record")).select(
        "doc_pk", F.col("expected_from_canonical_input.primary_text").alias("text"), F.col("canonical_input.title").alias("title"), F.col("canonical_input.content").alias("content")
    )
    known = rows.filter(F.col("text").isNotNull()).select("doc_pk", "text")
    rest = rows.filter(F.col("text").isNull()).select("doc_pk", scope_text(normalized(F.col("content")), normalized(F.col("title"))).alias("text"))
    return known.unionByName(rest)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members, _ = simjoin.near_duplicates(primary_texts(spark, sf_dir), "doc_pk", "text")
    return simjoin.expand_links(links, members, "doc_pk")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with text: its class, its group and its number of links."""
    links, members, _ = simjoin.near_duplicates(primary_texts(spark, sf_dir), "doc_pk", "text")
    return simjoin.grouped(written(links, "links"), members, "doc_pk")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the stored bands at hand."""
    scope = F.col("expected_from_canonical_input.content_scope")
    stored = table(spark, sf_dir, "baseline_record").select("doc_pk", scope["simhash_bands"].alias("simhash_bands"), scope["minhash_bands"].alias("minhash_bands")).dropDuplicates(["doc_pk"])
    return p4_classes(spark, sf_dir).join(stored, "doc_pk", "left")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.copies(table(spark, sf_dir, "raw_record"))


def p5_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = collapse.collapse(table(spark, sf_dir, "raw_record"))
    return groups.select(F.col("first").alias("first_record_id"), "copies")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(spread(table(spark, sf_dir, "documents")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "source_weight"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "source_weight"))[1]


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "split_limit"))


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (p1_found, p1_marks, p1_error, p1_counts, p2_found, p2_normalized, p3_found, p4_found, p4_classes, p4_groups, p5_found, p5_articles, p7_ids, p8_mix, p8_shares, p9_pieces)}
