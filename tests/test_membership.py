import datetime as dt

from pyspark.sql import functions as F

from twinsieve.operators import fingerprint, matching, membership, store
from twinsieve.sources.tables import table

DOC = "doc_pk long, external_id string, raw_hash string, exact_hash string, title_hash string"


def test_exact_answers_have_three_values(spark, monkeypatch):
    monkeypatch.setattr(membership, "PART_KEYS", 40)
    docs = spark.createDataFrame([(i, f"e{i}", f"r{i}", f"c{i % 50}", None if i % 2 else f"t{i}") for i in range(300)], DOC)
    filters = membership.exact_filters(docs)
    rows = [(1, "e7", "x", "x", None), (2, "x", "r299", None, None), (3, "x", "x", "c3", "x"), (4, "x", "x", "x", "t8"), (5, "r7", "c3", "e7", "e7"), (6, None, None, None, "t7"), (7, None, None, None, None)]
    probes = spark.createDataFrame(rows, "probe long, external_id string, raw_hash string, exact_hash string, title_hash string")
    got = {r["probe"]: r["exact_maybe"] for r in membership.exact_maybe(probes, filters).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    # Without the title filter nothing is known about probes that have a title.
    got = {r["probe"]: r["exact_maybe"] for r in membership.exact_maybe(probes, filters.filter("filter <> 'title'")).collect()}
    assert got == {1: True, 2: True, 3: None, 4: None, 5: None, 6: None}
    # What is added later lies in a layer of its own.
    more = spark.createDataFrame([(900, "late", "late", "late", "late")], DOC)
    both = filters.unionByName(membership.exact_filters(more, layer=1))
    late = spark.createDataFrame([(1, "late", "x", "x", None), (2, "e1", "x", None, None), (3, "none", "x", None, None)], probes.schema)
    assert {r["probe"]: r["exact_maybe"] for r in membership.exact_maybe(late, both).collect()} == {1: True, 2: True, 3: False}
    empty = membership.exact_filters(docs.limit(0))
    assert {r["exact_maybe"] for r in membership.exact_maybe(probes, empty).collect()} == {False}


def test_false_answers_are_rare(spark):
    docs = spark.range(20000).selectExpr("id as doc_pk", "concat('e', id) as external_id", "cast(null as string) as raw_hash", "cast(null as string) as exact_hash", "cast(null as string) as title_hash")
    probes = spark.range(20000).selectExpr("id as probe", "concat('f', id) as external_id", "cast(null as string) as raw_hash", "cast(null as string) as exact_hash", "cast(null as string) as title_hash")
    assert membership.exact_maybe(probes, membership.exact_filters(docs)).filter("exact_maybe").count() < 20


def test_band_answers(spark):
    day = lambda n: dt.datetime(2025, 1, n, 3)
    rows = [("content", "minhash", 0, 11, 1, day(5)), ("content", "minhash", 1, 12, 1, day(5)), ("title", "minhash", 0, 13, 1, day(5)), ("content", "minhash", 0, 14, 2, day(3)), ("content", "simhash", 0, 15, 2, day(5)), ("content", "minhash", 0, 16, 3, None)]
    bands = spark.createDataFrame(rows, "scope string, kind string, band_index int, band_value long, doc_pk long, created_at timestamp")
    asks = spark.createDataFrame([(1, "minhash", 0, 11), (1, "minhash", 1, 11), (2, "minhash", 0, 14), (3, "minhash", 0, 13), (3, "minhash", 0, 15), (3, "minhash", 0, 16)], "probe long, kind string, band_index int, band_value long")
    days = spark.createDataFrame([(f"d2025010{n}",) for n in (4, 5)], "day string")
    filters = membership.band_filters(bands, reserve=days)
    got = {(r["probe"], r["band_index"], r["band_value"]): r["band_maybe"] for r in membership.band_maybe(asks, filters, F.lit(day(5)), 2).collect()}
    assert got == {(1, 0, 11): True, (1, 1, 11): False, (2, 0, 14): False, (3, 0, 13): False, (3, 0, 15): False, (3, 0, 16): False}
    judged = membership.band_maybe(asks, filters, F.lit(day(5)), 2)
    assert [(r["probe"], r["band_value"]) for r in membership.without_absent_bands(asks, judged).collect()] == [(1, 11)]
    # A day without filters leaves every band of the probe open.
    judged = membership.band_maybe(asks, membership.band_filters(bands), F.lit(day(5)), 2)
    assert {r["band_maybe"] for r in judged.collect()} == {None} and membership.without_absent_bands(asks, judged).count() == 6


def test_read_only_checks_may_skip_and_inserting_ones_not(spark):
    prints = fingerprint.fingerprints(spark.createDataFrame([(1, "a", None, "这是一篇已经保存的文章"), (2, "b", None, "这是一篇已经保存的文章"), (3, "c", None, "别的内容")], "probe long, external_id string, title string, content string"))
    docs = prints.filter("probe = 1").withColumnRenamed("probe", "doc_pk")
    held = docs.select("doc_pk", "external_id", "raw_hash", "exact_hash", "title_hash", F.col("content_simhash_hi").alias("simhash_hi"), F.col("content_simhash_lo").alias("simhash_lo"), "title_simhash_hi", "title_simhash_lo")
    args = store.bulk_bands(docs), held, docs.select("doc_pk", "normalized_title", "normalized_content")
    asked = prints.filter("probe > 1").withColumns({"exact_maybe": F.lit(False), "insert": F.lit(False), "levels": F.array().cast("array<string>")})
    assert {r["probe"]: r["dedupe_status"] for r in matching.check(asked, *args).collect()} == {2: "new", 3: "new"}
    got = {r["probe"]: r["dedupe_status"] for r in matching.check(asked.withColumn("insert", F.lit(True)), *args).collect()}
    assert got == {2: "text_same", 3: "new"}
    answers = {r["probe"]: r for r in matching.details(matching.check(prints.filter("probe > 1"), *args), prints, held, args[2]).collect()}
    assert answers[2]["match_id"] == "a" and answers[2]["sample_text"] == "这是一篇已经保存的文章" and answers[3]["match_raw_hash"] == answers[3]["raw_hash"] and answers[3]["sample_text"] is None


def test_candidates_in_a_window(spark, sf):
    bands = table(spark, sf, "bands")
    asks = bands.filter("scope = 'content'").select(F.col("doc_pk").alias("probe"), "kind", "band_index", "band_value").withColumn("max_bucket", F.lit(None).cast("int"))
    since = matching.Since(F.lit(dt.datetime(2000, 1, 1)), 10)
    assert matching.candidates(asks, bands, "content", "minhash").count() > 0
    assert matching.candidates(asks, bands, "content", "minhash", since=since).count() == 0
    ranks = spark.createDataFrame([(1, 30, 3), (1, 20, 2), (1, 40, 2), (1, 10, 1), (1, 50, 1)], "probe long, doc_pk long, band_hits long")
    summary = matching.ranking_summary(ranks, matching.Params(max_candidates=3)).first()
    assert (summary["unique_before_limit"], summary["top_band_hits"], summary["truncated"]) == (5, 3, True)


def test_leaves_of_bands(spark, sf, tmp_path):
    bands = table(spark, sf, "bands")
    store.save_bands(bands, str(tmp_path / "bands"))
    saved = spark.read.parquet(str(tmp_path / "bands"))
    assert saved.count() == bands.count()
    plan = saved.filter("scope = 'content' and kind = 'minhash'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope" in plan
    asks = bands.filter("scope = 'content'").select(F.col("doc_pk").alias("probe"), "kind", "band_index", "band_value").withColumn("max_bucket", F.lit(None).cast("int"))
    assert matching.candidates(asks, saved, "content", "simhash").count() == matching.candidates(asks, bands, "content", "simhash").count()


def test_stages_are_timed(spark):
    prints = fingerprint.fingerprints(spark.createDataFrame([(1, "a", None, "这是一篇已经保存的文章")], "probe long, external_id string, title string, content string"))
    docs = prints.withColumnRenamed("probe", "doc_pk")
    held = docs.select("doc_pk", "external_id", "raw_hash", "exact_hash", "title_hash", F.col("content_simhash_hi").alias("simhash_hi"), F.col("content_simhash_lo").alias("simhash_lo"), "title_simhash_hi", "title_simhash_lo")
    stages = {}
    matching.check(prints, store.bulk_bands(docs), held, docs.select("doc_pk", "normalized_title", "normalized_content"), stages=stages)
    assert set(stages) == {"probes", "text-same", "content-simhash", "content-minhash", "title-simhash", "title-minhash"} and all(v >= 0 for v in stages.values())
