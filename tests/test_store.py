import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from twinsieve.operators import store
from twinsieve.operators.generations import Generations, Prewrite
from twinsieve.params import DEFAULTS, Params
from twinsieve.sources import intake
from twinsieve.streaming.intake import daily_counts, exact_first, ingest_stream


def sequential(rows, stored):
    ids, hashes, out = {s[0] for s in stored}, {s[1] for s in stored}, []
    for pk, e, h in sorted(rows):
        if (e is not None and e in ids) or (h is not None and h in hashes):
            continue
        ids.add(e)
        hashes.add(h)
        out.append(pk)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ingest_equals_sequential_inserts(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([f"e{r.randrange(25)}", None]), r.choice([f"h{r.randrange(25)}", f"h{r.randrange(25)}", None])) for i in range(60)]
    stored = [("e1", "h2"), ("e3", "h4")]
    batch = spark.createDataFrame(rows, "doc_pk long, external_id string, exact_hash string")
    held = spark.createDataFrame([(1000 + i, *s) for i, s in enumerate(stored)], "doc_pk long, external_id string, exact_hash string")
    inserted, resolved = store.ingest(batch, held)
    assert sorted(x["doc_pk"] for x in inserted.collect()) == sequential(rows, stored)
    got = resolved.collect()
    assert len(got) == 60 and all(x["resolved_pk"] is not None for x in got)
    assert store.ingest(batch.limit(0), held)[0].count() == 0


def test_keyed_reads(spark):
    rows = spark.createDataFrame([(i, f"e{i % 4}", dt.datetime(2025, 1, 1 + i)) for i in range(12)], "doc_pk long, external_id string, created_at timestamp")
    wanted = spark.createDataFrame([(1, "e2"), (2, "nobody"), (3, "e0"), (4, "e2"), (5, None)], "ordinal long, value string")
    got = [(r["ordinal"], r["doc_pk"]) for r in store.lookup(rows, wanted, "external_id").collect()]
    assert got == [(1, 2), (1, 6), (1, 10), (3, 0), (3, 4), (3, 8)]
    page = store.after(rows, {"external_id": "e1", "doc_pk": 5}, 3).collect()
    assert [(r["external_id"], r["doc_pk"]) for r in page] == [("e1", 9), ("e2", 2), ("e2", 6)]
    as_of = F.lit(dt.datetime(2025, 1, 10))
    assert [r[0] for r in store.expired(rows, as_of, 6, batch=2, max_batches=1).collect()] == [0, 1]
    assert store.expired(rows, as_of, 0).count() == 0
    texts = rows.select("doc_pk", F.lit("x").alias("primary_text"))
    assert [r["doc_pk"] for r in store.by_exact_hash(rows, texts, "e3", 2, "external_id").collect()] == [3, 7]
    assert store.without_documents(rows, rows.filter("doc_pk < 5")).count() == 7


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/index")
    df = spark.range(3)
    g.build("g000001", {"bands": df})
    with pytest.raises(ValueError):
        g.begin("g000002")
    assert g.writable() == ["g000001"]
    g.activate("g000001")
    g.build("g000002", {"bands": spark.range(5)})
    assert g.writable() == ["g000001", "g000002"] and g.read("bands").count() == 3
    for name in ("g000001", "g000002"):
        with pytest.raises(ValueError):
            g.cleanup(name)
    g.activate("g000002")
    assert g.read("bands").count() == 5
    g.cleanup("g000001")
    with pytest.raises(ValueError):
        g.activate("g000002")
    with pytest.raises(Exception):
        g.build("g000003", {"bands": spark.range(1).select(F.raise_error(F.lit("x")).alias("x"))})
    assert g.meta("g000003")["state"] == "degraded" and g.writable() == ["g000002"] and "x" in g.meta("g000003")["reason"]
    with pytest.raises(ValueError):
        g.folder("../bad")


def test_a_failed_build_can_be_begun_again(spark, tmp_path):
    g, bad = Generations(spark, f"file://{tmp_path}/index"), spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        g.build("g000001", {"first": spark.range(4), "second": bad})
    assert g.status() == {"active": None, "building": "g000001"} and g.active_ready() is None
    with pytest.raises(ValueError):
        g.build("g000002", {"first": spark.range(1)})
    with pytest.raises(ValueError):
        g.begin("g000001", Params(minhash_perms=64))
    seen = []
    g.build("g000001", {"first": spark.range(9), "second": spark.range(2)}, report=seen.append)
    assert g.read("first", "g000001").count() == 4  # complete before the failure, not written again
    assert [(x["table"], x["rows"], x["percent"]) for x in seen] == [("first", 4, 50.0), ("second", 2, 100.0)]
    g.activate("g000001")
    assert g.active_ready() == "g000001"
    with pytest.raises(Exception):
        g.build("g000002", {"first": bad})
    g.cleanup("g000002")  # a failed build may go
    assert g.status() == {"active": "g000001", "building": None} and g.meta("g000002") is None
    g.build("g000002", {"first": spark.range(1)})
    with pytest.raises(ValueError):
        g.begin("g000001")
    with pytest.raises(ValueError):
        Generations(spark, f"file://{tmp_path}/index").begin("g000003")


def test_prewrite(spark, tmp_path, monkeypatch):
    g = Generations(spark, f"file://{tmp_path}/index")
    assert g.prewrite(lambda folder: None) == Prewrite("skipped") and not Prewrite("skipped").attempted
    g.build("g000001", {"t": spark.range(1)})
    g.activate("g000001")
    done = []
    assert g.prewrite(done.append) == Prewrite("success", ("g000001",)) and done == [g.folder("g000001")]

    def fail(folder):
        raise OSError("no space")

    got = g.prewrite(fail)
    assert got.attempted and not got.succeeded and got.error == "no space" and g.active_ready() is None and g.writable() == []
    g.build("g000002", {"t": spark.range(1)})
    monkeypatch.setattr(g, "degrade", fail)
    with pytest.raises(RuntimeError):
        g.prewrite(fail)


def test_intake(spark, tmp_path):
    bodies = ['{"title":"a","limit":3}', '{"title":"a","odd":1}', "{broken", '{"title":"","content":null}', None, '{"content":"x","levels":["simhash"],"insert_on_check":true}']
    got = intake.decode_requests(spark.createDataFrame([(b,) for b in bodies], "value string")).collect()
    assert [r["error"] for r in got] == [None, "unknown field: odd", "no JSON object", "title/content are all empty", "no JSON object", None]
    assert got[5]["request"]["insert_on_check"] and got[0]["request"]["limit"] == 3
    record = {"doc_pk": 1, "canonical_input": {"title": "t", "content": None}, "expected_from_canonical_input": {"raw_hash_hex": "x", "content_scope": {"minhash_signature_uint64": [18446744073709551615]}}}
    (tmp_path / "b.json").write_text(json.dumps({"format": intake.BASELINE_FORMAT, "records": [record]}))
    row = intake.read_baseline(spark, str(tmp_path / "b.json")).first()
    assert row["doc_pk"] == 1 and row["expected_from_canonical_input"]["content_scope"]["minhash_signature_uint64"] == ["18446744073709551615"]
    (tmp_path / "c.json").write_text(json.dumps({"format": "other", "records": []}))
    with pytest.raises(Exception, match="unknown baseline format"):
        intake.read_baseline(spark, str(tmp_path / "c.json")).collect()
    intake.write_meta(spark, str(tmp_path / "index"), DEFAULTS)
    intake.check_meta(spark, str(tmp_path / "index"), DEFAULTS)
    with pytest.raises(ValueError):
        intake.check_meta(spark, str(tmp_path / "index"), Params(minhash_perms=64))


def test_streaming(spark, tmp_path):
    schema = "doc_pk long, external_id string, source_from string, title string, content string, created_at timestamp"
    at = dt.datetime(2025, 1, 1)
    first = [(1, "e1", "s", "标题", "第一篇文章的内容", at), (2, "e2", "s", None, "第一篇文章的内容", at), (3, "e3", "s", None, None, at)]
    second = [(4, "e4", "s", None, "第一篇文章的内容", at), (5, "e5", "s", None, "第二篇文章的内容", at)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for rows in (None, second):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest_stream(spark, stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(180)
    assert sorted(r["doc_pk"] for r in spark.read.parquet(str(tmp_path / "store/fingerprints")).collect()) == [1, 5]
    assert spark.read.parquet(str(tmp_path / "store/bands")).count() == 80 + 40
    later = [(6, "e6", "s", None, "第一篇文章的内容", at + dt.timedelta(days=1)), (7, "e7", "s", None, "新的", at + dt.timedelta(days=20))]
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, f in (("firsts", lambda s: exact_first(s.filter("content is not null"), "content")), ("days", daily_counts)):
        stream = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(180)
    firsts = [r["content"] for r in spark.table("firsts").collect()]
    assert firsts.count("第一篇文章的内容") == 1 and {"第二篇文章的内容", "新的"} <= set(firsts)
    # Days that the watermark (the latest day less two days of grace) has passed are final, the latest is still open.
    days = {str(r["window"]["start"].date()): r["n_docs"] for r in spark.table("days").collect()}
    assert days == {"2025-01-01": 5, "2025-01-02": 1}



def test_band_schema(spark):
    old = spark.createDataFrame([("content", "simhash", 0, 5, 1), ("title", "simhash", 0, 6, 2)], "scope string, kind string, band_index int, band_value long, doc_pk long")
    assert store.inspect_bands(old)["has_created_at"] is False
    bands = store.with_created_at(old)
    assert store.inspect_bands(bands)["has_created_at"] and store.inspect_bands(bands)["undated"] is None
    with pytest.raises(ValueError, match="1 rows without"):
        store.validate_bands(bands)
    dated = store.backfill_created_at(bands, spark.createDataFrame([(1, dt.datetime(2025, 1, 1)), (2, dt.datetime(2025, 1, 2))], "doc_pk long, created_at timestamp"))
    assert store.validate_bands(dated).count() == 2 and store.enforced(dated).count() == 2
    with pytest.raises(Exception, match="no created_at"):
        store.enforced(bands).collect()
