import json
import random

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from twinsieve.llm import collapse, lookalike, queries, seen_keys
from twinsieve.llm.filters import FrequencySketch, Layout, RepeatFilter, flag_by_filter


def test_repeat_filter(spark):
    keys = [i for i in range(3000)] + [i for i in range(0, 3000, 3)] + [7] * 2000
    df = spark.createDataFrame([(k * 7919 - 10**12,) for k in keys] + [(None,)], "k long").repartition(5).withColumn("h", F.xxhash64("k"))
    df = df.withColumn("h", F.when(F.col("k").isNotNull(), F.col("h")))
    f = RepeatFilter.build(df, "h", Layout.of(len(keys)))
    rows = flag_by_filter(df, "h", spark.sparkContext.broadcast(f), twice=True).distinct().collect()
    repeated = {k * 7919 - 10**12 for k in range(0, 3000, 3)} | {7 * 7919 - 10**12}
    assert all(r["maybe"] for r in rows if r["k"] in repeated)
    false = sum(r["maybe"] for r in rows if r["k"] not in repeated)
    assert false < 0.1 * 2000 and not any(r["maybe"] for r in rows if r["k"] is None)
    empty = RepeatFilter.build(df.limit(0), "h", Layout.of(0))
    assert not empty.maybe_repeated(np.array([1], dtype=np.uint64)).any()
    half = RepeatFilter.build(df.filter("k % 2 = 0"), "h", f.layout).merged(RepeatFilter.build(df.filter("k % 2 <> 0"), "h", f.layout))
    assert (half.once == f.once).all() and not (f.twice & ~half.twice).any()


def test_frequency_sketch(spark):
    values = [v for v in range(500) for _ in range(v % 7 + 1)] + [9] * 40000
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    mix = lambda v: np.array(v, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = FrequencySketch.build(df, mix, 14)
    got = s.of(mix(list(range(500))))
    want = np.bincount(values, minlength=500)
    want = FrequencySketch._packed(want)
    assert (got >= want).all() and (got == want).mean() > 0.9 and got[9] >= s.may_exceed(39000) > s.may_exceed(100)


def test_layouts():
    """The load of a filter stays the same at every size; only the number of slices grows."""
    for keys in (0, 1, 10**3, 10**6, 10**9, 10**12):
        layout = Layout.of(keys)
        assert layout.capacity >= keys and layout.bits <= 28 and layout.slices << layout.bits >= 10 * keys
        assert keys < 10**4 or layout.slices << layout.bits <= 40 * keys


def brute_seen(rows, seeded):
    known, firsts, out = set(seeded), {}, set()
    keys = sorted({(n, f, k) for n, f, k in rows})
    for n, f, k in keys:
        firsts.setdefault((f, k), n)
    for n, f, k in keys:
        if (f, k) in known or firsts[f, k] < n:
            out.add((n, f))
    return out


def test_seen_keys_against_brute_force(spark):
    r = random.Random(5)
    hot, names = "ab" * 16, [f"{i:032x}" for i in range(300)]
    rows = []
    for n in range(1, 900):
        h = lambda: r.choice([hot, r.choice(names), f"{r.randrange(10**9):032x}", None, "short", " " + r.choice(names).upper() + "\t", r.choice(names) + "\n"])
        rows.append((n, r.choice([f"id-{r.randrange(200)}", f"ID-{n}", None, ""]), h(), h(), "t"))
    rows += r.sample(rows, 60)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "request_no long, id string, raw_hash string, content_hash string, maybe string")
    seeded = [("id", "id-3"), ("raw_hash", names[0].upper()), ("content_hash", "bad"), ("other", "x"), (None, None), ("id", None)]
    store = seen_keys.seeded_store(spark, spark.createDataFrame(seeded, "key_field string, key_value string"))
    flat = []
    for n, i, a, b, _ in rows:
        flat += [(n, "id", i)] if i is not None else []
        for f, v in (("raw_hash", a), ("content_hash", b)):
            v = v.strip(" \t").lower() if v else None
            if v and len(v) == 32 and all(c in "0123456789abcdef" for c in v):
                flat.append((n, f, v))
    want = brute_seen(flat, [("id", "id-3"), ("raw_hash", names[0])])
    got = store.found(seen_keys.request_keys(df)).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    once = {(f, k) for n, f, k in flat if len({m for m, g, x in flat if (g, x) == (f, k)}) == 1}
    assert 0 <= store.errors().count() < len(once)
    marks = store.mark(df).collect()
    assert len(marks) == 899 and sum(m["seen_id"] for m in marks) == sum(f == "id" for _, f in want)
    for x in store.error_report(seen_keys.request_keys(df)).collect():
        assert x["probes"] == x["ruled_out"] + x["verified"] and 0 <= x["filter_error_rate"] < 0.5
    store.append(seen_keys.request_keys(df))
    store.close()
    store = seen_keys.SeenKeyStore(spark, store.path)
    later = df.select((F.col("request_no") + 5000).alias("request_no"), "id", "raw_hash", "content_hash")
    assert store.found(seen_keys.request_keys(later)).count() == len({(n, f) for n, f, _ in flat})
    assert store.found(seen_keys.request_keys(df.limit(0))).count() == 0


def test_collapse(spark):
    body = lambda t, c, **more: json.dumps({"canonical_input": {"title": t, "content": c}, **more})
    rows = [
        (1, body("Hello, World", "Straße 1")), (2, body("hello world!", "STRASSE-1", doc_pk=7)), (3, body("hello", "worldstraße1")), (4, body(None, "x")), (5, body("", " X. ")),
        (6, "{broken"), (7, None), (8, body("!!", None)), (9, body("only", None)), (9, body("only", None)), (10, json.dumps([1])), (11, json.dumps({"canonical_input": 3})),
        (12, body(5, "x")), (None, body("Hello, World", "Straße 1")), (13, body("長い", "字" * 50000)), (14, body("長い ", "字 " * 50000)),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, payload string, digest string")
    got = sorted((r[0], r[1]) for r in collapse.copies(df).collect())
    assert got == [(1, 2), (4, 5), (4, 12), (13, 14)]
    groups, members = collapse.collapse(df)
    assert sorted((r["first"], r["copies"]) for r in groups.collect()) == [(1, 2), (3, 1), (4, 3), (9, 1), (13, 2)]
    assert members.count() == 9 and collapse.copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("a​b­c", "abc"), ("a b c", "a b c"), ("раураl", "paypal"), ("сора", "copa"),
    ("привет", "привет"), ("пpивeт", "привет"), ("Ѕсоре", "Scope"), ("ɡɑme", "game"), ("ﬁt", "fit"), ("⽤户", "用户"), ("CaSe 1é", "CaSe 1é"), (None, ""), ("", ""), ("a\nb\tc", "a\nb\tc"), ("е́", "é"),
])
def test_look(text, want):
    assert lookalike.normalize_look(text)[0] == want
    assert lookalike.normalize_look(want)[0] == want


@pytest.mark.parametrize("text,want", [("Ꭺpple", "Apple"), ("ⲟrange", "orange"), ("ꓐank", "Bank"), ("ʟogin", "Login"), ("ꜱale", "sale"), ("ᴀlpha", "Alpha"), ("中文аbc中", "中文abc中"), ("москва", "москва"), ("Ελλάδα", "Ελλάδα"), ("ІВМ", "IBM"), ("O0lI1", "O0lI1"), ("ا", "ا"), ("한국어", "한국어")])
def test_unicode_table(spark, text, want):
    look = lookalike.unicode_look(spark)
    assert len(look.shape) > 250 and all(v.isascii() and v.isalpha() for v in look.shape.values())
    assert lookalike.normalize_look(text, look)[0] == want or text == "ا"  # a stroke alone is read as one, in a word it is not
    assert lookalike.normalize_look("السلام", look)[0] == "السلام"


def test_confusable_kinds():
    assert lookalike.normalize_look("pаypal сора привет")[1:] == (1, 1)


def test_lookalike_pairs(spark):
    rows = [(1, "t", "paypal"), (2, "t", "раураl"), (3, "ｔ", "paypal"), (4, "t", "paypal"), (4, "t", "paypal"), (5, "T", "paypal"), (6, None, ""), (7, "", "​"), (8, None, "a b"), (9, "", "a b"), (None, "t", "paypal")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_pk long, title string, content string, look binary")
    got = sorted((r[0], r[1]) for r in lookalike.lookalike_pairs(df, "doc_pk", "title", "content").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (8, 9)]
    assert lookalike.normalized_records(df, "doc_pk", "title", "content").count() == len(rows)
    assert lookalike.lookalike_pairs(df.limit(0), "doc_pk", "title", "content").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf())


def test_queries_of_the_tables(spark, sf):
    for name in ("p2_found", "p2_normalized", "p1_error"):
        assert queries.QUERIES[name](spark, sf).count() > 0


def test_every_disproved_positive_is_logged(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "known"), (5, "c"), (6, "c"), (7, "c")]
    df = spark.createDataFrame(rows, "request_no long, id string").withColumns({f: F.lit(None).cast("string") for f in seen_keys.HASH_FIELDS})
    store = seen_keys.seeded_store(spark, spark.createDataFrame([("id", "known")], "key_field string, key_value string"))
    assert {tuple(x) for x in store.found(seen_keys.request_keys(df)).collect()} == {(2, "id"), (4, "id"), (6, "id"), (7, "id")}
    log = {(x["request"], bytes(x["key"]).decode(), x["kind"]) for x in store.errors().collect()}
    assert {x for x in log if x[2] == "recurs"} == {(1, "a", "recurs"), (5, "c", "recurs")} and {x for x in log if x[2] != "recurs"} <= {(3, "b", "collision")}
    (x,) = store.error_report(seen_keys.request_keys(df)).collect()
    assert x["disproved_recurs"] == 2 and x["disproved"] == 2 + x["disproved_collision"] and x["filter_error_rate"] == x["disproved"] / 8 and x["wrong_mark_rate"] == 0


def test_wrong_marks_are_measured(spark, monkeypatch):
    df = spark.createDataFrame([(n, f"key{n // 2}") for n in range(1, 9)], "request_no long, id string").withColumns({f: F.lit(None).cast("string") for f in seen_keys.HASH_FIELDS})
    store = seen_keys.seeded_store(spark, spark.createDataFrame([], "key_field string, key_value string"))
    monkeypatch.setattr(seen_keys, "flag_by_filter", lambda rows, *_, **__: rows.withColumn("maybe", F.lit(False)))  # a filter that loses everything
    (x,) = store.error_report(seen_keys.request_keys(df)).collect()
    assert x["wrong_mark_rate"] == 3 / 8


def test_batches_and_slices(spark, monkeypatch, tmp_path):
    """Keys of earlier batches are seen; the marks do not depend on how the requests are cut or the filter sliced."""
    r = random.Random(8)
    rows = [(n, f"id-{r.randrange(400)}", f"{r.randrange(300):032x}", None) for n in range(900)]
    df = spark.createDataFrame(rows, "request_no long, id string, raw_hash string, content_hash string")
    flat = [(n, f, v) for n, i, h, _ in rows for f, v in (("id", i), ("raw_hash", h))]
    want = brute_seen(flat, [])
    monkeypatch.setattr(Layout, "of", staticmethod(lambda keys, max_bits=14, real=Layout.of: real(keys, min(max_bits, 14))))
    assert Layout.of(5000).slices == 4
    store, got = seen_keys.SeenKeyStore(spark, f"file://{tmp_path}/keys"), set()
    for a, b in ((0, 100), (100, 101), (101, 600), (600, 900)):
        got |= {tuple(x) for x in store.check(seen_keys.request_keys(df.filter(f"request_no >= {a} and request_no < {b}"))).collect()}
    assert got == want and store.table.rows == len({(f, v) for _, f, v in flat}) == store.keys().distinct().count()
    assert {x["batch"] for x in store.errors().collect()} <= {0, 1, 2, 3} and store.errors().count() > 0
    again = seen_keys.SeenKeyStore(spark, f"file://{tmp_path}/keys")
    assert again.check(seen_keys.request_keys(df)).count() == len(set(flat))
    assert again.check(seen_keys.request_keys(df.limit(0))).count() == 0


def test_a_large_store_rules_new_keys_out(spark):
    store = seen_keys.SeenKeyStore(spark)
    store.append(spark.range(1_000_000).select(F.lit("id").alias("key_field"), F.encode(F.concat(F.lit("k"), F.col("id")), "UTF-8").alias("key")))
    fresh = spark.range(1000).select(F.col("id").alias("request_no"), F.lit("id").alias("key_field"), F.encode(F.concat(F.lit("n"), F.col("id")), "UTF-8").alias("key"))
    fresh = fresh.withColumn("key_field", F.when(F.col("request_no") >= 0, "id").otherwise("raw_hash"))
    (x,) = store.error_report(fresh).collect()
    assert x["ruled_out"] >= 980 and x["wrong_mark_rate"] == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = store._firsts(fresh, "request_no")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = plan.split("SortMergeJoin")[1]
    assert 1 <= sides.count("Exchange") <= 2  # on the side of the batch: per key, and to the buckets where those are more
