import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from twinsieve.functions import hashing, scalars, text
from twinsieve.operators.fingerprint import fingerprints
from twinsieve.params import Params

GOLDEN = [
    ("测试 123 新闻😀[微笑]", "测试新闻", "fe3d9701e912fd41e1652161e97c4752", 1285548739338521036, 10257560906482201329),
    (" H e l l o ", "hello", "46fb7408d4f285228f4af516ea25851b", 13272477789874919601, 7452325639198325306),
    ("好上午九点去高铁站的找拼车吗", "好上午九点去高铁站的找拼车吗", "f1f7559c3fbb75ef7dd4f5d632836c3f", 2341578562428639259, 3468585686763990425),
    ("标点，全角！ＡＢＣ１２３。保留「引号」", "标点全角。保留「引号」", "483b07f4099ee405e7fb76b00e93ad10", 1024958586189199619, 3877985480013302422),
    ("①②③ 12.5%", "12312.5%", "69567ffe9dbb375f41e4f5b766c3b4df", 7054672320742993294, 2166983399216087085),
    ("[ok][ok][ok]", "[ok][ok][ok]", "9f7c53b86b57b767fbddcdb5fa67af56", 3058227406561854847, 8686678063165848036),
    ("", "", "0" * 32, 2**64 - 1, 2**64 - 1),
    ("０", "0", "1240a4684403b160e6597a653a88f56c", 14733578170966533113, 554717945652898594),
    ("〰波浪〽", "波浪", "29898f754e93818347c38ef7af322c88", 92055341319099730, 9614649902706175983),
    ("甲乙甲乙甲", "甲乙甲乙甲", "bf9faea85ab311fbb6d23b67890e4de6", 1282785733469990216, 6300110120558701085),
]


@pytest.mark.parametrize("content,normal,simhash,first,last", GOLDEN)
def test_golden(content, normal, simhash, first, last):
    assert text.normalize(content) == normal
    hi, lo, signature = hashing.fingerprint_of(normal)
    assert f"{hi & (1 << 64) - 1:016x}{lo & (1 << 64) - 1:016x}" == simhash
    assert (int(signature[0]), int(signature[31])) == (first, last)


def test_blake2b(spark):
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(hashing.blake2b_hex8("t").alias("a"), hashing.blake2b_hex16("t").alias("b")).collect()
    assert got[0]["a"] == "d8bb14d833d59559" and len(got[0]["b"]) == 32 and got[1]["a"] is None


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None, None, 9), (2, "标题", None, 9), (3, "", "0", 9), (4, "标题", "正文" * 20000, 9), (4, "标题", "正文" * 20000, 9), (5, None, "a😀b𠮷c", 9)]
    got = {r["k"]: r for r in fingerprints(spark.createDataFrame(rows, "k long, title string, content string, raw_hash int")).collect()}
    assert got[1]["primary_text"] == "" and got[1]["exact_hash"] is None and got[1]["low_information"] and got[1]["content_simhash_hi"] == 0
    assert got[2]["primary_text"] == "标题" and got[2]["exact_hash"] == got[2]["title_hash"] and got[2]["content_hash"] is None
    assert got[3]["primary_text"] == "0" and got[3]["title_simhash_bands"] is None
    assert got[4]["text_len"] == 40000 and len(got[4]["title_minhash_bands"]) == 32
    assert fingerprints(spark.createDataFrame([], "k long, title string, content string")).count() == 0


def test_ngrams(spark):
    rows = ["甲乙甲乙甲", "中文", "", None, "a😀bc𠮷de", "abcdefabcdef"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.ngrams(F.col("t"), 3)).collect()]
    assert got == [hashing.gram_list(t or "", 3) for t in rows]
    with pytest.raises(ValueError):
        text.ngrams(F.col("t"), 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_gram_hashes_are_sets_of_grams(texts):
    for t, h in zip(texts, text.gram_hashes(texts)):
        assert len(h) == len(set(hashing.gram_list(t)))
    alone = [text.gram_hashes([t])[0].tolist() for t in texts]
    assert alone == [h.tolist() for h in text.gram_hashes(texts)]


def test_uint64(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 42]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("d", scalars.to_unsigned(F.col("v")))
    got = df.select("v", "d", scalars.from_unsigned(F.col("d")).alias("back")).collect()
    assert all(r["v"] == r["back"] and int(r["d"]) == r["v"] % 2**64 for r in got)
    assert [r["v"] for r in df.orderBy(scalars.unsigned_order(F.col("v"))).collect()] == sorted(values, key=lambda v: v % 2**64)
    bad = spark.createDataFrame([("18446744073709551616",), ("x",), (None,)], "d string").select(scalars.from_unsigned(F.col("d"))).collect()
    assert all(r[0] is None for r in bad)


def test_jaccard_and_hamming(spark):
    df = spark.createDataFrame([("甲乙丙丁戊己", "甲乙丙丁戊庚"), ("", ""), ("", "a")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(scalars.jaccard(text.ngrams(F.col("a")), text.ngrams(F.col("b")))).collect()] == [0.333333, 1.0, 0.0]
    assert [round(r[0], 6) for r in df.select(text.jaccard_texts(F.col("a"), F.col("b"))).collect()] == [0.333333, 1.0, 0.0]
    one = spark.createDataFrame([(-1, 0, 0, 0)], "a long, b long, c long, d long")
    assert one.select(scalars.hamming(*[F.col(c) for c in "abcd"])).first()[0] == 64


def test_days(spark):
    at = spark.createDataFrame([("2026-07-15 16:30:00",)], "s string").select(F.col("s").cast("timestamp").alias("t"))
    row = at.select(scalars.day_bucket(F.col("t")), scalars.query_buckets(F.col("t"), 3), scalars.bucket_expiry(F.col("t"), 3, 2).cast("string")).first()
    assert row[0] == "d20260716" and row[1] == ["d20260716", "d20260715", "d20260714"] and row[2] == "2026-07-21 16:00:00"


def test_validators(spark):
    assert scalars.valid_generation("g000001") == "g000001"
    for bad in ("../bad", "g1", ""):
        with pytest.raises(ValueError):
            scalars.valid_generation(bad)
    with pytest.raises(ValueError):
        Params(minhash_bands=16)
    df = spark.createDataFrame([("A" * 32,), ("a" * 31,), (None,)], "h string")
    assert [r[0] for r in df.select(scalars.hash_hex(F.col("h"))).collect()] == ["a" * 32, None, None]
    with pytest.raises(Exception, match="no hash"):
        df.select(scalars.hash_hex(F.col("h"), strict=True)).collect()
    short = spark.createDataFrame([([1, 2],)], "s array<long>")
    with pytest.raises(Exception, match="too short"):
        short.select(hashing.minhash_bands(F.col("s"))).collect()


def test_low_information(spark):
    rows = [("短文本", True), ("这是一段长度足够并且包含很多汉字用于验证低信息文本判定规则是否一致的测试内容", False), ("[哈][哈]" * 10, True), (None, True), ("。" * 40, True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(text.low_information(F.col("t")).alias("got"), "want").toPandas()
    assert isinstance(got, pd.DataFrame) and (got["got"] == got["want"]).all()


def test_registered_functions(spark):
    from twinsieve.functions.register import register

    assert "dedupe_bands" in register(spark)
    row = spark.sql("SELECT dedupe_normalize('测试 123 新闻'), dedupe_blake2b8('abc'), dedupe_jaccard('甲乙丙丁戊己', '甲乙丙丁戊庚'), dedupe_fingerprint('hello').simhash_hi").first()
    assert row[0] == "测试新闻" and row[1] == "d8bb14d833d59559" and abs(row[2] - 1 / 3) < 1e-9 and row[3] == hashing.fingerprint_of("hello")[0]
    bands = spark.sql("SELECT t.doc, b.* FROM VALUES (1, 'hello') AS t(doc, text), LATERAL dedupe_bands(t.text) b").collect()
    assert len(bands) == 40 and [r["band_value"] for r in bands if r["kind"] == "minhash"][0] % 2**64 == 13272477789874919601


def test_metrics(spark):
    from twinsieve.operators import metrics

    assert metrics.throughput(1000, 2.0, 1500)["scopes_per_second"] == 750.0 and metrics.throughput(5, 0)["records_per_second"] == 0.0
    assert metrics.progress(50, 200, 10) == {"percent": 25.0, "rows_per_second": 5.0, "seconds_left": 30.0}
    assert metrics.progress(5, 0, 0) == {"percent": None, "rows_per_second": None, "seconds_left": None}
    assert metrics.memory()["peak_mb"] > 1
    df, seen = metrics.observed(spark.range(7), "n", most=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 7, "most": 6}


def test_functions_for_sql_text(spark):
    from twinsieve.functions.register import register

    assert len(register(spark)) == 10
    got = spark.sql("SELECT dedupe_simhash('hello') AS s, dedupe_minhash('hello') AS m, dedupe_uint64_decimals(array(-1L, 0L, null)) AS d, dedupe_jaccard_many('abcdef', array('abcdef', 'xyz', null)) AS j, dedupe_jaccard('', '') AS e").first()
    assert got["s"] == GOLDEN[1][2] and (got["m"][0], got["m"][31]) == (str(GOLDEN[1][3]), str(GOLDEN[1][4])) and len(got["m"]) == 128
    assert got["d"] == ["18446744073709551615", "0", None] and got["j"] == [1.0, 0.0, 0.0] and got["e"] == 1.0


def test_verification_of_both_scopes(spark):
    import hashlib

    from twinsieve.operators.fingerprint import report, verify

    hi, lo, signature = hashing.fingerprint_of("标题")
    scope = ("标题", 2, True, hashlib.md5("标题".encode()).hexdigest(), f"{hi & (1 << 64) - 1:016x}{lo & (1 << 64) - 1:016x}", [(i, int(v)) for i, v in enumerate(signature[:32].view("int64"))])
    raw = hashlib.md5("title\x1f标题\x1econtent\x1f".encode()).hexdigest()
    kind = "struct<text:string,text_len:int,low_information:boolean,exact_hash:string,simhash_hex:string,minhash_bands:array<struct<band_index:int,band_value:bigint>>>"
    schema = f"doc_pk long, canonical_input struct<title:string,content:string>, expected_from_canonical_input struct<raw_hash_hex:string,content_hash_hex:string,title_hash_hex:string,normalized_title:string,normalized_content:string,primary_text:string,content_scope:{kind},title_scope:{kind}>"
    row = lambda pk, title_scope: (pk, ("标题", None), (raw, None, scope[3], "标题", "", "标题", scope, title_scope))
    wrong = (*scope[:4], "0" * 32, scope[5])
    got = {r["doc_pk"]: r for r in verify(spark.createDataFrame([row(1, scope), row(2, wrong), row(3, None), (4, ("x", None), None)], schema)).collect()}
    assert {k: (r["first_mismatch"], r["title_checked"]) for k, r in got.items()} == {1: (None, True), 2: ("title_scope.simhash_hex", True), 3: (None, False)}
    out = report(spark.createDataFrame([(7, "text"), (1, None), (2, "x")], "doc_pk long, first_mismatch string"), started=0.0).first()
    assert (out["records"], out["failure_count"], out["status"], out["failures"]) == (3, 2, "failed", [2, 7]) and out["records_per_second"] >= 0 and out["peak_mb"] > 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1)), min_size=40, max_size=80))
def test_unsigned_arithmetic(spark, pairs):
    pairs += [(-1, -1), (0, -1), (-(2**63), 2), (2**63 - 1, 1), (-(2**63), -(2**63))]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", scalars.add_u64(a, b).alias("s"), scalars.multiply_u64(a, b).alias("m"), scalars.less_u64(a, b).alias("l"), scalars.rotate_right_u64(a, 13).alias("r"))
    whole = 2**64
    for r in got.collect():
        x, y = r["a"] % whole, r["b"] % whole
        assert (r["s"] % whole, r["m"] % whole, r["l"]) == ((x + y) % whole, x * y % whole, x < y)
        assert r["r"] % whole == (x >> 13 | x << 51) % whole


def test_bands_of_requests_and_names(spark):
    rows = [("simhash", 7, "fFfF", 65535), ("simhash", 0, "0", 0), ("simhash", 8, "1", None), ("simhash", 1, "12345", None), ("simhash", 1, "g", None), ("minhash", 31, "18446744073709551615", -1), ("minhash", 0, "18446744073709551616", None),
            ("minhash", 32, "1", None), ("minhash", 0, "-1", None), ("other", 0, "1", None), ("simhash", 0, None, None)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "kind string, i int, v string, want long, n int")
    for r in df.select("n", "want", scalars.parse_band(F.col("kind"), F.col("i"), F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"], rows[r["n"]]
    assert scalars.index_key(" dedupe: ", "g000001", "minhash", "content", "d20260716", "b3") == "dedupe:g000001:minhash:content:d20260716:b3"
    for bad in (("", "g000001"), ("a/b", "g000001"), ("a", "../bad"), ("a", "g000001", "d2026"), ("a", "g000001", "x y")):
        with pytest.raises(ValueError):
            scalars.index_key(*bad)
