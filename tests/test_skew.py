from collections import defaultdict

from pyspark.sql import functions as F

from twinsieve.operators import skew


def skewed(spark):
    rows = [("hot", i % 700) for i in range(4000)] + [("hot2", i) for i in range(2000)] + [(f"k{i % 50}", i % 90) for i in range(600)] + [(None, 1), (None, 1), (None, None), ("only-null", None)]
    return spark.createDataFrame(rows, "k string, v int"), rows


def test_salted_count_distinct(spark):
    df, rows = skewed(spark)
    want = defaultdict(set)
    for k, v in rows:
        want[k] |= {v} - {None}
    got = skew.salted_count_distinct(df.withColumn("n_rows", F.lit("clash")), ["k"], "v", salts=8, limit=16, at_least=100)
    assert {r["k"]: r["n_distinct"] for r in got.collect()} == {k: len(v) for k, v in want.items()}
    heavy = {r["k"] for r in skew.heavy_keys(df, ["k"], limit=16, at_least=100).collect()}
    assert heavy == {"hot", "hot2"}
    assert skew.salted_count_distinct(df.limit(0), ["k"], "v").count() == 0


def test_attach_by_key(spark):
    df, rows = skewed(spark)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    got = skew.attach_by_key(df, per_key, ["k"], "n", limit=16, at_least=100).toPandas()
    assert len(got) == sum(k is not None for k, _ in rows)
    assert dict(zip(got["k"], got["n"])) == {r["k"]: r["n"] for r in per_key.collect() if r["k"] is not None}
    assert skew.attach_by_key(df.limit(0), per_key, ["k"], "n").count() == 0
    assert skew.attach_by_key(df, per_key.limit(0), ["k"], "n").count() == 0


def test_pairs_within_groups(spark):
    rows = [("a", i) for i in range(40)] + [("b", 100), ("c", 7), ("c", 9), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, i int")
    sized = skew.attach_by_key(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), ["g"], "n")
    got = [(r["g"], r["i_a"], r["i_b"]) for r in skew.pairs_within_groups(sized, "g", "i", "n", block=8).collect()]
    want = {(g, a, b) for g, a in rows for h, b in rows if g is not None and g == h and a < b}
    assert len(got) == len(want) and set(got) == want
