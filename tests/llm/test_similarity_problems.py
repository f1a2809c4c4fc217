import random

import pytest
from pyspark.sql import functions as F

from twinsieve.functions.hashing import gram_list
from twinsieve.functions.text import normalize
from twinsieve.llm import history, queries, simjoin


def j(a, b):
    x, y = set(gram_list(a)), set(gram_list(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus(seed, count=220):
    r = random.Random(seed)
    words = ["甲乙丙", "山水", "abc", "订单已经发货", "请尽快", "xyz12", "今天天气", "好", "电影票", "。"]
    texts = []
    for _ in range(count):
        if texts and r.random() < 0.6:
            t = list(r.choice(texts))
            for _ in range(r.randrange(6)):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randrange(3)] = r.choice(words) if r.random() < 0.5 else ""
            texts.append("".join(t) or "空")
        else:
            texts.append("".join(r.choices(words, k=r.randrange(1, 25))))
    return texts


@pytest.mark.parametrize("threshold,block", [(0.5, 2048), (0.8, 2048), (0.3, 4)])
def test_join_against_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    texts = corpus(3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, texts[0]), (5, texts[5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, text string, id int")
    links, members, classes = simjoin.near_duplicates(df, "k", "text", threshold)
    got = [(r[0], r[1]) for r in simjoin.expand_links(links, members, "k").collect()]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if j(texts[a], texts[b]) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want
    assert classes.count() == len(set(texts))
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    rows = {r["k"]: r for r in simjoin.grouped(links, members, "k").collect()}
    assert {k: r["group_id"] for k, r in rows.items()} == dict(enumerate(label))
    for k, r in rows.items():
        assert r["n_links"] == len({texts[b if a == k else a] for a, b in want if k in (a, b)} - {texts[k]})


def test_join_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "长" * 60000 + "尾"), (2, "长" * 60000 + "尾巴"), (3, "短")], "k long, text string")
    links, members, _ = simjoin.near_duplicates(df, "k", "text", 0.5)
    assert [(r[0], r[1]) for r in simjoin.expand_links(links, members, "k").collect()] == [(1, 2)]
    assert simjoin.near_duplicates(df.limit(0), "k", "text")[0].count() == 0


def sequential(stored, requests):
    accepted, found = [t for t in stored if t], set()
    for n, t, ins in sorted({(n, t or "", bool(i)) for n, t, i in requests if n is not None}):
        if not t:
            continue
        if any(j(t, a) >= 0.5 for a in accepted):
            found.add(n)
        elif ins:
            accepted.append(t)
    return found


@pytest.mark.parametrize("seed,block", [(11, 8192), (12, 3)])
def test_history_against_sequential_checks(spark, seed, block, tmp_path, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    r = random.Random(seed)
    texts = corpus(seed, 150)
    stored, rest = texts[:40], texts[40:]
    requests = [(n, r.choice([t, r.choice(texts)]), r.choice([True, True, False, None])) for n, t in enumerate(rest)] + [(900, None, True), (901, "", True)]
    requests += requests[:10] + [(None, texts[0], True)]
    df = spark.createDataFrame(requests, "request_no long, text string, insert boolean")
    held = spark.createDataFrame(list(enumerate(stored)) + [(99, None), (98, "")], "id long, text string")
    want = sequential(stored, requests)
    whole = history.History(spark, held).check(df)
    assert {x[0] for x in whole.filter("duplicate").collect()} == want and whole.count() == len(rest)
    # Cut into batches, with what was accepted in between, the marks are the same; so they are after a change of order.
    h, got = history.History(spark, held, path=str(tmp_path / "history")), set()
    for n, (a, b) in enumerate(((0, 35), (35, 70), (70, 1000))):
        h.close()
        h = history.History.open(spark, str(tmp_path / "history"))
        if n == 2:
            h._order_anew(h.texts.read())
        got |= {x[0] for x in h.check(df.filter((F.col("request_no") >= a) & (F.col("request_no") < b))).filter("duplicate").collect()}
    assert got == want
    assert h.check(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        history.History(spark, held, path=str(tmp_path / "history"))
    h.close()


def test_history_is_not_shuffled(spark):
    texts = corpus(4, 60)
    h = history.History(spark, spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    classes = spark.createDataFrame([(2 * i + 1, t) for i, t in enumerate(corpus(5, 30))], "id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plans = {h.marks: h.covered(h._marks(classes)), h.grams: h.near(h._grams(classes), 30), h.texts: h._with_texts(classes.selectExpr("id as a", "id - 1 as b"), classes)}
    texts_of = {t: p._jdf.queryExecution().executedPlan().toString() for t, p in plans.items()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for held, plan in texts_of.items():
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if held.name in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < level:
                level = depth(line)
                above.append(line.strip(" :+-"))
        joined = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any(line.startswith("Exchange") for line in above[:joined]), plan
    h.close()


def test_history_is_not_sorted(spark):
    """A batch that fits in memory bucket by bucket meets marks, grams and texts of the history as they are read; others are sorted."""
    h = history.History(spark, spark.createDataFrame(list(enumerate(corpus(4, 60))), "id long, text string"))
    classes = spark.createDataFrame([(2 * i + 1, t) for i, t in enumerate(sorted(set(corpus(5, 30))))], "id long, text string")
    marks, grams = h._marks(classes), h._grams(classes)
    pairs = classes.selectExpr("id as a", "id - 1 as b")
    many = h.grams.rows_per_bucket * h.grams.buckets + 1
    plans = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    for name, held, rows in (
        ("marks", h.marks, h.covered(marks, marks.count())), ("grams", h.grams, h.near(grams, 30, grams.count())), ("texts", h.texts, h._with_texts(pairs, classes)),
        ("unknown", h.grams, h.near(grams, 30)), ("many", h.grams, h.near(grams, 30, many)),
    ):
        lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        at = next(i for i, line in enumerate(lines) if held.name in line)
        above, level = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < level:
                level = depth(line)
                above.append(line.strip(" :+-"))
        joined = next(i for i, line in enumerate(above) if "Join" in line)
        plans[name] = (above[joined].split()[0], any(line.startswith("Sort ") for line in above[:joined]))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hashed, sorted_ = ("ShuffledHashJoin", False), ("SortMergeJoin", True)
    assert plans == {"marks": hashed, "grams": hashed, "texts": hashed, "unknown": sorted_, "many": sorted_}
    assert h.near(grams, 30, grams.count()).exceptAll(h.near(grams, 30)).isEmpty() and h.near(grams, 30).exceptAll(h.near(grams, 30, grams.count())).isEmpty()
    assert "SORTED BY" not in spark.sql(f"SHOW CREATE TABLE {h.grams.name}").first()[0]
    h.close()


def test_accepted_texts_of_earlier_batches_are_met_by_their_grams(spark):
    """An edit in every sentence leaves no mark equal, so only prefix grams find the text that the first batch left."""
    first = "。".join("".join(random.Random(i).choices("甲乙丙丁戊己庚辛壬癸子丑寅卯", k=30)) for i in range(12))
    edited = "。".join(x[:15] + "改" + x[16:] for x in first.split("。"))
    assert 0.5 <= j(first, edited) < 0.9
    h = history.History(spark, spark.createDataFrame([(1, "完全不同的一篇文章")], "id long, text string"))
    batch = lambda n, t: h.check(spark.createDataFrame([(n, t, True)], "request_no long, text string, insert boolean")).first()["duplicate"]
    assert h.covered(h._marks(spark.createDataFrame([(1, edited)], "id long, text string"))).count() == 0
    assert (batch(1, first), batch(2, edited), batch(3, first)) == (False, True, True)
    h.close()


def test_batches_in_order():
    assert queries._in_order([(50, 60, 3), (1, 9, 1), (10, 30, 2), (25, 40, None)]) == [[1], [2, None], [3]]


def test_hot_grams_are_counted_exactly(spark):
    """A gram is cut into blocks by its own postings, whatever the sketch says: 1.0 postings per prefix gram where none is hot."""
    rows = [(g, i, i) for g in range(300) for i in range(4)] + [(1000, i, i) for i in range(50)]
    postings = spark.createDataFrame(rows, "gram long, id long, at long").withColumn("hot", F.lit(True))  # a sketch that is full
    out = simjoin.spread_hot(postings, 20)
    assert simjoin.spread_hot(postings.filter("gram < 1000"), 20).count() == 1200
    placed = out.groupBy("gram").agg(F.collect_set("id").alias("ids")).collect()
    assert max(len(r["ids"]) for r in placed) < 50 and out.count() == 1200 + 2 * 50
    met = {(a, b) for r in placed for a in r["ids"] for b in r["ids"] if a < b and len(r["ids"]) > 4}
    assert met == {(a, b) for a in range(50) for b in range(a + 1, 50)}


def test_p3_and_p4_on_the_tables(spark, sf, duck):
    stored = [t for (t,) in duck.execute("SELECT primary_text FROM texts").fetchall()]
    rows = duck.execute("SELECT request_no, title, content, insert_on_check FROM check_request").fetchall()
    want = sequential(stored, [(n, normalize(c) or normalize(t), i) for n, t, c, i in rows])
    assert {r[0] for r in queries.p3_found(spark, sf).collect()} == want
    texts = {k: normalize(c) or normalize(t) for k, t, c in duck.execute("SELECT doc_pk, canonical_input.title, canonical_input.content FROM baseline_record").fetchall()}
    texts = sorted((k, t) for k, t in texts.items() if t)
    want = {(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if j(x, y) >= 0.5}
    assert {tuple(r) for r in queries.p4_found(spark, sf).collect()} == want
