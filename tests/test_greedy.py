import random

import pytest

from twinsieve import session
from twinsieve.operators.bucketed import BucketedTable
from twinsieve.operators.greedy import first_wins, first_wins_of_few


def plain(nodes, links, asks, holds):
    taken, values = [], set()
    for i, _ in sorted(nodes, key=lambda x: x[1]):
        if not any((i, k) in links or (k, i) in links for k in taken) and not any(v in values for v in asks.get(i, ())):
            taken.append(i)
            values.update(holds.get(i, ()))
    return sorted(taken)


@pytest.mark.parametrize("at_once", [1 << 20, 6])
def test_first_wins(spark, at_once):
    r = random.Random(2)
    nodes = [(i, i * 3 % 101) for i in range(60)]
    links = {(r.randrange(60), r.randrange(60)) for _ in range(60)} | {(3, 500), (3, 3)}
    asks = {i: [f"v{r.randrange(25)}"] for i in range(0, 60, 2)}
    holds = {i: [f"v{r.randrange(25)}", f"own{i}"] for i in range(60)}
    flat = lambda d: spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs] + [(1, None)], "id long, value string")
    df = spark.createDataFrame(nodes, "id long, rank long")
    got = first_wins(df, spark.createDataFrame(sorted(links), "a long, b long"), flat(asks), flat(holds), at_once)
    assert sorted(x["id"] for x in got.collect()) == plain(nodes, links, asks, holds)
    few = first_wins_of_few(df, spark.createDataFrame(sorted(links), "a long, b long")).collect()
    assert sorted(x["id"] for x in few) == plain(nodes, links, {}, {}) and all((x["id"], x["rank"]) in nodes for x in few)
    assert first_wins(df.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [1 << 20, 2100])
def test_a_chain_takes_one_walk(spark, at_once):
    """1,000 versions, each linked to the one before: beyond at_once the rounds end with the components."""
    nodes = [(i, i) for i in range(1100)]
    links = [(i, i + 1) for i in range(999)] + [(1000 + i, 1001 + i) for i in range(0, 99)] + [(i, i + 2) for i in range(998)]
    got = first_wins(spark.createDataFrame(nodes, "id long, rank long"), spark.createDataFrame(links, "a long, b long"), at_once=at_once)
    assert sorted(x["id"] for x in got.collect()) == plain(nodes, set(links), {}, {})


def test_bucketed_table(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "k BIGINT, v STRING", ["k"], rows_per_bucket=50, merge_after=3)
    assert table.read().count() == 0
    for i in range(5):
        table.append(spark.range(i * 200, i * 200 + 200).selectExpr("cast(id as string) as v", "id as k"))
    assert table.read().count() == 1000 == table.rows and table.buckets > 4
    asked = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    met = table.placed(asked).join(table.read(), "k")
    plan = met._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and met.count() == 143
    again = BucketedTable(spark, f"file://{tmp_path}/t", "k BIGINT, v STRING", ["k"])
    assert again.buckets == table.buckets and again.rows == 1000
    again.append(spark.range(5, 6).selectExpr("id as k", "'x' as v"))
    assert again.read().count() == 1001
    table.drop()
    again.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in (table.name, again.name)]


def test_scopes_delete_what_they_wrote(spark):
    with session.scope(spark) as keep:
        gone = session.written(spark.range(3), "gone")
        stays, n = session.counted(spark.range(5).filter("id > 9"), "stays")
        keep(stays)
    assert n == 0 and stays.count() == 0
    with pytest.raises(Exception):
        gone.count()
    with session.in_one_go(spark, 10, 100):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false" and spark.conf.get("spark.sql.shuffle.partitions") == "1"
    with session.in_one_go(spark, 1000, 100):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
