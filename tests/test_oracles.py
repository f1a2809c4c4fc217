import pytest
from compare import same

from twinsieve.plans.oracles import ORACLES
from twinsieve.plans.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
