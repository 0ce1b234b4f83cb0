import pytest

from clickloom import queries as Q

from .oracle import connect, same

ORACLE = Q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    same(Q.queries()[name](spark, sf), con, ORACLE[name])


def test_sample_is_a_part(spark, sf):
    n = Q.queries()["bernoulli_sample"](spark, sf).count()
    assert 0 < n < Q.acts(spark, sf).count() / 2


def test_entry_module(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
