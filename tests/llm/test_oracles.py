import pytest

from clickloom.llm import queries as Q

from ..oracle import connect, same

ORACLE = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, name):
    same(Q.queries()[name](spark, sf), connect(sf), ORACLE[name])
