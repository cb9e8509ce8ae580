import pytest
from oracle import connect, same

from granary import queries


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, sf, db, name):
    same(queries.queries()[name](spark, sf), db, queries.oracle_sql()[name])
