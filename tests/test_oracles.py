import pytest

from tests.oracle import compare
from textmill.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tiny, name):
    compare(spark, tiny, catalogue.queries()[name], SQL[name])


def test_every_query_without_sql_is_tested_otherwise():
    assert set(catalogue.queries()) - set(SQL) == {"q_minhash_pairs", "q_minhash_keep"}
