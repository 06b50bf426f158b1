"""Every registered query of the record engine against its SQL."""

import pytest
from oracle import duck, spark_rows

from ledgerlift.queries import ORACLE_SQL, QUERIES


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck(sf_dir, ORACLE_SQL[name])
