"""Every core query that has SQL gives the same rows as DuckDB."""

import pytest

from shardloom.queries import core
from tests.conftest import rows_of

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = core.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows_of(got) == rows_of(want)
