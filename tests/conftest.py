import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shardloom.session import local_session

    s = local_session(4, 4, "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def rows_of(pdf):
    """Rows of a pandas frame as comparable tuples, columns sorted by name."""
    pdf = pdf[sorted(pdf.columns)].astype(object)
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, float) else x
    return sorted(map(str, (tuple(clean(x) for x in r) for r in pdf.itertuples(index=False))))
