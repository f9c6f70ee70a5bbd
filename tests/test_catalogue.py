"""Every query with a SQL twin must give the twin's rows on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from cohortlake import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    from check import rows_of

    got = rows_of(catalogue.QUERIES[name](spark, DATA).toArrow())
    want = rows_of(duck.execute(catalogue.ORACLES[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[2] == want[2]


def test_only_fitted_models_lack_a_twin():
    assert all(n.startswith("mod_") for n in set(catalogue.QUERIES) - set(catalogue.ORACLES))
