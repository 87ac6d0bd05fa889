"""Every query with an oracle matches DuckDB at sf0.001 (row count, column
names, order-insensitive values rounded to 6 places)."""

import duckdb
import pytest

import __spark_entry__ as entry
from basketlens.sources.tables import TABLES
from tools.check_oracle import digest

from .conftest import SF_SMALL

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(ORACLES[name]).df()
    assert digest(sp, False) == digest(dk, False)


def test_every_query_runs_and_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    for name in sorted(set(entry.queries()) - set(ORACLES)):
        assert entry.queries()[name](spark, SF_SMALL).count() >= 0, name
