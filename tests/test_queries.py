"""Every registered query of the library against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from quillstone.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

TABLES = "documents pages labels conversations events orders lineitem".split()


def cell(x):
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    with duckdb.connect() as con:
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        found = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        want = Counter(tuple(map(cell, r)) for r in found.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(cell, r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
