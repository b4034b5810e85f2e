"""Every registered query of the table operators against its SQL, with DuckDB, on small tables."""

import datetime
import math

import duckdb
import pytest

from weft.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [[repr(plain(r[c])) for c in columns] for r in df.collect()]
    assert sorted(rows) == sorted([repr(plain(v)) for v in r] for r in want.fetchall())
