"""Every registered plan against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest
from conftest import SMALL

from rankprep import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(told, v)) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan(spark, con, name):
    df = plans.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted("|".join(told(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in plans.ORACLE_SQL:
        cur = con.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted("|".join(told(r[i]) for i in at) for r in cur.fetchall())
