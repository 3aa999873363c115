"""Every catalogue query against its SQL on the smallest test tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(list(map(plain, v))) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalogue.SQL:
        cur = duck.execute(catalogue.SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["nb_name", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
