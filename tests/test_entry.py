"""The registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from scoresieve import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def rows_of(rows):
    plain = lambda v: None if v is None or v != v else round(float(v), 8) if isinstance(v, float) else v
    return sorted((tuple(str(plain(v.item() if hasattr(v, "item") else v)) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    assert name in entry.queries()
    if name not in queries.SQL:
        assert got.count() > 0
        return
    want = con.execute(queries.SQL[name]).fetchdf().astype(object)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got.select(*columns).collect()) == rows_of(want[columns].where(want[columns].notna(), None).itertuples(index=False, name=None))
