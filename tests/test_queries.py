"""Every query with an SQL equivalent gives the same rows in DuckDB on the supplied tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "VARCHAR": "string"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    got = [tuple(r) for r in df.select(*columns).collect()]
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    for d in answer.description:
        assert KINDS[str(d[1])] == kinds[d[0]], d[0]
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in answer.fetchall()]
    assert len(got) == len(want)
    # Sort on the exact columns first, doubles last and coarsened.
    exact = [i for i, c in enumerate(columns) if kinds[c] != "double"]
    loose = [i for i, c in enumerate(columns) if kinds[c] == "double"]

    def order(row):
        return ([(row[i] is None, str(row[i])) for i in exact],
                [(row[i] is None, 0.0 if row[i] is None else round(row[i], 4)) for i in loose])

    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
