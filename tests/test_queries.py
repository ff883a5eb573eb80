"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = entry.queries()[name](spark, sf_dir)
    wanted = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, wanted.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "bucket" in found.columns


def test_every_query_reads_the_tables(sf_dir):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 38
