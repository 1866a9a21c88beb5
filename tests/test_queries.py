"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


#: Queries that may have no rows on tables this small.
SPARSE = {"callers", "callees", "neighbours", "leaf_nodes", "exact_name"}


def rows(names, records):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(r[i] for i in order)) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert want or name in SPARSE
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
