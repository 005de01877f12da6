"""Every catalogue query against its oracle SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    found = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = in_order([tuple(plain(x) for x in r) for r in found.fetchall()])
    assert in_order([tuple(plain(r[c]) for c in names) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
