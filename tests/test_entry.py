import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from kinmatch.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbdt_out_of_fold", "prefix_policy"}


def names():
    return sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(pdf):
    def show(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.7g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(show(x) for x in r) for r in pdf[cols].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert registry.queries().keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, db, name):
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(entry.oracle_sql()[name]).df())


def test_queries_without_sql_run(spark):
    left = [n for n in registry.queries() if n not in registry.oracle_sql() and n not in SLOW]
    for n in left:
        entry.queries()[n](spark, DATA).count()
