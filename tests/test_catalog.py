"""Queries against DuckDB on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from variorum import catalog, catalog_more  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
#: Of the queries over whole comparisons, doc_stats, section_alignment, report_rows and status_lists are enough here.
SLOW = {"detail_rows", "section_counts", "preview_rows", "summary_cards"}
TABLES = "customer supplier part orders lineitem documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or pd.isna(x) else f"{x:.6f}" if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_oracle(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["pair_id", "status", "rows"]
