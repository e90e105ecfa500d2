import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 150


@needs_data
def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "gross", "cost", "net", "cs_ric"] and df.count() > 100


@needs_data
@pytest.mark.parametrize("name", ["flagship_weekly_reversal", "f03_rolling_volatility", "l05_book_at_instant",
                                  "x02_relative_wide_universe", "p02_book_wide_universe"])
def test_small_tables_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in entry.queries()[name](spark, SF).collect())
    exp = sorted(tuple(str(v) for v in r) for r in want.select(*cols).fetchall())
    assert got == exp
