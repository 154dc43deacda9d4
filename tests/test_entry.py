"""The driver contract, and a few queries beside their SQL where the driver's tables are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(q.__doc__ for q in entry.queries().values())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["kmer_count", "kmers_color", "multi_filter_stats", "bray_curtis", "dbg_edges", "features", "stream_days"])
def test_queries_beside_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    want = con.sql(entry.oracle_sql()[name])
    key = lambda row: tuple("" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
