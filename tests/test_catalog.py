"""Every query with SQL gives DuckDB's rows; every query gives some."""

import duckdb
import pandas as pd
import pytest

from resonant.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        for df in (got, want):
            df.sort_values(columns, inplace=True, ignore_index=True)
        for c in columns:
            x, y = got[c].astype(object), want[c].astype(object)
            both = (x == y) | (x.isna() & y.isna())
            assert len(x) == len(y) and both.fillna(False).all(), f"{c}: {pd.DataFrame({'got': x, 'want': y})[~both].head()}"


def test_every_query_but_the_sequential_ones_has_sql():
    without = set(QUERIES) - set(ORACLES)
    assert without == {"grfnn_bank", "motor_coupled", "delay_noise", "gammatone_envelope", "voice_tracking", "voice_timeline", "mode_locks_bulk", "motor_batched", "engine_snapshots", "tracked_voice_messages"}
