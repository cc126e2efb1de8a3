"""Every registered query of the library against its DuckDB twin, on the smallest driver tables."""

import os

import duckdb
import pytest

from strandline import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer events embeddings orders part supplier".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("float"):
            frame = frame.assign(**{c: frame[c].round(6) + 0.0})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    frame = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(frame)
        return
    got = ordered(frame)
    want = ordered(duck.execute(catalogue.ORACLES[name]).fetch_df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert (got[c].fillna("~").astype(str) == want[c].fillna("~").astype(str)).all(), c
        else:
            assert (got[c].isna() == want[c].isna()).all() and ((got[c].astype(float) - want[c].astype(float)).abs().fillna(0) < 2e-6).all(), c
