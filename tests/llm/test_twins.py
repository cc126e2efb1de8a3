"""The queries that SQL can express against their DuckDB twins, on the smallest driver tables and on nasty rows."""

import os

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark".split()


@pytest.fixture(scope="module")
def nasty(spark, tmp_path_factory):
    """Nulls, empty texts, repeated rows and ids, near copies, signs and letters of all kinds."""
    at = str(tmp_path_factory.mktemp("sf"))
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (3, 30, 59)]
    texts = [None, "", " \t\r\n", "One", "one", "ONE two", " ".join(base), *near, " ".join(base), "ÀÉ ß İ a_b c\x0bd", "😀 " * 9, "the same line\n" * 40, "A-b C.d E/f " * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, " ".join(base)), (7, near[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(base[10:25])), (2, "one"), (3, None), (4, "..."), (5, "a b c d e f a b c"), (10, "W20 w21, w22 w23 w24 w25 w26 w27"), (None, "two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "u", None), (2, "u", "x" * 99), (3, None, "x" * 99), (5, "u", "é" * 50), (4, "u", "é" * 50), (6, "u", "é" * 50 + "\r\n\r\n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("driver", [False, True])
def test_twin(spark, nasty, name, driver):
    if driver and not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    folder, con = SF if driver else nasty, duckdb.connect()
    for t in TABLES:
        files = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}{'/*.parquet' if os.path.isdir(files) else ''}'")
    found = queries.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want))
