"""The SQL of the queries against their rows on the smallest tables, where DuckDB and the tables are there."""

import glob
import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
NAMES = ["p7_found", "p7_aliases", "chunk", "page_text", "parse_relations", "nodes_g1", "graph_json", "ho_nodes", "qa_bleu", "qa_best", "normalize_answer", "p6_found"]


def _row(row, cols):
    return repr([round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v for v in (row[c] for c in cols)])


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sql = entry.oracle_sql().get(name)
    if sql is None:
        pytest.skip("belongs to the optional subpackage")
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    df, want = entry.queries()[name](spark, D), con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(_row(r, cols) for r in df.collect()) == sorted(_row(dict(zip(want.columns, r)), cols) for r in want.fetchall())
