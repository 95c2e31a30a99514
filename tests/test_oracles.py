"""Every query with SQL against DuckDB on a small cut of the driver tables."""

from collections import Counter

import duckdb
import pytest
from pergament.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CUT = {"orders": "o_orderkey < 500", "lineitem": "l_orderkey < 500", "documents": "doc_id < 30", "pages": "page_id < 30", "embeddings": "vec_id < 120", "customer": "true", "nation": "true", "part": "true"}


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    for name, keep in CUT.items():
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{name}.parquet' WHERE {keep}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{float(value):.6g}" if isinstance(value, int) else str(value)


def bag(rows):
    return Counter(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in CUT:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got = QUERIES[name](spark, small)
    quoted = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert len(want) > 0
    assert bag(got.collect()) == bag(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_line_pairs_cross_word_six(spark, small):
    found = {(r["box"] % 100_000, r["other"] % 100_000) for r in QUERIES["b16_right_of"](spark, small).collect()}
    assert (5, 6) in found and (11, 12) in found
