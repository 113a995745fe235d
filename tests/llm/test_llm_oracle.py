"""The operators' queries against their DuckDB SQL at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from souk.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", ORACLE_SQL)
def test_matches_oracle(spark, con, key):
    got, want = QUERIES[key](spark, SF).toArrow(), con.sql(ORACLE_SQL[key]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    rows = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in cols)), key=repr)
    assert rows(got) == rows(want)


def test_entry_registers_the_operators_and_the_pipeline():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
