"""A sample of the registered queries against their oracles on the smallest tables."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["flagship_normalize_orders", "m09_cascade", "e01_wide_records", "e07_broken_table", "s06_pdf_records", "t02_route", "t04_chunks",
          "t06_chunked_extraction", "x04_x05_salvage", "k01_output_projection"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_query_has_an_oracle_but_the_listed():
    from __spark_entry__ import oracle_sql, queries
    from suite.registry import QUERIES
    assert set(QUERIES) <= set(queries()) and not set(QUERIES) - set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_the_entry_loads_without_a_session():
    code = "from __spark_entry__ import oracle_sql, queries; print(len(queries()), len(oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from check import rows
    from suite.registry import TABLES
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries()[name](spark, FOLDER)
    want = duck.execute(oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall())
