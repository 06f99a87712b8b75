from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from workload.views import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo", "path", "score", "import_count", "imported_by_count"]


@pytest.mark.parametrize("name", [
    "c7_filter_by_path", "d7_resolve_imports", "e4_external_dependents", "f2_update_graph", "h1_pack_tasks", "i7_cycle_members", "i14_validate_map", "k5_file_context",
])
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(names).collect()) == want
