"""Registered queries against their SQL twins on the smallest generated tables.

A quick selection runs by default; LEAFWORK_ALL=1 checks every query.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leafwork.catalog.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
QUICK = [
    "root_status", "page_roots", "cleanup_orphans", "block_to_page", "folder_status", "queue_chunks", "queue_budget",
    "queue_remaining", "page_slugs", "page_paths", "render_pages", "render_databases", "entry_properties", "compact_merge",
    "index_lines", "shard_keys", "reindex_latest", "document_diff", "root_text", "attachment_links", "event_queue",
    "event_debounce", "tree_order", "write_set", "queue_log_rows", "commit_log", "render_kinds", "block_depth_limit",
    "attachment_names", "root_queue",
]
NAMES = sorted(QUERIES) if os.environ.get("LEAFWORK_ALL") else QUICK

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="generated tables are missing")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, database, name):
    found = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    got = sorted((tuple(row[c] for c in columns) for row in found.collect()), key=repr)
    cursor = database.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(row[p] for p in places) for row in cursor.fetchall()), key=repr)
    assert got and got == want
