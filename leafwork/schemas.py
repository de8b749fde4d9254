"""Schemas of the landed tables, as DDL. Always read with these; nothing is inferred."""

from __future__ import annotations

USER = "STRUCT<id: STRING, type: STRING, name: STRING, person: STRUCT<email: STRING>>"
PARENT = (
    "STRUCT<type: STRING, page_id: STRING, database_id: STRING, data_source_id: STRING, "
    "block_id: STRING, workspace: BOOLEAN, space_id: STRING>"
)
ICON = "STRUCT<type: STRING, emoji: STRING, external: STRUCT<url: STRING>, file: STRUCT<url: STRING>>"
SPAN = (
    "STRUCT<type: STRING, plain_text: STRING, href: STRING, annotations: STRUCT<bold: BOOLEAN, "
    "italic: BOOLEAN, strikethrough: BOOLEAN, underline: BOOLEAN, code: BOOLEAN, color: STRING>, "
    f"mention: STRUCT<type: STRING, user: {USER}>>"
)
_OPTION = "STRUCT<name: STRING>"
_DATE = "STRUCT<start: STRING, `end`: STRING, time_zone: STRING>"
_REF = "STRUCT<id: STRING>"
PROPERTY = (
    f"STRUCT<type: STRING, title: ARRAY<{SPAN}>, rich_text: ARRAY<{SPAN}>, number: DOUBLE, "
    f"select: {_OPTION}, multi_select: ARRAY<{_OPTION}>, status: {_OPTION}, date: {_DATE}, "
    "checkbox: BOOLEAN, url: STRING, email: STRING, phone_number: STRING, "
    f"people: ARRAY<{_REF}>, relation: ARRAY<{_REF}>, "
    f"rollup: STRUCT<type: STRING, number: DOUBLE, date: {_DATE}>, "
    f"formula: STRUCT<type: STRING, string: STRING, number: DOUBLE, boolean: BOOLEAN, date: {_DATE}>, "
    f"created_by: {_REF}, last_edited_by: {_REF}, created_time: STRING, last_edited_time: STRING, "
    "unique_id: STRUCT<prefix: STRING, number: BIGINT>>"
)
PAGE = (
    "object STRING, id STRING, created_time TIMESTAMP, last_edited_time TIMESTAMP, "
    f"created_by {USER}, last_edited_by {USER}, parent {PARENT}, archived BOOLEAN, "
    f"in_trash BOOLEAN, icon {ICON}, properties MAP<STRING, {PROPERTY}>, url STRING"
)
ENTRY = PAGE + ", position BIGINT"
CONTAINER = (
    "id STRING, created_time TIMESTAMP, last_edited_time TIMESTAMP, "
    f"created_by {USER}, last_edited_by {USER}, title ARRAY<{SPAN}>, description ARRAY<{SPAN}>, "
    f"icon {ICON}, parent {PARENT}, url STRING, archived BOOLEAN, in_trash BOOLEAN, "
    "data_sources ARRAY<STRUCT<id: STRING, name: STRING>>"
)
DATA_SOURCE = f"id STRING, name STRING, title ARRAY<{SPAN}>, description ARRAY<{SPAN}>, url STRING"
# `ordinal` is the 0-based place in the parent's list; `parent_id` is the page for top-level blocks
BLOCK = (
    "page_id STRING, block_id STRING, parent_id STRING, ordinal INT, type STRING, "
    f"has_children BOOLEAN, rich_text ARRAY<{SPAN}>, caption ARRAY<{SPAN}>, is_toggleable BOOLEAN, "
    "checked BOOLEAN, language STRING, emoji STRING, external_url STRING, file_url STRING, "
    "name STRING, url STRING, expression STRING, title STRING, table_width INT, "
    f"has_column_header BOOLEAN, cells ARRAY<ARRAY<{SPAN}>>, link_page_id STRING, "
    "link_database_id STRING, payload_present BOOLEAN"
)
REGISTRY = (
    "id STRING, type STRING, folder STRING, file_path STRING, title STRING, "
    "last_edited TIMESTAMP, last_synced TIMESTAMP, is_root BOOLEAN, enabled BOOLEAN, "
    "parent_id STRING, children ARRAY<STRING>, content_hash STRING"
)
CHILDREN = "parent_id STRING, position BIGINT, child_id STRING"
FILES = "id STRING, file_path STRING, source_url STRING, last_synced TIMESTAMP"
FILE_MANIFEST = "file_id STRING, parent_page_id STRING, downloaded_at TIMESTAMP"
USERS = "id STRING, name STRING, type STRING, email STRING, last_fetched TIMESTAMP"
SYNC_STATE = (
    "version INT, folders ARRAY<STRING>, last_pull_time TIMESTAMP, oldest_pull_result TIMESTAMP"
)
QUEUE = (
    "type STRING, folder STRING, pages ARRAY<STRUCT<id: STRING, last_edited: TIMESTAMP>>, "
    "pageIds ARRAY<STRING>, parentId STRING, createdAt TIMESTAMP"
)
EVENT_BODY = (
    "id STRING, type STRING, timestamp STRING, workspace_id STRING, workspace_name STRING, "
    "attempt_number INT, authors ARRAY<STRUCT<id: STRING, type: STRING>>, "
    "entity STRUCT<id: STRING, type: STRING>, data STRUCT<parent: STRUCT<id: STRING, type: STRING>, "
    "updated_blocks ARRAY<STRUCT<id: STRING, type: STRING>>>, verification_token STRING"
)
EVENT = "received_at TIMESTAMP, signature STRING, timestamp STRING, body STRING"
ERRORS = "page_id STRING, status INT, code STRING, no_data_sources BOOLEAN"

INDEX_SCHEMA_VERSION = 1  # fixed value
STATE_VERSION = 3  # fixed value
