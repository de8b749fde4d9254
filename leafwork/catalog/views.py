"""A workspace derived from the generated tables.

Each view is one SQL text that Spark and the checking database both run, so both sides start from
the same rows. `{name}` refers to a generated table or an earlier view.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def key_id(kind: str, value: str) -> str:
    return f"md5(concat('{kind}:', cast({value} as string)))"


def dashed(value: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat(" + ", '-', ".join(f"substr({value}, {a}, {n})" for a, n in cuts) + ")"


# Regions are roots, nations below them, customers below nations, orders below customers. Some
# customers hang on themselves, on each other, on a page that does not exist, or on nothing.
VIEWS: dict[str, str] = {}

VIEWS["fx_region"] = f"""
select {key_id('region', 'r_regionkey')} as id, 'page' as type,
       lower(replace(r_name, ' ', '-')) as folder,
       concat(lower(replace(r_name, ' ', '-')), '/', lower(replace(r_name, ' ', '-')), '.md') as file_path,
       r_name as title, timestamp '2000-01-01 00:00:00' as last_edited,
       case when r_regionkey = 4 then null else timestamp '2000-01-02 00:00:00' end as last_synced,
       true as is_root, r_regionkey % 2 = 0 as enabled, '' as parent_id, r_regionkey
from {{region}}
"""

VIEWS["fx_nation"] = f"""
select {key_id('nation', 'n_nationkey')} as id, 'page' as type, r.folder as folder,
       concat(replace(r.file_path, '.md', ''), '/', lower(replace(n_name, '_', '-')), '.md') as file_path,
       n_name as title, timestamp '2000-02-01 00:00:00' as last_edited,
       timestamp '2000-02-02 00:00:00' as last_synced, false as is_root, false as enabled,
       r.id as parent_id, n_nationkey
from {{nation}} n join {{fx_region}} r on n.n_regionkey = r.r_regionkey
"""

VIEWS["fx_customer"] = f"""
select {key_id('customer', 'c_custkey')} as id, 'page' as type, n.folder as folder,
       concat(replace(n.file_path, '.md', ''), '/', lower(replace(c_name, '#', '')), '.md') as file_path,
       c_name as title, timestamp '2000-03-01 00:00:00' as last_edited,
       timestamp '2000-03-02 00:00:00' as last_synced, false as is_root, false as enabled,
       case when c_custkey % 97 = 0 then {key_id('customer', 'c_custkey + 1')}
            when c_custkey % 97 = 1 then {key_id('customer', 'c_custkey - 1')}
            when c_custkey % 97 = 2 then {key_id('customer', 'c_custkey')}
            when c_custkey % 50 = 0 then {key_id('missing', 'c_custkey')}
            when c_custkey % 211 = 3 then ''
            else n.id end as parent_id, c_custkey
from {{customer}} c join {{fx_nation}} n on c.c_nationkey = n.n_nationkey
"""

VIEWS["fx_customer_row"] = f"""
select {key_id('customer', 'c_custkey')} as id, c_custkey, c_name, concat('+1-', cast(c_custkey as string)) as c_phone, c_mktsegment
from {{customer}}
"""

VIEWS["fx_order"] = f"""
select {key_id('order', 'o_orderkey')} as id, 'page' as type, c.folder as folder,
       concat(replace(c.file_path, '.md', ''), '/order-', cast(o_orderkey as string), '.md') as file_path,
       concat('Order ', cast(o_orderkey as string)) as title,
       cast(o_orderdate as timestamp) as last_edited,
       cast(o_orderdate as timestamp) + interval '1' day as last_synced,
       false as is_root, false as enabled, c.id as parent_id, o_orderkey, o_orderpriority
from {{orders}} o join {{fx_customer}} c on o.o_custkey = c.c_custkey
"""

_COLUMNS = "id, type, folder, file_path, title, last_edited, last_synced, is_root, enabled, parent_id"

VIEWS["fx_registry"] = f"""
select {_COLUMNS} from {{fx_region}} union all select {_COLUMNS} from {{fx_nation}}
union all select {_COLUMNS} from {{fx_customer}} union all select {_COLUMNS} from {{fx_order}}
"""

# What the workspace reports: registered pages, one order in five edited since, and new pages
# (suppliers below nations, parts below suppliers; some lost, some at the top).
VIEWS["fx_pages"] = f"""
select {dashed('id')} as id, last_edited, parent_id, title from {{fx_region}}
union all select {dashed('id')} as id, last_edited, parent_id, title from {{fx_nation}}
union all select {dashed('id')} as id, last_edited, parent_id, title from {{fx_customer}}
union all select {dashed('id')} as id,
       case when o_orderkey % 5 = 0 then last_edited + interval '10' day else last_edited end as last_edited,
       parent_id, title from {{fx_order}}
union all select {dashed(key_id('supplier', 's_suppkey'))} as id,
       timestamp '2001-06-01 00:00:00' + cast(s_suppkey as int) * interval '1' minute as last_edited,
       {key_id('nation', 's_nationkey')} as parent_id, s_name as title from {{supplier}}
union all select {dashed(key_id('part', 'p_partkey'))} as id,
       timestamp '2001-07-01 00:00:00' + cast(p_partkey as int) * interval '1' minute as last_edited,
       case when p_partkey % 41 = 0 then {key_id('missing', 'p_partkey')}
            when p_partkey % 43 = 0 then ''
            else {key_id('supplier', 'p_partkey % 10')} end as parent_id,
       p_name as title from {{part}}
"""

VIEWS["fx_users"] = f"""
select {key_id('user', 's_suppkey')} as id, s_name as name,
       case when s_suppkey % 2 = 0 then 'person' else 'bot' end as type,
       case when s_suppkey % 3 = 0 then concat(lower(replace(s_name, '#', '.')), '@example.com') else '' end as email
from {{supplier}}
"""

# Ten orders per queue file; the file number decides type, encoding and folder.
VIEWS["fx_queue_rows"] = f"""
select 1000 + cast(floor(o_orderkey / 10) as bigint) as seq, cast(o_orderkey % 10 as int) as pos,
       case when cast(floor(o_orderkey / 10) as bigint) % 4 in (1, 2) then 'init' else 'update' end as type,
       r.folder as folder,
       case when o_orderkey % 17 = 0 then {key_id('neworder', 'o_orderkey')}
            else {key_id('order', 'o_orderkey')} end as page_id,
       case when o_orderkey % 3 = 0 then cast(o_orderdate as timestamp) + interval '1' day
            else cast(o_orderdate as timestamp) end as last_edited,
       cast(floor(o_orderkey / 10) as bigint) % 2 = 1 as legacy
from {{orders}} o join {{fx_region}} r on cast(floor(o_orderkey / 10) as bigint) % 5 = r.r_regionkey
"""

# Task-list lines: a region, the first one twice, and per customer new pages, registered pages, and
# lines that are not entries.
VIEWS["fx_root_lines"] = f"""
select cast(r_regionkey * 2 as bigint) as line_no,
       concat('- [', case when r_regionkey % 2 = 0 then 'x' else ' ' end, '] **',
              lower(replace(r_name, ' ', '-')), '**: https://example.com/', replace(r_name, ' ', '-'), '-',
              {key_id('region', 'r_regionkey')}) as line
from {{region}} where r_regionkey <> 3
union all select cast(100 + r_regionkey as bigint) as line_no,
       concat('- [X] **again**:   ', {dashed(key_id('region', 'r_regionkey'))}) as line
from {{region}} where r_regionkey = 1
union all select cast(1000 + 4 * c_custkey as bigint) as line_no,
       concat('- [ ] **new-', cast(c_custkey % 50 as string), '**: ', {key_id('newroot', 'c_custkey')}) as line
from {{customer}} where c_custkey % 2 = 0
union all select cast(1001 + 4 * c_custkey as bigint) as line_no, '- [x] **docs**: not-a-valid-url' as line
from {{customer}} where c_custkey % 10 = 0
union all select cast(1002 + 4 * c_custkey as bigint) as line_no, '# Root Pages' as line from {{customer}} where c_custkey % 25 = 0
union all select cast(1003 + 4 * c_custkey as bigint) as line_no,
       concat('- [x] **crm_', cast(c_custkey % 7 as string), '**: https://example.com/page-', {key_id('customer', 'c_custkey')}) as line
from {{customer}} where c_custkey % 5 = 0
"""

# A corpus of documents: two files per id, some hidden, some without a usable header.
VIEWS["fx_markdown"] = f"""
select case when doc_id % 50 = 7 then concat('.cache/doc-', cast(doc_id as string), '.md')
            else concat('docs/', source, '/doc-', cast(doc_id as string), '.md') end as path,
       concat(
         case when doc_id % 37 = 5 then '' else concat('---', chr(10)) end,
         'notion_id: ', {dashed(key_id('doc', 'cast(floor(doc_id / 2) as bigint)'))}, chr(10),
         'title: "ignored: here"', chr(10), 'notion_type: page', chr(10), 'notion_folder:  ', lang, ' ', chr(10),
         case when doc_id % 5 = 0 then '' else concat('file_path: docs/', source, '/doc-', cast(doc_id as string), '.md', chr(10)) end,
         'last_edited: 2024-01-', lpad(cast(1 + (doc_id * 7) % 28 as string), 2, '0'), 'T00:00:00Z', chr(10),
         'last_synced: not a time', chr(10),
         'notion_parent_id: ', {dashed(key_id('folder', 'source'))}, chr(10),
         'is_root: ', case when doc_id % 9 = 0 then 'true' else 'false' end, chr(10),
         case when doc_id % 11 = 0 then concat('  notion_folder: inner', chr(10)) else '' end,
         case when doc_id % 41 = 3 then '' else concat('---', chr(10), chr(10)) end,
         case when doc_id % 2 = 0 then concat('## Doc ', cast(doc_id as string), ' ', chr(10), chr(10)) else '' end,
         text) as value,
       doc_id
from {{documents}}
"""

# Published document sets before and after: some gone, some new, some changed.
VIEWS["fx_published"] = """
select 'old' as edition, concat('docs/', source, '/doc-', cast(doc_id as string), '.md') as path, text as content
from {documents} where doc_id % 7 <> 0 or doc_id % 5 = 0
union all
select 'new' as edition, concat('docs/', source, '/doc-', cast(doc_id as string), '.md') as path,
       case when doc_id % 4 = 0 then concat(text, chr(10), 'edited') else text end as content
from {documents} where doc_id % 5 <> 0 or doc_id % 7 = 0
union all
select 'new' as edition, concat('.notion-sync/queue/', lpad(cast(item_id as string), 8, '0'), '.json') as path, text as content
from {benchmark}
"""

# Legacy record files: bare, dashed and normalised names of pages, plus files and users.
VIEWS["fx_legacy"] = f"""
select concat('page-', {key_id('customer', 'c_custkey')}, '.json') as file_name,
       {dashed(key_id('customer', 'c_custkey'))} as id, 'page' as type, 'normalised' as folder, c_name as title,
       {dashed(key_id('nation', 'c_nationkey'))} as parent_id, '' as source_url
from {{customer}} where c_custkey % 3 = 0
union all
select concat('page-', {dashed(key_id('customer', 'c_custkey'))}, '.json') as file_name,
       {dashed(key_id('customer', 'c_custkey'))} as id, 'page' as type, 'dashed' as folder, c_name as title,
       {dashed(key_id('nation', 'c_nationkey'))} as parent_id, '' as source_url
from {{customer}} where c_custkey % 2 = 0
union all
select concat({key_id('customer', 'c_custkey')}, '.json') as file_name,
       {key_id('customer', 'c_custkey')} as id, 'page' as type, 'bare' as folder, c_name as title,
       {key_id('nation', 'c_nationkey')} as parent_id, '' as source_url
from {{customer}} where c_custkey % 5 = 0 or c_custkey % 6 in (1, 5)
union all
select concat('file-', {key_id('part', 'p_partkey')}, '.json') as file_name, {key_id('part', 'p_partkey')} as id,
       '' as type, '' as folder, p_name as title, '' as parent_id,
       concat('https://bucket.example.com/', cast(p_partkey as string), '.png?sig=', p_brand) as source_url
from {{part}}
union all
select concat('user-', cast(s_suppkey as string), '.json') as file_name, {key_id('user', 's_suppkey')} as id,
       '' as type, '' as folder, s_name as title, '' as parent_id, '' as source_url
from {{supplier}}
union all
select concat('note-', cast(s_suppkey as string), '.json') as file_name, cast(s_suppkey as string) as id,
       '' as type, '' as folder, s_name as title, '' as parent_id, '' as source_url
from {{supplier}}
"""

# Stored index records of customers, for overlays: some pending, some deleted.
VIEWS["fx_stored"] = f"""
select id, type, 'stored' as folder, title, parent_id, c_custkey from {{fx_customer}} where c_custkey % 4 <> 1
"""

# Edit events as they arrive. One in twenty is late, one in 33 carries a broken signature, one in
# 50 is not JSON, and every 101st only carries a verification token.
VIEWS["fx_event_rows"] = f"""
select event_id, cast(ts as timestamp) as sent_at,
       case when event_id % 20 = 0 then cast(ts as timestamp) + interval '6' minute else cast(ts as timestamp) end as received_at,
       case when event_id % 101 = 0 then '' when event_type = 'signup' then 'page.created'
            when event_type = 'view' then 'page.content_updated' when event_type = 'click' then 'page.properties_updated'
            when event_type = 'purchase' then 'database.updated' when event_id % 2 = 0 then 'page.deleted'
            else 'page.locked' end as event_type,
       case when event_id % 101 = 0 then '' else {key_id('customer', 'user_id')} end as entity_id,
       event_id % 20 = 0 as is_late, event_id % 33 = 0 as is_broken, event_id % 50 = 1 as is_garbled,
       event_id % 101 = 0 as is_token
from {{events}}
"""

VIEWS["fx_event_status"] = """
select event_id, received_at, event_type, entity_id,
       case when is_late or is_broken then 'unauthorized' when is_garbled then 'malformed' else 'accepted' end as status,
       case when is_late or is_broken or is_garbled then null
            when event_type in ('page.created', 'page.content_updated', 'page.properties_updated', 'database.updated') then 'queue'
            when event_type = 'page.deleted' then 'deletion'
            when is_token then 'verification' else 'ignored' end as route
from {fx_event_rows}
"""

# Blocks: every third order's line items form a tree of blocks in the order's page.
VIEWS["fx_block_parents"] = f"""
select {key_id('line', "concat(cast(l_orderkey as string), '/', cast(l_linenumber as string))")} as block_id,
       case when l_linenumber = 1 then
              case when l_orderkey % 13 = 0 then 'workspace' when l_orderkey % 17 = 0 then 'team'
                   when l_orderkey % 5 = 0 then 'database_id' else 'page_id' end
            else 'block_id' end as parent_type,
       case when l_linenumber = 1 then
              case when l_orderkey % 13 = 0 then '' else {key_id('order', 'l_orderkey')} end
            else {key_id('line', "concat(cast(l_orderkey as string), '/', cast(l_linenumber - 1 as string))")} end as parent_id,
       l_orderkey, l_linenumber
from (select distinct l_orderkey, l_linenumber from {{lineitem}}) x
"""

# Pages to synchronise: one per document. Most hang on nations; 3 hangs on 2, 4 on 3 (of ten).
VIEWS["fx_doc_pages"] = f"""
select doc_id, {key_id('docpage', 'doc_id')} as id,
       concat('Note ', cast(doc_id % 7 as string)) as title,
       case when doc_id % 97 = 11 then {key_id('missing', 'doc_id')}
            when doc_id % 10 in (3, 4) then {key_id('docpage', 'doc_id - 1')}
            else {key_id('nation', 'doc_id % 25')} end as parent_id,
       timestamp '2024-01-01 00:00:00' + cast(doc_id as int) * interval '1' hour as last_edited,
       {key_id('user', 'doc_id % 10')} as author
from {{documents}}
"""

VIEWS["fx_databases"] = f"""
select distinct {key_id('db', 'p_brand')} as id, p_brand as title,
       {key_id('nation', "cast(replace(p_brand, 'Brand#', '') as int) % 25")} as parent_id
from {{part}}
"""


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def _names(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(text) if field})


class Views:
    """The views as DataFrames over one folder of generated tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                text = VIEWS[name]
                self._known[name] = self.spark.sql(text, **{n: self[n] for n in _names(text)})
            else:
                self._known[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._known[name]


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in _names(VIEWS[name]):
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(body: str, recursive: bool = False, ctes: str = "") -> str:
    """`body` with the views it mentions (and `ctes`) in front as common table expressions."""
    text = ctes + " " + body
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", text)]
    parts = [
        f"{name} as ({VIEWS[name].format(**{n: n for n in _names(VIEWS[name])})})" for name in _closure(used)
    ]
    if ctes.strip():
        parts.append(ctes.strip())
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body
