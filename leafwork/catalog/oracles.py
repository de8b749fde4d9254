"""SQL twins of the registered queries, for a plain single-node database."""

from __future__ import annotations

from leafwork import __version__
from leafwork.catalog.views import dashed, key_id, with_views

TRACED = """
found as (
  select id, id as root_id, enabled as root_enabled, 0 as hops from fx_registry where is_root
  union all
  select c.id, f.root_id, f.root_enabled, f.hops + 1 from fx_registry c join found f on c.parent_id = f.id
  where not c.is_root
),
lost as (
  select c.id from fx_registry c left join fx_registry p on c.parent_id = p.id
  where not c.is_root and p.id is null
  union all
  select c.id from fx_registry c join lost l on c.parent_id = l.id where not c.is_root
),
traced as (
  select r.*, f.root_id, f.root_enabled, f.hops,
         case when f.id is not null then 'found' when l.id is not null then 'dangling' else 'cycle' end as outcome
  from fx_registry r left join found f on r.id = f.id left join lost l on r.id = l.id
)"""

ROOT_LINES = r"""
lines as (
  select line_no, regexp_extract(trim(line), '^- \[([ xX])\] \*\*([^*]+)\*\*:\s*(.+)$', 1) as mark,
         trim(regexp_extract(trim(line), '^- \[([ xX])\] \*\*([^*]+)\*\*:\s*(.+)$', 2)) as folder,
         trim(regexp_extract(trim(line), '^- \[([ xX])\] \*\*([^*]+)\*\*:\s*(.+)$', 3)) as url
  from fx_root_lines
),
entries as (
  select line_no, folder, lower(mark) = 'x' as enabled, url,
         case when url like 'http%' then nullif(regexp_extract(url, '([0-9a-f]{32})$', 1), '')
              when regexp_matches(replace(url, '-', ''), '^[0-9a-f]{32}$') then replace(url, '-', '') end as page_id
  from lines where url <> ''
),
listed as (
  select page_id, line_no, folder, enabled, url from entries where page_id is not null
  qualify row_number() over (partition by page_id order by line_no) = 1
)"""

DOOMED = TRACED + "," + ROOT_LINES + """,
doomed as (
  select t.id, t.file_path, t.root_id from traced t left join listed m on t.root_id = m.page_id
  where t.outcome <> 'cycle' and m.page_id is null
)"""

ANCHORS = TRACED + """,
nodes as (select replace(id, '-', '') as id, nullif(parent_id, '') as parent_id, last_edited from fx_pages),
walk as (
  select id, parent_id as at, 0 as hops from nodes
  union all
  select w.id, n.parent_id, w.hops + 1 from walk w join nodes n on w.at = n.id
  left join fx_registry r on w.at = r.id where r.id is null
),
anchors as (
  select w.id, t.id as anchor_id, w.hops,
         case when w.at is null then 'default' else t.folder end as folder,
         coalesce(t.root_enabled, false) as found_root,
         case when w.at is null or t.id is not null then 'found' else 'dangling' end as outcome
  from walk w left join traced t on w.at = t.id left join nodes n on w.at = n.id
  where w.at is null or t.id is not null or n.id is null
)"""


def decided(folder: str | None = None, untracked: bool = True) -> str:
    other = f"when coalesce(f, '') <> '{folder}' then 'other_folder'" if folder else ""
    return ANCHORS + f""",
candidates as (
  select n.id, n.last_edited, t.id is not null as tracked, coalesce(t.root_enabled, false) as enabled,
         case when t.id is not null then t.folder when {str(untracked).lower()} then a.folder end as f,
         a.found_root, a.outcome
  from nodes n left join traced t on n.id = t.id left join anchors a on n.id = a.id
  where n.last_edited > timestamp '1998-01-01'
),
decided as (
  select id, last_edited, tracked, f as folder,
    case when last_edited <= timestamp '2000-06-01' then 'unchanged'
         when not tracked and not {str(untracked).lower()} then 'untracked'
         when tracked and not enabled then 'root_disabled'
         when not tracked and outcome <> 'found' then 'trace_failed'
         when not tracked and not found_root then 'no_root'
         {other} else 'queue' end as decision
  from candidates
)"""


COUNTERS = """
select 'queued' as metric, count(*) filter (decision = 'queue') as value from {0}
union all select 'skipped', count(*) filter (decision not in ('queue', 'not_reached')) from {0}
union all select 'new', count(*) filter (decision in ('queue', 'other_folder') and not tracked) from {0}
union all select 'updated', count(*) filter (decision in ('queue', 'other_folder') and tracked) from {0}
union all select 'found', count(*) from fx_pages
"""

SKIPS = """
skips as (
  select q.*, r.id is not null as registered,
         case when legacy then r.id is not null and q.type = 'init'
              else r.id is not null and q.last_edited <= r.last_edited end as skip
  from fx_queue_rows q left join fx_registry r on q.page_id = r.id
)"""


def numbered(rows: str, order: str, first: int) -> str:
    """Files of ten per (folder, type, parent) over `rows`."""
    return f"""
placed as (
  select *, row_number() over (partition by folder, type, coalesce(parent_id, '') order by {order}) - 1 as place
  from {rows}
),
filed as (
  select *, dense_rank() over (order by folder, type, coalesce(parent_id, ''), place // 10) as file from placed
),
numbered as (
  select {first} - 1 + file as seq, cast(place % 10 as int) as pos, * exclude (place, file) from filed
)"""


# the start of the id where it is alone, else the whole id; later rounds see the names of earlier ones
SUFFIX = """case when count(*) over (partition by dir, slug, rn = 1, substr(id, 1, 4), round) > 1
         or min(round) over (partition by dir, slug, rn = 1, substr(id, 1, 4)) < round then id else substr(id, 1, 4) end"""

PATHS = f"""
known as (
  select id, file_path from fx_region union all select id, file_path from fx_nation
  union all select id, file_path from fx_customer where c_custkey % 4 <> 2
),
fresh as (
  select c.id, 'a-customer' as slug, 1 as priority, c.folder as home,
         case when c.parent_id = c.id then 9 else 0 end as round,
         case when c.parent_id = c.id or k.id is null then c.folder else replace(k.file_path, '.md', '') end as dir
  from fx_customer c left join known k on c.parent_id = k.id where c.c_custkey % 4 = 2
),
fresh_named as (
  select *, row_number() over (partition by dir, slug order by round, priority, id) as rn from fresh
),
fresh_paths as (
  select id, home, round, concat(dir, '/', slug, case when rn = 1 then '' else concat('-', {SUFFIX}) end, '.md') as file_path
  from fresh_named
),
placed_orders as (
  select {{order_id}} as id, trim(regexp_replace(lower(replace(o_orderpriority, ' ', '-')), '^[^a-z]+', '')) as slug,
         o_orderkey % 3 as priority,
         case when f.id is null then 0 when f.round = 9 then 9 else 1 end as round,
         case when f.round = 9 then o.folder else replace(coalesce(k.file_path, f.file_path), '.md', '') end as dir
  from fx_order o left join known k on o.parent_id = k.id left join fresh_paths f on o.parent_id = f.id
),
order_paths as (
  select id, concat(dir, '/', slug, case when rn = 1 then '' else concat('-', {SUFFIX}) end, '.md') as file_path
  from (select *, row_number() over (partition by dir, slug order by round, priority, id) as rn from placed_orders)
),
all_paths as (select id, file_path from fresh_paths union all select id, file_path from order_paths)"""

NL = "chr(10)"


def label(user: str) -> str:
    return (
        f"concat({user}.name, case when {user}.type = 'person' and {user}.email <> '' "
        f"then concat(' <', {user}.email, '>') else '' end, ' [', substr({user}.id, 1, 8), ']')"
    )


def header(fields: list[tuple[str, str]]) -> str:
    """A metadata header with one line per field; null values leave their line out."""
    lines = ", ".join(f"coalesce(concat('{name}: ') || ({value}) || {NL}, '')" for name, value in fields)
    return f"concat('---', {NL}, {lines}, '---', {NL}, {NL})"


def doc_header(folder: str, file_path: str, synced: str, parent: str, is_root: str) -> str:
    return header(
        [
            ("tool_version", f"'{__version__}'"),
            ("notion_id", "d.id"),
            ("title", "concat('\"', d.title, '\"')"),
            ("notion_type", "'page'"),
            ("notion_folder", folder),
            ("file_path", file_path),
            ("created_by", f"concat('\"', {label('u')}, '\"')"),
            ("last_edited_by", "concat('\"Ed [', substr(d.id, 1, 8), ']\"')"),
            ("last_edited", "strftime(d.last_edited, '%Y-%m-%dT%H:%M:%SZ')"),
            ("last_synced", f"'{synced}'"),
            ("icon", "'\"emoji:\U0001f4c4\"'"),
            ("notion_parent_id", parent),
            ("is_root", is_root),
            ("notion_url", "concat('https://example.com/', d.id)"),
        ]
    )


def db_header(id_: str, folder: str, file_path: str, synced: str, parent: str) -> str:
    return header(
        [
            ("tool_version", f"'{__version__}'"),
            ("notion_id", id_),
            ("title", "'\"Untitled\"'"),
            ("notion_type", "'database'"),
            ("notion_folder", folder),
            ("file_path", file_path),
            ("last_edited", "'2024-03-01T00:00:00Z'"),
            ("last_synced", synced),
            ("notion_parent_id", parent),
            ("is_root", "'false'"),
            ("notion_url", f"concat('https://example.com/', {id_})"),
        ]
    )


BODIES = f"""
lines as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as line_no from (select doc_id, string_split(text, {NL}) as l from documents)
),
spans as (
  select *, case when line_no % 7 = 0 then concat('[', bolded, '](https://example.com/', cast(doc_id as varchar), ')') else bolded end as t
  from (select *, case when line_no % 5 = 0 then concat('**', line, '**') else line end as bolded from lines)
),
pieces as (
  select doc_id, line_no, line_no % 8 as slot,
    case line_no % 8
      when 0 then concat('## ', t, {NL}) when 1 then concat(t, {NL}) when 2 then concat('- ', t, {NL})
      when 3 then concat('  1. ', t, {NL}) when 4 then concat(case when line_no % 16 = 4 then '- [x] ' else '- [ ] ' end, t, {NL})
      when 5 then concat('> ', t, {NL}) when 6 then concat('```', {NL}, line, {NL}, '```', {NL})
      else concat('---', {NL}) end as piece
  from spans
),
tops as (
  select p.doc_id, p.line_no, p.slot in (2, 4) as is_list, concat(p.piece, coalesce(c.piece, '')) as content
  from pieces p left join pieces c on p.slot = 2 and c.doc_id = p.doc_id and c.line_no = p.line_no + 1
  where p.slot <> 3
),
spaced as (
  select doc_id, line_no, concat(content, case when next_list is null or (is_list and next_list) then '' else {NL} end) as content
  from (select *, lead(is_list) over (partition by doc_id order by line_no) as next_list from tops)
),
bodies as (select doc_id, string_agg(content, '' order by line_no) as body from spaced group by doc_id)"""

LISTS = f"""
lists as (
  select p_brand, string_agg(concat('- [', p_name, '](./', lower(replace(p_brand, '#', '')), '/',
         lower(replace(p_name, ' ', '-')), '.md)<!-- page_id:', {key_id('part', 'p_partkey')}, ' -->', {NL}), '' order by p_partkey) as listing
  from part group by p_brand
)"""

SYNC = """
homes as (
  select n.id, n.n_nationkey, n.file_path, n.folder, r.enabled from fx_nation n join fx_region r on n.parent_id = r.id
),
docs as (
  select d.*, d.doc_id % 10 as k, d.doc_id % 97 = 11 as adrift,
         case when d.doc_id % 10 = 3 then d.doc_id - 1 when d.doc_id % 10 = 4 then d.doc_id - 2 else d.doc_id end as top_id
  from fx_doc_pages d
),
reach as (
  select d.*, h.folder, h.enabled, h.file_path as home_path,
         d.adrift or t.adrift or (d.k = 4 and m.adrift) as is_lost,
         1000 + d.doc_id // 10 as seq
  from docs d join docs t on d.top_id = t.doc_id left join docs m on m.doc_id = d.doc_id - 1
  left join homes h on h.n_nationkey = d.top_id % 25
),
judged as (
  select *, case when doc_id % 29 = 8 and doc_id % 2 = 0 then 'dropped' when doc_id % 29 = 8 then 'retry'
                 when is_lost or not enabled then 'no_root' else 'written' end as outcome
  from reach where k not in (2, 3)
),
dbs as (
  select d.id, d.title, d.parent_id, h.folder, h.file_path as home_path, h.enabled,
         100 + cast(replace(d.title, 'Brand#', '') as int) as seq,
         case when h.enabled then 'written' else 'no_root' end as outcome
  from fx_databases d join homes h on d.parent_id = h.id
),
due as (
  select doc_id, id, title, parent_id, folder, home_path, k, seq as priority from judged where outcome = 'written'
  union all
  select a.doc_id, a.id, a.title, a.parent_id, a.folder, a.home_path, a.k, 0 from reach a
  join judged j on j.k = 4 and j.outcome = 'written' and a.doc_id in (j.doc_id - 1, j.doc_id - 2)
),
flat as (
  select *, concat(replace(home_path, '.md', ''), '/', lower(replace(title, ' ', '-')),
         case when row_number() over (partition by home_path, title order by priority, id) = 1 then ''
              else concat('-', substr(id, 1, 4)) end, '.md') as file_path
  from due where k not in (3, 4)
),
second as (
  select d.*, concat(replace(f.file_path, '.md', ''), '/', lower(replace(d.title, ' ', '-')), '.md') as file_path
  from due d join flat f on d.parent_id = f.id where d.k = 3
),
third as (
  select d.*, concat(replace(s.file_path, '.md', ''), '/', lower(replace(d.title, ' ', '-')), '.md') as file_path
  from due d join second s on d.parent_id = s.id where d.k = 4
),
doc_files as (select * from flat union all select * from second union all select * from third),
db_files as (
  select *, concat(replace(home_path, '.md', ''), '/', lower(replace(title, '#', '')), '.md') as file_path
  from dbs where outcome = 'written'
)"""

LINKS = f"""
hrefs as (
  select page_id, unnest(l) as href, unnest(range(len(l))) as position
  from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages)
),
links as (
  select {key_id('page', 'page_id')} as page_id, concat('web/page-', cast(page_id % 20 as varchar), '.md') as page_path, position,
         case when position % 2 = 0 then md5(href) end as file_id, concat('https://example.com', href) as other_url,
         concat('https://bucket.s3.region.amazonaws.com/ws/', {dashed('md5(href)')}, '/', regexp_replace(href, '[^a-zA-Z]', '', 'g'),
                '%20File.PNG') as bare, cast(page_id as varchar) as sig,
         concat(trim(concat(lower(regexp_replace(href, '[^a-zA-Z]', '', 'g')), '-file'), '-'), '.png') as name
  from hrefs
),
firsts as (
  select * from links where file_id is not null
  qualify row_number() over (partition by file_id order by page_path, position, concat(bare, '?sig=', sig)) = 1
),
homes as (
  select *, substr(file_id, 1, 1) > '3' as fresh, concat(replace(page_path, '.md', ''), '/files/', name) as home from firsts
),
sidecars as (
  select home, min(case when file_id < '5' then file_id else md5(concat('stranger:', file_id)) end) as holder
  from homes where substr(file_id, 1, 1) in ('4', '5') group by home
),
placed as (
  select file_id, page_id, bare as source_url, fresh and holder is distinct from file_id as is_new,
         case when not fresh then concat('web/old/files/', file_id, '.png')
              when coalesce(holder, min(file_id) over (partition by fresh, home)) = file_id then home
              else concat(replace(home, '.png', ''), '-', substr(file_id, 1, 4), '.png') end as file_path
  from homes left join sidecars using (home)
),
sized as (select *, is_new and substr(file_id, 1, 5) > '80000' as too_large from placed)"""

PARSED = f"""
accepted as (
  select m.path, {key_id('doc', 'cast(floor(m.doc_id / 2) as bigint)')} as id, 'page' as type,
         case when m.doc_id % 11 = 0 then 'inner' else d.lang end as folder, m.path as file_path,
         case when m.doc_id % 2 = 0 then concat('Doc ', cast(m.doc_id as varchar))
              when left(first_line, 1) = '#' then regexp_replace(regexp_replace(regexp_replace(first_line, '^#+', ''), '^\\s+', ''), '\\s+$', '')
              else concat('doc-', cast(m.doc_id as varchar)) end as title,
         make_timestamp(2024, 1, cast(1 + (m.doc_id * 7) % 28 as bigint), 0, 0, 0) as last_edited,
         m.doc_id % 9 = 0 as is_root, {key_id('folder', 'd.source')} as parent_id, m.doc_id
  from fx_markdown m join (
    select *, string_split(regexp_replace(text, '^\\s+', ''), {NL})[1] as first_line from documents) d on m.doc_id = d.doc_id
  where m.doc_id % 50 <> 7 and m.doc_id % 37 <> 5 and m.doc_id % 41 <> 3
),
latest as (
  select * from accepted qualify row_number() over (partition by id order by last_edited desc, path) = 1
),
extra as (
  select a.id, a.path, l.file_path as kept_path from accepted a join latest l on a.id = l.id where a.path <> l.file_path
)"""

RECORD_LINE = """concat('{',
  case when enabled then '"enabled":true,' else '' end, '"file_path":"', file_path, '","folder":"', folder, '","id":"', id,
  '","is_root":', case when is_root then 'true' else 'false' end,
  ',"last_edited":"', strftime(last_edited, '%Y-%m-%dT%H:%M:%SZ'),
  '","last_synced":"', coalesce(strftime(last_synced, '%Y-%m-%dT%H:%M:%SZ'), '0001-01-01T00:00:00Z'), '",',
  case when parent_id <> '' then concat('"parent_id":"', parent_id, '",') else '' end,
  '"title":"', title, '","type":"', type, '"}')"""

MONTHS = """case when last_synced is null then 'never'
  else concat(cast(cast(floor(date_diff('second', last_synced, timestamp '2024-06-01') / 2592000) as bigint) as varchar), ' months ago') end"""

EPOCH = "cast(floor(epoch({0})) as bigint)"


def seconds(name: str) -> str:
    return f"{EPOCH.format(name)} as {name}"


def kind_header() -> str:
    """Header of a page with a property of every type (see `catalog.kinds`)."""
    web = "'https://example.com/{}'"

    def line(name: str, value: str) -> str:
        return f"'  {name}: ', {value}, {NL}"

    quoted = "concat('\"', {}, '\"')".format
    listed = lambda *values: "concat(" + ", ".join(f"{NL}, '    - ', {quoted(v)}" for v in values) + ")"
    flag = "case when even then 'true' else 'false' end"
    properties = [
        ("a01", quoted("'no marks'")), ("a03", "regexp_replace(printf('%.2f', c_custkey / 4.0), '\\.?0+$', '')"), ("a04", quoted("c_mktsegment")),
        ("a05", listed("'one'", "'two'")), ("a06", quoted("'Open'")), ("a07", quoted("'2024-01-31'")), ("a08", flag),
        ("a09", quoted(web.format("u") + ", k")), ("a10", quoted("'c', k, '@example.com'")), ("a11", quoted("c_phone")),
        ("a12", listed("'p-1'", "k")), ("a13", listed("id")), ("a14", "'2.5'"), ("a15", quoted("'2024-02-01'")),
        ("a16", "'\"a \\\"quoted\\\" text\"'"), ("a17", "'-1'"), ("a18", flag), ("a19", quoted("'2024-03-01'")), ("a20", quoted("'u-1'")),
        ("a21", quoted("'u-2'")), ("a22", quoted("'2024-01-01T00:00:00.000Z'")), ("a23", quoted("'2024-01-02T00:00:00.000Z'")),
        ("a24", "case when even then concat('\"C-', k, '\"') else k end"),
    ]
    fields = [
        ("tool_version", f"'{__version__}'"), ("notion_id", "id"), ("title", quoted("c_name")), ("notion_type", "'page'"),
        ("notion_folder", "'crm'"), ("file_path", "'crm/c-', k, '.md'"), ("created_by", quoted("'Ann <ann@example.com> [', substr('u-' || k, 1, 8), ']'")),
        ("last_edited", "'2024-02-01T00:00:00Z'"), ("icon", quoted("case when even then 'external:' else 'file:' end, " + web.format("icon") + ", k")),
        ("notion_parent_id", "'db1'"), ("is_root", "'false'"), ("notion_url", web.format("page") + ", k"),
    ]
    head = ", ".join(f"'{name}: ', {value}, {NL}" for name, value in fields)
    return f"'---', {NL}, {head}, 'properties:', {NL}, " + ", ".join(line(*p) for p in properties) + f", '---', {NL}, {NL}"


def kind_body() -> str:
    """Body of a page with a block of every kind: a blank line after each block but between list items."""
    block = "md5(concat('kind:{}:', k))".format
    web = "'https://example.com/{}', k".format
    start, end = f"'<!-- collapsible: start -->', {NL}", f"'<!-- collapsible: end -->', {NL}"
    media = lambda opening, label, end, name: f"'{opening}', {label}, '](', {web(end)}, ')<!-- file_id:', {block(name)}, ' -->', {NL}"
    link = lambda label, slug, name: f"'- [', {label}, '](./', lower(replace(c_name, '#', '')), '/', {slug}, '.md)<!-- page_id:', {block(name)}, ' -->', {NL}"
    blocks = [
        f"'# One _', c_name, '_', {NL}",
        f"'## Two', {NL}, {start}, 'inside ', k, {NL}, {end}",
        f"'### ~~', c_mktsegment, '~~', {NL}",
        f"'call `', c_phone, '` or @Ann <ann@example.com> [', substr(id, 1, 8), ']', {NL}",
        f"{start}, '**more**', {NL}, {NL}, '- _**x**_', {NL}, '  1. [y](', {web('y')}, ')', {NL}, {end}",
        f"'> q1', {NL}, '> q2', {NL}",
        f"'> \U0001f4a1 ', c_mktsegment, {NL}",
        f"'> no sign', {NL}",
        media("![", "'image'", "i", "image"), media("[", "c_name", "v", "video"), media("[", "'report.txt'", "f", "file"),
        media("[", "'File'", "n", "nameless"), media("[", "'PDF'", "p", "pdf"),
        f"'[', {web('b')}, '](', {web('b')}, ')', {NL}",
        f"'[See](', {web('c')}, ')', {NL}",
        f"'$$', {NL}, 'a+b', {NL}, '$$', {NL}",
        f"'[TOC]', {NL}",
        link("c_name", "lower(replace(c_name, '#', ''))", "page"), link("'Tasks'", "'tasks'", "base"),
        f"'synced', {NL}",
        f"'| a | ', c_mktsegment, ' |', {NL}, '| --- | --- |', {NL}, '| **b** |  |', {NL}",
        f"'| c |', {NL}",
        f"'left', {NL}, 'right', {NL}",
        f"'[Page Link](notion://page/', id, ')<!-- page_id:', id, ' -->', {NL}",
        f"'[Database Link](notion://database/', id, ')<!-- page_id:', id, ' -->', {NL}",
        "", # a link to nothing
        f"'[Embed](', {web('e')}, ')', {NL}",
        "", # a kind that is not known
        NL, # a paragraph without content
        "", # an image without content
        f"'```sql', {NL}, 'select 1', {NL}, '```', {NL}",
        f"'- [x] did', {NL}", f"'- [ ] do', {NL}",
        f"'---', {NL}",
    ]
    lists = {len(blocks) - 3, len(blocks) - 2}
    pieces = []
    for at, text in enumerate(blocks):
        gap = text and at + 1 < len(blocks) and not {at, at + 1} <= lists
        pieces += [text] * bool(text) + [NL] * bool(gap)
    return ", ".join(pieces)


def build() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, body: str, ctes: str = "", recursive: bool = False) -> None:
        sql[name] = with_views(body, recursive, ctes)

    add("root_status", f"""
      select folder, count(*) as pages, count(*) filter (is_root) as roots, count(*) filter (outcome = 'found') as traced,
             count(*) filter (outcome = 'dangling') as orphans, count(*) filter (outcome = 'cycle') as cyclic,
             count(*) filter (root_enabled) as under_enabled_root, {EPOCH.format('max(last_synced)')} as last_synced
      from traced group by folder""", TRACED, True)
    add("page_roots", "select id, root_id, root_enabled, outcome, hops from traced", TRACED, True)
    add("missing_parents", """
      select c.id, c.parent_id, c.folder from fx_registry c left join fx_registry p on c.parent_id = p.id
      where c.parent_id <> '' and p.id is null""")
    add("cleanup_orphans", "select id, file_path, root_id from doomed", DOOMED, True)
    add("cleanup_counters", """
      select 'orphaned_pages' as metric, count(*) as value from doomed
      union all select 'deleted_registries', count(*) from doomed
      union all select 'deleted_files', count(*) filter (file_path <> '') from doomed""", DOOMED, True)
    add("nearest_ancestors", """
      select n.id, a.anchor_id, a.folder, coalesce(a.found_root, false) as found_root,
             case when a.outcome = 'found' then a.hops end as missing_ancestors, a.outcome
      from nodes n left join (
        select id, anchor_id, case when outcome = 'found' then folder end as folder, found_root, hops, outcome from anchors) a
      on n.id = a.id""", ANCHORS, True)
    add("ancestor_chain", f"""
      select p.id as page_id, cast(0 as int) as write_order, s.id, n.folder from parts p
      join fx_pages sp on p.parent_id = replace(sp.id, '-', '') join (select replace(id, '-', '') as id, parent_id from fx_pages) s
      on s.id = p.parent_id join fx_nation n on s.parent_id = n.id
      union all
      select p.id, 1, p.id, n.folder from parts p join (select replace(id, '-', '') as id, parent_id from fx_pages) s
      on s.id = p.parent_id join fx_nation n on s.parent_id = n.id
      union all select p.id, 0, p.id, 'default' from parts p where p.parent_id = ''""",
        f"""parts as (select replace(f.id, '-', '') as id, f.parent_id from fx_pages f
            join part on {key_id('part', 'p_partkey')} = replace(f.id, '-', ''))""")
    sql["write_set"] = f"select distinct id, folder, write_order from ({sql['ancestor_chain']}) steps"
    add("block_to_page", """
      select b.block_id, case when u.parent_type in ('page_id', 'database_id') then u.parent_id end as container_id,
             case when u.parent_type in ('page_id', 'database_id', 'workspace') then u.parent_type end as container_type,
             case when u.parent_type = 'block_id' then 'block_not_found' when u.parent_type = 'team' then 'unexpected_parent_type' end as error
      from fx_block_parents b join (
        select block_id, arg_max(parent_type, hops) as parent_type, arg_max(parent_id, hops) as parent_id from up group by block_id) u
      on b.block_id = u.block_id""", """
      up as (
        select block_id, parent_type, parent_id, 0 as hops from fx_block_parents
        union all
        select u.block_id, p.parent_type, p.parent_id, u.hops + 1 from up u join fx_block_parents p
        on u.parent_type = 'block_id' and u.parent_id = p.block_id)""", True)
    orphans = """flagged as (
      select c.*, c.parent_id <> '' and p.id is null as is_orphaned from fx_registry c left join fx_registry p on c.parent_id = p.id)"""
    add("folder_listing", """
      select folder, count(*) as pages, count(*) filter (is_root) as roots, count(*) filter (is_orphaned) as orphans
      from flagged group by folder""", orphans)
    add("page_listing", f"""
      select folder, id, concat('  ', file_path, ' - "', title, '" (last synced: ', {MONTHS}, ')',
             case when is_orphaned then ' (ORPHANED - parent deleted)' else '' end) as line from flagged""", orphans)
    add("tree_listing", """
      select folder, root_id, id, depth, sort_key, is_last from tree""", """
      edges as (
        select parent_id, c_custkey as position, id as child_id, folder from fx_customer
        union all select parent_id, o_orderkey, id, folder from fx_order
        union all select parent_id, n_nationkey, id, folder from fx_nation),
      shown as (
        select e.*, e.position = max(e.position) over (partition by e.parent_id) as is_last
        from edges e join fx_registry p on e.parent_id = p.id and p.folder = e.folder),
      tree as (
        select folder, id as root_id, id, 0 as depth, '' as sort_key, true as is_last from fx_region
        union all
        select t.folder, t.root_id, s.child_id, t.depth + 1, concat(t.sort_key, lpad(upper(to_hex(s.position)), 10, '0')), s.is_last
        from tree t join shown s on s.parent_id = t.id)""", True)
    sql["tree_order"] = f"""
      select folder, root_id, id, depth, row_number() over (partition by folder, root_id order by sort_key) - 1 as place, is_last
      from ({sql["tree_listing"]}) listed"""
    add("folder_status", f"""
      select folder, folder is null as is_total, cast(sum(pages) as bigint) as pages, cast(sum(roots) as bigint) as roots,
             {EPOCH.format('max(last_synced)')} as last_synced, cast(sum(queued_pages) as bigint) as queued_pages,
             cast(sum(queued_legacy_only) as bigint) as queued_legacy_only, {MONTHS.replace('last_synced', 'max(last_synced)')} as age
      from joined group by rollup (folder)""", """
      joined as (
        select p.*, coalesce(q.n, 0) as queued_pages, coalesce(q.o, 0) as queued_legacy_only
        from (select folder, count(*) as pages, count(*) filter (is_root) as roots, max(last_synced) as last_synced
              from fx_registry group by folder) p
        left join (select folder, count(*) as n, count(*) filter (legacy) as o from fx_queue_rows group by folder) q using (folder))""")

    add("pull_decisions", f"select id, {seconds('last_edited')}, tracked, folder, decision from decided", decided(), True)
    queued = decided() + ", q as (select *, 'update' as type, null as parent_id from decided where decision = 'queue'),"
    add("pull_queue", f"select seq, pos, type, folder, id as page_id, {seconds('last_edited')} from numbered",
        queued + numbered("q", "last_edited desc, id", 1000), True)
    add("pull_counters", COUNTERS.format("decided"), decided("asia"), True)
    add("pull_limited", COUNTERS.format("cut"), decided(None, False) + """,
      edge as (select last_edited as b, id as bid from decided where decision = 'queue' order by last_edited desc, id limit 1 offset 24),
      marked as (select d.*, d.last_edited < e.b or (d.last_edited = e.b and d.id > e.bid) as after from decided d left join edge e on true),
      cut as (select * replace (case when after and exists (select 1 from marked where after and decision <> 'unchanged')
                                then 'not_reached' else decision end as decision) from marked)""", True)
    add("pull_bounds", f"""
      select 3 as version, string_agg(distinct folder, ',' order by folder) as folders,
             {EPOCH.format("timestamp '2024-06-01'")} as last_pull_time, {EPOCH.format('min(last_edited)')} as oldest_pull_result
      from decided where decision = 'queue'""", decided(), True)
    add("workspace_pages", "select id, title from fx_pages where parent_id = '' and contains(lower(title), 'a')")
    add("newest_pages", f"""
      select id, {EPOCH.format('last_edited')} as last_edited_time from fx_pages order by last_edited desc, id limit 100""")

    add("queue_log_rows", """
      select seq, pos, type, folder, null as parent_id, page_id, cast(turn = 1 as int) as attempts from turns where turn <> 0
      union all select seq + (select max(seq) + 1 from turns), pos, type, folder, parent_id, page_id, 0 from numbered""", """
      waiting as (
        select seq, pos, type, folder, page_id from fx_queue_rows
        union all
        select 1000 - row_number() over (order by c_custkey % 50, id), 0, 'update', folder, id from fx_customer where c_custkey % 3 = 0),
      turns as (select *, ((seq + pos) % 3 + 3) % 3 as turn from waiting),
      q as (select 'init' as type, folder, parent_id, id as page_id, o_orderkey from fx_order where o_orderkey % 5 = 0),""" + numbered("q", "o_orderkey, page_id", 0))
    add("queue_order", f"""
      select row_number() over (order by seq, pos) - 1 as turn, seq, pos, type, folder, page_id,
             case when not legacy then {EPOCH.format('last_edited')} end as last_edited, legacy from fx_queue_rows""")
    add("queue_chunks", "select seq, pos, type, folder, page_id from numbered",
        "q as (select type, folder, null as parent_id, page_id, last_edited from fx_queue_rows),"
        + numbered("q", "last_edited desc, page_id", 1000))
    add("queue_skip", "select seq, pos, page_id, registered, skip from skips", SKIPS)
    add("queue_budget", """
      select seq, pos, page_id, coalesce(spent, 0) < 100 and file <= 60 as in_budget from (
        select *, sum(case when skip then 0 else 1 end) over (order by seq, pos rows between unbounded preceding and 1 preceding) as spent,
               dense_rank() over (order by seq) as file from skips)""", SKIPS)
    files = """files as (
      select seq, folder, type, count(*) as n, count(*) filter (legacy) as o from fx_queue_rows group by seq, folder, type)"""
    add("queue_summary", """
      select folder, type, count(*) as files, cast(sum(n) as bigint) as pages, cast(sum(o) as bigint) as pages_legacy_only from files group by folder, type""", files)
    add("queue_by_folder", """
      select folder, cast(coalesce(sum(n) filter (type = 'init'), 0) as bigint) as init,
             cast(coalesce(sum(n) filter (type = 'update'), 0) as bigint) as "update", cast(sum(n) as bigint) as pages from files group by folder""", files)
    add("queue_remaining", """
      select seq, type, folder, string_agg(page_id, ',' order by pos) as pages from skips where not skip group by seq, type, folder""", SKIPS)
    add("folders_in_use", "select folder, min(seq) as first_seen from fx_queue_rows group by folder")
    add("error_split", f"""
      select *, case when status in (401, 403, 404) or (status = 400 and code = 'validation_error') or no_data_sources
                     then 'drop' else 'retry' end as action from (
        select {key_id('event', 'event_id')} as page_id, cast([401, 403, 404, 400, 429, 500][event_id % 6 + 1] as int) as status,
               case when event_id % 4 = 3 then 'validation_error' else 'rate_limited' end as code, event_id % 10 = 0 as no_data_sources
        from events)""")

    add("page_slugs", """
      select doc_id, cast(line_no as int) as line_no, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             lower(strip_accents(line)), '[ _/\\\\:|]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'),
             '^[^a-z]+|-$', '', 'g'), 1, 100), '-$', ''), ''), 'untitled') as slug from (
        select doc_id, unnest(l) as line, unnest(range(len(l))) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents))""")
    add("page_paths", "select id, file_path from all_paths", PATHS.format(order_id="o.id"))
    add("path_collisions", """
      select count(*) as pages, count(distinct lower(file_path)) as paths, count(distinct lower(file_path)) - count(*) as missing from all_paths""",
        PATHS.format(order_id="concat(substr(md5(cast(o_orderkey % 8 as varchar)), 1, 4), substr(o.id, 5))"))

    page_head = doc_header("'notes'", "concat('notes/note-', cast(d.doc_id as varchar), '.md')", "2024-05-01T00:00:00Z",
                           "d.parent_id", "case when d.doc_id % 2 = 0 then 'true' else 'false' end")
    add("render_pages", f"""
      select id as page_id, concat('notes/note-', cast(doc_id as varchar), '.md') as file_path, cast(0 as bigint) as part_no, content,
             sha256(content) as content_hash from (
        select d.id, d.doc_id, concat({page_head}, '# ', d.title, {NL}, {NL}, b.body) as content
        from fx_doc_pages d join bodies b on d.doc_id = b.doc_id join fx_users u on d.author = u.id)""", BODIES)
    add("render_kinds", f"""
      select id as page_id, file_path, cast(0 as bigint) as part_no, content, sha256(content) as content_hash from (
        select id, concat('crm/c-', k, '.md') as file_path, concat({kind_header()}, '# ', c_name, {NL}, {NL}, {kind_body()}) as content
        from (select *, cast(c_custkey as varchar) as k, c_custkey % 2 = 0 as even from fx_customer_row) c)""")
    add("block_paths", """
      select md5(concat('block:', cast(doc_id as varchar), ':', cast(line_no as varchar))) as block_id,
             case when slot = 3 then 1 else 0 end as level, case when slot = 3 then 1 else 0 end as depth,
             case when slot = 3 then concat(cast(line_no - 1 as varchar), '.0') else cast(line_no as varchar) end as path
      from pieces""", BODIES)
    add("block_depth_limit", f"""
      select {key_id('order', 'l_orderkey')} as page_id, least(count(*), 4) as blocks_kept, count(*) >= 4 as was_limited
      from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as place
            from (select distinct l_orderkey, l_linenumber from lineitem) x) y
      where l_linenumber = place group by l_orderkey""")
    db_path = "concat('data/', slug, '.md')"
    add("render_databases", f"""
      select id as page_id, {db_path} as file_path, cast(0 as bigint) as part_no, content, sha256(content) as content_hash from (
        select d.id, d.slug, concat({db_header('d.id', "'data'", db_path, 'null', 'd.parent_id')}, '# ', d.title, {NL}, {NL},
               'All about ', d.title, {NL}, {NL},
               coalesce(l.listing || {NL}, concat('*This database has no direct child pages.*', {NL}, {NL}))) as content
        from (select id, title, parent_id, lower(replace(title, '#', '')) as slug from fx_databases
              union all select {key_id('db', 'title')}, title, id, lower(replace(title, ' ', '-')) from fx_region) d
        left join lists l on d.title = l.p_brand)""", LISTS)
    add("entry_properties", f"""
      select {key_id('part', 'p_partkey')} as id, concat(
        '  Done: ', case when p_size > 25 then 'true' else 'false' end, {NL},
        '  Key: ', case when p_partkey % 2 = 0 then concat('"P-', cast(p_partkey as varchar), '"') else cast(p_partkey as varchar) end, {NL},
        '  Price: ', regexp_replace(cast(p_retailprice as varchar), '\\.0$', ''), {NL},
        case when p_partkey % 3 = 0 then concat('  Site: "https://example.com/', cast(p_partkey as varchar), '"', {NL}) else '' end,
        '  Size: ', cast(p_size as varchar), {NL}, '  Type: "', p_type, '"', {NL},
        case when p_size % 2 = 0 then concat('  alpha: ', {NL}, '    - "', p_type, '"', {NL}, '    - "say \\"hi\\""', {NL}) else '' end) as lines
      from part""")
    add("user_labels", f"""
      select d.id, {label('u')} as author, concat('Ed [', substr(d.id, 1, 8), ']') as editor
      from fx_doc_pages d join fx_users u on d.author = u.id""")
    add("unknown_users", """
      select distinct author as id from fx_doc_pages where author not in (select id from fx_users where type = 'bot')""")
    add("child_ids", f"""
      select {key_id('nation', 'c_nationkey')} as parent_id,
             row_number() over (partition by c_nationkey order by c_custkey) - 1 as position,
             {key_id('customer', 'c_custkey')} as child_id from customer""")
    add("database_children", f"""
      select {key_id('db', 'p_brand')} as parent_id, row_number() over (partition by p_brand order by p_partkey) - 1 as position,
             {key_id('part', 'p_partkey')} as child_id from part""")
    add("database_sources", f"""
      select id as page_id, case when left(id, 1) < '4' then 'database' when left(id, 1) < '8' then 'retry' else 'drop' end as result
      from (select id from fx_databases union all select {key_id('db', 'title')} from fx_region)""")
    add("new_children", f"""
      select 'init' as type, n.folder, n.id as parent_id, page_id, position from (
        select c_nationkey, c_custkey, {key_id('customer', 'c_custkey')} as page_id,
               row_number() over (partition by c_nationkey order by c_custkey) - 1 as position from customer) c
      join fx_nation n on c.c_nationkey = n.n_nationkey where c_custkey % 7 = 0""")

    add("registry_overlay", """
      select c.id, case when c.c_custkey % 6 = 0 or c.c_custkey % 4 = 1 then 'pending' else 'stored' end as folder, c.title
      from fx_customer c where c.c_custkey % 10 <> 0""")
    add("registry_union", f"""
      select {key_id('customer', 'c_custkey')} as id, case when c_custkey % 4 <> 1 then 'stored' when c_custkey % 2 = 0 then 'dashed'
             else 'normalised' end as folder from customer
      where c_custkey % 9 <> 0 and (c_custkey % 4 <> 1 or c_custkey % 2 = 0 or c_custkey % 3 = 0)""")
    add("compact_merge", f"""
      select c.id, case when c.c_custkey % 3 = 0 then 'normalised' when c.c_custkey % 2 = 0 then 'dashed'
             else 'bare' end as folder, {key_id('nation', 'x.c_nationkey')} as parent_id
      from fx_customer c join customer x on c.c_custkey = x.c_custkey""")
    add("compact_files", f"""
      select {key_id('part', 'p_partkey')} as id, p_name as title,
             concat('https://bucket.example.com/', cast(p_partkey as varchar), '.png') as source_url from part""")
    add("compact_counters", """
      select kind, count(*) as files, count(distinct replace(id, '-', '')) as records from (
        select id, case when file_name like 'file-%' then 'file' when file_name like 'user-%' then 'user'
               when file_name like 'note-%' then null else 'page' end as kind from fx_legacy) where kind is not null group by kind""")
    add("shard_occupancy", f"""
      select left(id, 2) as shard, count(*) as records, cast(sum(strlen({RECORD_LINE}) + 1) as bigint) as bytes from fx_registry group by left(id, 2)""")
    add("index_lines", f"select left(id, 2) as shard, id, {RECORD_LINE} as line from fx_registry")
    add("shard_keys", """
      select file_name, id, case when length(id) >= 2 then left(replace(id, '-', ''), 2)
             else lpad(to_hex((xor(197, ascii(id)) * 147) % 256), 2, '0') end as shard from fx_legacy""".replace(
        "to_hex(", "lower(to_hex(").replace("% 256)", "% 256))"))
    add("reindex_latest", f"""
      select id, type, folder, file_path, title, {seconds('last_edited')}, cast(null as bigint) as last_synced, is_root, parent_id
      from latest""", PARSED)
    add("reindex_duplicates", "select id, path, kept_path from extra", PARSED)
    add("reindex_rejects", """
      select path, case when doc_id % 37 = 5 then 'no_header' else 'header_not_closed' end as reject from fx_markdown
      where doc_id % 50 <> 7 and (doc_id % 37 = 5 or doc_id % 41 = 3)""")
    add("reindex_counters", """
      select 'total_files' as metric, count(*) as value from fx_markdown where doc_id % 50 <> 7
      union all select 'rejected_files', count(*) from fx_markdown where doc_id % 50 <> 7 and (doc_id % 37 = 5 or doc_id % 41 = 3)
      union all select 'unique_pages', count(*) from latest
      union all select 'duplicate_ids', count(*) from (select id from accepted group by id having count(*) > 1)
      union all select 'files_to_delete', count(*) from extra""", PARSED)
    add("document_diff", """
      select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'deleted'
             when o.content = n.content then 'unchanged' else 'modified' end as change,
             coalesce(o.path, n.path) like '.notion-sync/queue/%' as is_queue
      from (select * from fx_published where edition = 'old') o full join (select * from fx_published where edition = 'new') n on o.path = n.path""")

    add("commit_log", f"""
      select 1 as commit, page_id, before as path, sha256(text) as content_hash, 'new' as change from d
      union all select 2, page_id, after, sha256(edited), case when before = after then 'modified' else 'new' end from d
        where before <> after or text <> edited
      union all select 2, page_id, before, null, 'deleted' from d where before <> after""", f"""
      d as (select {key_id('doc', 'doc_id')} as page_id, text, concat(text, case when doc_id % 4 = 0 then concat({NL}, 'edited') else '' end) as edited,
                   concat(lang, '/doc-', cast(doc_id as varchar), '.md') as before,
                   concat(case when doc_id % 3 = 0 then source else lang end, '/doc-', cast(doc_id as varchar), '.md') as after
            from documents)""")

    add("root_manifest", """
      select page_id, line_no, folder, enabled, url, regexp_matches(folder, '^[a-z0-9-]+$') as folder_ok from listed""", ROOT_LINES)
    reconciled = ROOT_LINES + """,
      reconciled as (
        select coalesce(k.id, m.page_id) as id, coalesce(m.folder, k.folder) as folder, m.page_id is not null or k.is_root as is_root,
               coalesce(m.enabled, k.enabled) as enabled, m.page_id is not null and k.last_synced is null as needs_sync
        from (select id, folder, is_root, enabled, last_synced from fx_region
              union all select id, folder, is_root, enabled, last_synced from fx_nation
              union all select id, folder, is_root, enabled, last_synced from fx_customer where c_custkey % 3 <> 0) k
        full join listed m on k.id = m.page_id)"""
    add("root_reconcile", "select id, folder, is_root, enabled, needs_sync from reconciled", reconciled)
    add("root_queue", "select seq, pos, type, folder, id as page_id from numbered", reconciled + """,
      q as (select 'init' as type, folder, null as parent_id, id from reconciled where needs_sync and enabled),"""
        + numbered("q", "id", 1000))
    add("root_text", """
      select 1 + row_number() over (order by line_no) as line_no,
             concat('- [', case when enabled then 'x' else ' ' end, '] **', folder, '**: ', url) as text from listed
      union all select 0, '# Root Pages' union all select 1, ''""", ROOT_LINES)
    add("ids_in_links", """
      select page_id, concat(url, '#', md5(url)) as link, null as found_id from pages
      union all select page_id, concat('https://example.com/team/A-Page-', md5(url), '?v=', cast(page_id as varchar)), md5(url) from pages""")

    add("attachment_names", "select file_id, file_path, is_new, page_id, source_url, too_large from sized", LINKS)
    add("attachment_links", """
      select l.page_id, cast(l.position as int) as position, l.file_id, case when s.file_id is null then l.other_url when s.too_large
             then concat(l.bare, '?sig=', l.sig) else substr(s.file_path, 5) end as shown
      from links l left join sized s on l.file_id = s.file_id""", LINKS)
    add("attachment_sizes", """
      select strlen(text) > 4096 as over_limit, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1""")
    add("hosted_links", "select file_id, count(*) as links from links group by file_id", LINKS)

    add("event_status", """
      select case when s.event_id % 50 = 1 then null else cast(s.event_id as varchar) end as event_id,
             epoch_us(received_at) as received_at, status, route from fx_event_status s""")
    add("event_queue", """
      select 999 - (row_number() over (order by received_at, cast(event_id as varchar)) - 1) as seq, 'update' as type,
             coalesce(c.folder, 'default') as folder, entity_id as page_id, epoch_us(received_at) as arrived
      from fx_event_status e left join (select * from fx_customer where c_custkey % 3 <> 0) c on e.entity_id = c.id where route = 'queue'""")
    add("event_routes", "select status, route, count(*) as events from fx_event_status group by status, route")
    add("event_coalesced", """
      select e.entity_id as page_id, epoch_us(last_edited_at) as last_edited, notifications from (
        select entity_id, max(received_at) as last_edited_at, count(*) as notifications from fx_event_status where route = 'queue' group by entity_id) e
      left join fx_customer c on e.entity_id = c.id
      where c.id is null or last_edited_at > case when c_custkey % 2 = 0 then timestamp '2024-01-30 12:00:00' else c.last_edited end""")
    add("event_debounce", """
      select entity_id, epoch_us(min(received_at)) as first_at, epoch_us(max(received_at)) as last_at, count(*) as events from (
        select *, sum(starts) over (partition by entity_id order by received_at, event_id) as burst from (
          select *, case when received_at - lag(received_at) over (partition by entity_id order by received_at, event_id) <= interval '4' hour
                         then 0 else 1 end as starts from fx_event_status where route = 'queue')) group by entity_id, burst""")
    add("event_periods", f"""
      select {EPOCH.format("date_trunc('hour', received_at)")} as period_start, coalesce(route, status) as route, count(*) as events
      from fx_event_status group by 1, 2""")
    add("event_deletions", """
      select cast(event_id as varchar) as event_id, entity_id, event_type, epoch_us(received_at) as received_at
      from fx_event_status where route = 'deletion'""")

    add("sync_placement", """
      select id, 'page' as type, folder, file_path, title, false as is_root, false as enabled, parent_id from doc_files
      union all select id, 'database', folder, file_path, title, false, false, parent_id from db_files""", SYNC)
    add("sync_outcomes", """
      select seq, cast(row_number() over (partition by seq order by doc_id) - 1 as int) as pos, id as page_id, outcome from judged
      union all select seq, 0, id, outcome from dbs""", SYNC)
    add("sync_counters", """
      select 'processed' as metric, count(*) filter (outcome in ('written', 'no_root')) as value from o
      union all select 'skipped', 0 union all select 'dropped', count(*) filter (outcome = 'dropped') from o
      union all select 'kept', count(*) filter (outcome = 'retry') from o
      union all select 'files_written', (select count(*) from doc_files) + (select count(*) from db_files)""",
        SYNC + ", o as (select outcome from judged union all select outcome from dbs)")
    add("sync_child_queue", "select seq, pos, type, folder, parent_id, page_id from numbered", SYNC + f""",
      q as (select 'init' as type, d.folder, d.id as parent_id, {key_id('part', 'p_partkey')} as page_id, p_partkey
            from part join db_files d on p_brand = d.title),""" + numbered("q", "p_partkey", 5000))
    sync_head = doc_header("f.folder", "f.file_path", "2024-06-01T00:00:00Z", "d.parent_id", "'false'")
    add("sync_documents", f"""
      select page_id, file_path, cast(0 as bigint) as part_no, sha256(content) as content_hash, cast(length(content) as int) as chars from (
        select d.id as page_id, f.file_path, concat({sync_head}, '# ', d.title, {NL}, {NL}, b.body) as content
        from fx_doc_pages d join doc_files f on d.id = f.id join bodies b on d.doc_id = b.doc_id join fx_users u on d.author = u.id
        union all
        select d.id, d.file_path, concat({db_header('d.id', 'd.folder', 'd.file_path', "'2024-06-01T00:00:00Z'", 'd.parent_id')},
               '# ', d.title, {NL}, {NL}, 'All about ', d.title, {NL}, {NL}, l.listing, {NL})
        from db_files d join lists l on d.title = l.p_brand)""", SYNC + "," + BODIES + "," + LISTS)
    add("add_roots", """
      select id, 'database' as type, 'data' as folder, concat('data/', lower(replace(title, '#', '')), '.md') as file_path,
             true as is_root, true as enabled, '' as parent_id from fx_databases""")
    return sql
