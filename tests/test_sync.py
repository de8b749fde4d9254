"""Pull, sync and the jobs around them on a small workspace."""

import hashlib
import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.catalog import records
from leafwork.catalog.views import Views
from leafwork.operators import ordering, render
from leafwork.operators.users import enrich_users, unknown_users
from leafwork.plans import maintenance, pull, sync
from leafwork.session import staged
from leafwork.sources import index, landed
from leafwork.streaming import incremental

NOW = datetime(2024, 6, 1)
T0 = datetime(2024, 1, 1)


def text(value):
    return [{"type": "text", "plain_text": value}]


def page(id_, title, parent=None, edited="2024-01-05T00:00:00Z", **fields):
    where = {"type": "workspace", "workspace": True} if parent is None else parent if isinstance(parent, dict) else {"type": "page_id", "page_id": parent}
    return {"object": "page", "id": id_, "last_edited_time": edited, "parent": where, "url": f"https://w/{id_}",
            "created_by": {"id": "user-0001"}, "properties": {"title": {"type": "title", "title": text(title)}}, **fields}


def block(id_, page_id, at, kind, parent=None, **fields):
    return {"page_id": page_id, "block_id": id_, "parent_id": parent or page_id, "ordinal": at, "type": kind,
            "has_children": False, "is_toggleable": False, "payload_present": True, **fields}


def load(spark, tmp_path, name, rows, reader):
    path = tmp_path / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return reader(spark, str(path))


def read(schema):
    return lambda spark, path: landed.read_landed(spark, path, schema)


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    pages = [page("root-1", "Wiki"), page("off-1", "Off"), page("kid-1", "Guide", "root-1"), page("kid-2", "Guide", "root-1"),
             page("deep-1", "Deep", "mid-1"), page("mid-1", "Middle", "root-1"), page("stray", "Stray", "nowhere"),
             page("below-off", "Hidden", "off-1"), page("in-block", "Inside", {"type": "block_id", "block_id": "blk-1"}),
             page("row-1", "Row", {"type": "database_id", "database_id": "db-1"}), page("top-2", "Loose")]
    containers = [{"id": "db-1", "title": text("Tasks"), "description": [], "last_edited_time": "2024-01-05T00:00:00Z",
                   "parent": {"type": "page_id", "page_id": "root-1"}, "data_sources": [{"id": "ds", "name": "d"}]},
                  {"id": "db-2", "title": text("None"), "parent": {"type": "workspace"}, "data_sources": []}]
    entries = [{**page("row-1", "Row", {"type": "database_id", "database_id": "db-1"}), "position": 0}]
    blocks = [
        block("p1", "kid-1", 0, "paragraph", rich_text=text("hello")),
        block("blk-1", "kid1", 1, "column", has_children=True),
        block("in-block", "kid1", 0, "child_page", parent="blk-1", title="Inside"),
        block("img", "kid-1", 2, "image", file_url="https://b.s3.x.amazonaws.com/ws/file-1/Pic.PNG?sig=1"),
        block("fresh-1", "root-1", 0, "child_page", title="Fresh"), block("kid-1", "root-1", 1, "child_page", title="Guide"),
    ]
    databases, rejects = landed.join_databases(
        load(spark, folder, "containers", containers, read(schemas.CONTAINER)),
        load(spark, folder, "sources", [{"id": "ds", "name": "d"}], read(schemas.DATA_SOURCE)))
    assert [(r["page_id"], r["no_data_sources"]) for r in rejects.collect()] == [("db2", True)]
    registry = spark.createDataFrame(
        [("root1", "page", "tech", "tech/wiki.md", "Wiki", T0, T0, True, True, "", None, None),
         ("off1", "page", "old", "old/off.md", "Off", T0, T0, True, False, "", None, None),
         ("kid2", "page", "tech", "tech/wiki/guide.md", "Guide", datetime(2024, 1, 5), T0, False, False, "root1", None, None)],
        schemas.REGISTRY)
    return sync.Workspace(
        pages=load(spark, folder, "pages", pages, landed.read_pages), databases=databases,
        entries=load(spark, folder, "entries", entries, landed.read_entries),
        blocks=load(spark, folder, "blocks", blocks, landed.read_blocks),
        users=load(spark, folder, "users", [{"id": "user-0001", "name": "Ann", "type": "person", "email": "ann@x"}], landed.read_users),
        registry=registry,
        files=spark.createDataFrame([], schemas.FILES), file_sizes=spark.createDataFrame([], "file_id STRING, size BIGINT"),
        file_manifests=spark.createDataFrame([], "path STRING, file_id STRING"),
        errors=rejects.unionByName(spark.createDataFrame([("gone", 404, None, False), ("busy", 500, None, False)], schemas.ERRORS)))


def queue(spark, *ids, type_="update", edited=datetime(2024, 1, 5), folder="tech"):
    pages = [(i, edited) for i in ids]
    return spark.createDataFrame(
        [(1000 + n, type_, folder, pages[n * 10:n * 10 + 10], None, None) for n in range(-(-len(pages) // 10))],
        "seq BIGINT, type STRING, folder STRING, pages ARRAY<STRUCT<id: STRING, last_edited: TIMESTAMP>>, pageIds ARRAY<STRING>, parentId STRING")


ASKED = ("kid-1", "kid2", "deep-1", "stray", "below-off", "in-block", "db-1", "off-1", "gone", "busy", "missing", "root-1", "kid1", "top-2", "db-2")
OPTIONS = sync.SyncOptions(now=NOW)


@pytest.fixture(scope="module")
def synced(spark, workspace):
    return sync.sync(workspace, queue(spark, *ASKED), OPTIONS)


def test_outcomes(synced):
    got = [(r["page_id"], r["outcome"]) for r in synced.outcomes.orderBy("seq", "pos").collect()]
    assert got == [
        ("kid1", "written"), ("kid2", "skipped"), ("deep1", "written"), ("stray", "no_root"), ("belowoff", "no_root"),
        ("inblock", "written"), ("db1", "written"), ("off1", "root_disabled"), ("gone", "dropped"), ("busy", "retry"),
        ("missing", "retry"), ("root1", "written"), ("kid1", "written"), ("top2", "no_root"), ("db2", "dropped")]
    assert sorted(r["page_id"] for r in synced.remaining.collect()) == ["busy", "missing"]
    counts = {r["metric"]: r["value"] for r in sync.sync_counters(synced.outcomes, synced.written.registry).collect()}
    assert counts == {"processed": 10, "skipped": 1, "dropped": 2, "kept": 2, "files_written": 6}


def test_documents_and_registry(synced):
    rows = {r["id"]: r for r in synced.written.registry.collect()}
    assert {i: r["file_path"] for i, r in rows.items()} == {
        "root1": "tech/wiki.md", "kid1": "tech/wiki/guide-kid1.md", "mid1": "tech/wiki/middle.md",
        "deep1": "tech/wiki/middle/deep.md", "inblock": "tech/wiki/guide-kid1/inside.md", "db1": "tech/wiki/tasks.md"}
    assert rows["root1"]["is_root"] and rows["root1"]["enabled"] and not rows["kid1"]["is_root"]
    assert rows["inblock"]["parent_id"] == "kid1" and rows["mid1"]["folder"] == "tech"
    documents = {r["page_id"]: r["content"] for r in synced.written.documents.collect()}
    assert set(documents) == set(rows)
    assert 'created_by: "Ann <ann@x> [user-000]"' in documents["kid1"]
    assert documents["kid1"].endswith(
        "# Guide\n\nhello\n\n- [Inside](./guide/inside.md)<!-- page_id:inblock -->\n\n![image](guide-kid1/files/pic.png)<!-- file_id:img -->\n")
    assert documents["db1"].endswith("# Tasks\n\n- [Row](./tasks/row.md)<!-- page_id:row1 -->\n\n")
    assert [r["file_path"] for r in synced.written.files.collect()] == ["tech/wiki/guide-kid1/files/pic.png"]


def test_children(synced):
    edges = {(r["parent_id"], r["position"], r["child_id"]) for r in synced.written.children.collect()}
    assert edges == {("kid1", 0, "inblock"), ("root1", 0, "fresh1"), ("root1", 1, "kid1"), ("db1", 0, "row1")}
    queued = {(r["type"], r["folder"], r["parent_id"], r["page_id"]) for r in synced.written.child_queue.collect()}
    assert queued == {("init", "tech", "root1", "fresh1"), ("init", "tech", "db1", "row1")}


def test_second_run_changes_nothing(spark, workspace, synced):
    fresh = synced.written.registry.select("id")
    after = staged(workspace.registry.drop("children").join(fresh, "id", "left_anti").unionByName(synced.written.registry))
    again = sync.judge_queue(replace(workspace, registry=after), queue(spark, "kid-1", "deep-1", "in-block", "db-1", "root-1", "mid-1"), OPTIONS)
    assert {r["outcome"] for r in again.outcomes.collect()} == {"skipped"}
    later = queue(spark, "kid-1", "deep-1", "db-1", edited=NOW)
    placed = sync.judge_queue(replace(workspace, registry=after), later, OPTIONS)
    paths = sync.place_items(replace(workspace, registry=after), placed.items, placed.due, OPTIONS)
    assert {r["id"]: r["file_path"] for r in paths.collect()} == {
        "kid1": "tech/wiki/guide-kid1.md", "deep1": "tech/wiki/middle/deep.md", "db1": "tech/wiki/tasks.md"}


def test_registry_goes_through_the_index(spark, workspace, synced, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], "id STRING")
    index.write_index(workspace.registry, none, path)
    index.write_index(synced.written.registry, none, path)
    stored = staged(index.read_index(spark, path))
    again = sync.judge_queue(replace(workspace, registry=stored), queue(spark, "kid-1", "deep-1", "in-block", "db-1", "root-1"), OPTIONS)
    assert {r["outcome"] for r in again.outcomes.collect()} == {"skipped"}
    assert {r["id"] for r in stored.collect()} >= {"root1", "kid1", "mid1", "deep1", "inblock", "db1", "off1"}


def test_hash_covers_every_part(spark):
    """The hash is that of the whole text, however it was cut."""
    text = {"a": "".join(f"line {i} ü\n" for i in range(200)), "b": "short", "c": "x" * 999}
    for size in (7, 100, 10_000):
        parts = [(k, n, t[at:at + size], hashlib.sha256(t[at:at + size].encode()).hexdigest())
                 for k, t in text.items() for n, at in enumerate(range(0, len(t), size))]
        frame = spark.createDataFrame(parts[::-1], "page_id STRING, part_no BIGINT, content STRING, content_hash STRING")
        got = {r["page_id"]: r["content_hash"] for r in sync.document_hashes(frame).collect()}
        assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in text.items()}


def test_budget_keeps_the_rest(spark, workspace):
    limited = sync.judge_queue(workspace, queue(spark, *ASKED), replace(OPTIONS, max_pages=3))
    got = {r["page_id"]: r["outcome"] for r in limited.outcomes.orderBy("seq", "pos").collect()}
    assert (got["kid1"], got["kid2"], got["deep1"], got["stray"]) == ("waiting", "skipped", "written", "no_root")
    assert len([o for o in limited.outcomes.collect() if o["outcome"] == "waiting"]) == 11
    other = sync.judge_queue(workspace, queue(spark, "kid-1", folder="x"), replace(OPTIONS, folder="tech"))
    assert other.outcomes.isEmpty() and [r["page_id"] for r in other.remaining.collect()] == ["kid1"]


def test_get_scan_and_add(spark, workspace):
    wanted = spark.createDataFrame([("deep1",), ("top2",)], "id STRING")
    got = maintenance.get_pages(workspace, wanted, replace(OPTIONS, folder="loose"))
    assert {r["id"]: (r["file_path"], r["is_root"]) for r in got.registry.collect()} == {
        "mid1": ("tech/wiki/middle.md", False), "deep1": ("tech/wiki/middle/deep.md", False), "top2": ("loose/loose.md", True)}
    fresh = maintenance.new_children(workspace.blocks, workspace.registry, spark.createDataFrame([("root1",), ("kid2",)], "id STRING"))
    assert [(r["page_id"], r["folder"]) for r in fresh.orderBy("position").collect()] == [("fresh1", "tech"), ("kid1", "tech")]
    roots = spark.createDataFrame([("db1", "data", True), ("kid1", "docs", False), ("top2", "Bad Name", False)],
                                  "id STRING, folder STRING, force_update BOOLEAN")
    added = maintenance.add_roots(workspace, roots, OPTIONS)
    assert {r["id"]: (r["file_path"], r["is_root"], r["enabled"], r["parent_id"]) for r in added.registry.collect()} == {
        "db1": ("data/tasks.md", True, True, ""), "kid1": ("docs/guide.md", True, True, "")}
    assert {(r["type"], r["page_id"]) for r in added.child_queue.collect()} == {("update", "row1"), ("init", "inblock")}


def decide(spark, workspace, **options):
    pages = workspace.pages
    nodes = pull.workspace_nodes(pages, workspace.databases)
    chosen = pull.PullOptions(cutoff=datetime(2024, 1, 2), **options)
    return staged(pull.classify_changes(pages, nodes, workspace.registry, chosen)), chosen


def test_pull(spark, workspace):
    decided, options = decide(spark, workspace)
    got = {r["id"]: r["decision"] for r in decided.collect()}
    assert {i for i, d in got.items() if d == "queue"} == {"root1", "kid2"}
    assert got["off1"] == "root_disabled" and got["kid1"] == "untracked"
    counts = {r["metric"]: r["value"] for r in pull.pull_counters(decided, workspace.pages).collect()}
    assert counts == {"found": 11, "queued": 2, "skipped": 9, "new": 0, "updated": 2}
    state = pull.next_state(decided, spark.createDataFrame([(3, ["z", "tech"], None, None)], schemas.SYNC_STATE), options, NOW).first()
    assert state["folders"] == ["z", "tech"] and state["oldest_pull_result"] == datetime(2024, 1, 5)
    assert state["last_pull_time"] == NOW

    everything, _ = decide(spark, workspace, include_untracked=True)
    got = {r["id"]: (r["decision"], r["folder"]) for r in everything.collect()}
    assert got["deep1"] == ("queue", "tech") and got["row1"] == ("queue", "tech")
    assert got["stray"][0] == "trace_failed" and got["belowoff"][0] == "no_root" and got["top2"][0] == "no_root"

    later, options = decide(spark, workspace, bound=datetime(2024, 1, 5))
    assert later.isEmpty()
    assert pull.next_state(later, None, options, NOW).first()["oldest_pull_result"] == datetime(2024, 1, 2)


def test_pull_stops_after_max_pages(spark, workspace):
    pages = workspace.pages.withColumn(
        "last_edited_time", F.when(F.col("id") == "kid-2", F.lit(T0 + timedelta(9))).when(
            F.col("id") == "stray", F.lit(T0)).otherwise(F.col("last_edited_time")))
    changed = replace(workspace, pages=pages)
    decided, _ = decide(spark, changed, max_pages=1)
    assert {r["id"] for r in decided.where("decision = 'queue'").collect()} == {"kid2"}
    counts = {r["metric"]: r["value"] for r in pull.pull_counters(decided, pages).collect()}
    assert (counts["queued"], counts["skipped"]) == (1, 0)


def test_users(spark, workspace):
    pages = workspace.pages.where("id = 'kid-1'").withColumn("last_edited_by", F.expr(
        "named_struct('id','u-x','type','bot','name','Kept','person',cast(null as struct<email:string>))"))
    row = enrich_users(pages, workspace.users, floor=1).first()
    assert (row["created_by"]["name"], row["created_by"]["person"]["email"], row["last_edited_by"]["name"]) == ("Ann", "ann@x", "Kept")
    assert unknown_users(pages, workspace.users.where("false")).collect() == [("user-0001",)]


def test_search(spark, workspace):
    found = landed.search(workspace.pages, kind="page", query="LOO", workspace_level=True)
    assert [r["id"] for r in found.collect()] == ["top-2"]
    assert landed.search(workspace.pages, kind="database").isEmpty()
    before = landed.scan_until(workspace.pages.withColumn(
        "last_edited_time", F.when(F.col("id") == "stray", F.lit(T0)).otherwise(F.col("last_edited_time"))), F.col("id") == "stray")
    assert before.count() == 10 and landed.scan_until(workspace.pages, F.lit(False)).count() == 11


def test_sync_of_a_micro_batch(spark, workspace, tmp_path):
    rows = spark.createDataFrame(
        [(998, 0, "update", "tech", None, "deep1", NOW), (999, 0, "update", "tech", None, "busy", NOW)],
        "seq BIGINT, pos INT, type STRING, folder STRING, parent_id STRING, page_id STRING, last_edited TIMESTAMP")
    hook = incremental.sync_batch(lambda: workspace, lambda: OPTIONS, str(tmp_path))
    for _ in range(2):  # a replay overwrites
        hook(rows, 7)
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("documents", "registry", "retry")}
    assert {r["page_id"] for r in tables["documents"].collect()} == {"mid1", "deep1"}
    assert {r["id"] for r in tables["registry"].collect()} == {"mid1", "deep1"}
    assert [(r["page_id"], r["batch"]) for r in tables["retry"].collect()] == [("busy", 7)]
    hot = sync.judge_queue(workspace, queue(spark, *ASKED), replace(OPTIONS, floor=1))
    plain = sync.judge_queue(workspace, queue(spark, *ASKED), OPTIONS)
    assert sorted(map(str, hot.outcomes.collect())) == sorted(map(str, plain.outcomes.collect()))


def test_pull_stages_short_ids(spark, monkeypatch):
    whole, odd = "0123456789abcdef" * 2, "Not hex"
    pages = spark.createDataFrame([(whole, T0, "top"), (odd, T0, whole)], "id string, last_edited_time timestamp, parent_id string")
    registry = spark.createDataFrame([("top", "f", "", True, True)], "id string, folder string, parent_id string, is_root boolean, enabled boolean")
    types = []
    monkeypatch.setattr(pull, "staged", lambda df: types.append(df.schema["id"].dataType.simpleString()) or staged(df))
    chosen = pull.PullOptions(cutoff=datetime(2023, 1, 1), include_untracked=True)
    nodes = pages.select("id", "parent_id").unionByName(registry.select("id", "parent_id"))
    decided = pull.classify_changes(pages, nodes, registry, chosen)
    assert types[0] == "binary"
    assert sorted((r["id"], r["folder"], r["decision"]) for r in decided.collect()) == [(whole, "f", "queue"), ("Not hex", "f", "queue")]


def test_entries_and_blocks_of_new_roots_are_read_once(spark, workspace, tmp_path, monkeypatch):
    for name in ("entries", "blocks"):
        getattr(workspace, name).write.parquet(str(tmp_path / name))
    landed_ws = replace(workspace, entries=spark.read.schema(schemas.ENTRY).parquet(str(tmp_path / "entries")),
                        blocks=spark.read.schema(schemas.BLOCK).parquet(str(tmp_path / "blocks")))
    reads, real = [], ordering.staged
    for module in (ordering, render):
        monkeypatch.setattr(module, "staged", lambda df: reads.extend(df.inputFiles()) or real(df))
    wanted = spark.createDataFrame([("db1", "data", True)], "id STRING, folder STRING, force_update BOOLEAN")
    added = maintenance.add_roots(landed_ws, wanted, OPTIONS)
    assert reads and not any(f"{tmp_path}/entries/" in file for file in reads)
    assert [(r["id"], r["file_path"]) for r in added.registry.collect()] == [("db1", "data/tasks.md")]
    assert [r["child_id"] for r in added.children.collect()] == ["row1"]
    text = added.documents.first()["content"]
    assert "page_id:row1" in text
    # blocks are not joined where no page sits in one
    nobody = replace(landed_ws, pages=workspace.pages.where("parent.type is null or parent.type <> 'block_id'"))
    plain, full = sync.workspace_items(nobody), sync.workspace_items(landed_ws)
    assert not any(f"{tmp_path}/blocks/" in file for file in plain.inputFiles())
    assert any(f"{tmp_path}/blocks/" in file for file in full.inputFiles())


def test_entries_are_made_in_many_tasks(spark, tmp_path):
    part = [(i, f"name {i}", "Brand#11", "STEEL", i % 50, 1.5) for i in range(20)]
    ddl = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    entries = records.entry_records(Views(spark, str(tmp_path)))
    assert "hashpartitioning(p_partkey" in entries._jdf.queryExecution().executedPlan().toString()
    assert entries.count() == 20
