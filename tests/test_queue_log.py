"""The queue as a log: atomic commits, replays, retries and follow-up work without help."""

import json
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.plans import sync
from leafwork.session import staged_so_far
from leafwork.sources import index, queue_log
from leafwork.streaming import events, incremental

T0 = datetime(2024, 1, 1)
ROWS = "seq BIGINT, pos INT, type STRING, folder STRING, parent_id STRING, page_id STRING, last_edited TIMESTAMP"


def rows(spark, *entries):
    return spark.createDataFrame([(seq, pos, "update", "f", None, page, T0) for seq, pos, page in entries], ROWS)


def waiting(spark, path, upto=None):
    return sorted((r["seq"], r["pos"], r["page_id"], r["attempts"]) for r in queue_log.read_log(spark, path, upto).collect())


def test_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queue_log, "BASE_EVERY", 4)
    path = str(tmp_path / "log")
    assert waiting(spark, path) == [] and queue_log.ends(queue_log.read_log(spark, path)) == (1000, 1000)
    queue_log.commit(spark, path, "pull", 0, rows(spark, (1000, 0, "a"), (1000, 1, "b"), (1001, 0, "c")))
    assert queue_log.commit(spark, path, "pull", 0, rows(spark, (7, 7, "never"))).number == 1
    again = rows(spark, (1000, 1, "b")).withColumn("attempts", F.lit(1))
    queue_log.commit(spark, path, "sync", 0, again, rows(spark, (1000, 0, "a"), (1000, 1, "b")))
    assert waiting(spark, path) == [(1000, 1, "b", 1), (1001, 0, "c", 0)]
    assert waiting(spark, path, upto=1) == [(1000, 0, "a", 0), (1000, 1, "b", 0), (1001, 0, "c", 0)]
    # a number that was done can come again
    queue_log.commit(spark, path, "pull", 1, rows(spark, (1000, 0, "d")))
    queue_log.commit(spark, path, "sync", 1, None, rows(spark, (1001, 0, "c")))
    left = [(1000, 0, "d", 0), (1000, 1, "b", 1)]
    assert waiting(spark, path) == left
    assert [c.kind for c in queue_log.commits(spark, path)] == ["change"] * 4 + ["base"]
    # a folder without its marker is an attempt that failed: nobody reads it
    half = queue_log.Commit(6, "sync", 2, queue_log.CHANGE)
    rows(spark, (5, 0, "half")).withColumns({"legacy": F.lit(False), "attempts": F.lit(0), "op": F.lit("put"), "commit": F.lit(6)}).write.parquet(f"{path}/{half.name}")
    assert waiting(spark, path) == left
    assert queue_log.forget(spark, path) == 5 and waiting(spark, path) == left
    assert queue_log.commit(spark, path, "pull", 0, rows(spark, (7, 7, "never"))).number == 1
    queue_log.commit(spark, path, "sync", 2, rows(spark, (5, 0, "whole")))
    assert waiting(spark, path) == [(5, 0, "whole", 0), *left]


def test_events_go_before_all(spark, tmp_path):
    path = str(tmp_path / "log")
    changed = lambda *pages: spark.createDataFrame(
        [("update", "f", None, page, T0 + timedelta(minutes=i)) for i, page in enumerate(pages)],
        "type STRING, folder STRING, parent_id STRING, page_id STRING, last_edited TIMESTAMP")
    queue_log.commit(spark, path, "pull", 0, rows(spark, (1000, 0, "old")))
    queue_log.add_events(spark, path, 0, changed("a", "b"))
    queue_log.add_events(spark, path, 1, changed("c", "d"))
    queue_log.add_events(spark, path, 0, changed("a", "b"))
    assert [(r[0], r[2]) for r in waiting(spark, path)] == [(996, "d"), (997, "c"), (998, "b"), (999, "a"), (1000, "old")]


def page(id_, parent, **fields):
    return {"object": "page", "id": id_, "last_edited_time": "2024-01-05T00:00:00Z", "url": "", "created_by": {"id": "u"},
            "parent": {"type": "page_id", "page_id": parent},
            "properties": {"title": {"type": "title", "title": [{"type": "text", "plain_text": id_}]}}, **fields}


def test_failed_page_is_retried_without_help(spark, tmp_path):
    """Two micro-batches: b fails in the first and is written in the second, with a child that a names."""
    path = str(tmp_path)
    stores = incremental.Stores(f"{path}/log", f"{path}/out", f"{path}/index", f"{path}/children")
    blocks = [{"page_id": "a", "block_id": "kid", "parent_id": "a", "ordinal": 0, "type": "child_page", "has_children": False, "title": "kid", "payload_present": True}]
    known = [("r", "page", "tech", "tech/r.md", "r", T0, T0, True, True, "", None, None)]
    index.write_index(spark.createDataFrame(known, schemas.REGISTRY), spark.createDataFrame([], "id STRING"), stores.index)
    base = sync.Workspace(
        pages=spark.createDataFrame([json.dumps(page(i, p)) for i, p in (("r", ""), ("a", "r"), ("b", "r"), ("kid", "a"))], "string").select(
            F.from_json("value", schemas.PAGE).alias("p")).select("p.*"),
        databases=spark.createDataFrame([], schemas.CONTAINER + ", data_source_id STRING, data_source_name STRING"),
        entries=spark.createDataFrame([], schemas.ENTRY),
        blocks=spark.createDataFrame([json.dumps(b) for b in blocks], "string").select(F.from_json("value", schemas.BLOCK).alias("b")).select("b.*"),
        users=spark.createDataFrame([], schemas.USERS), registry=spark.createDataFrame([], schemas.REGISTRY),
    )
    failing = spark.createDataFrame([("b", 500, None, False)], schemas.ERRORS)
    trouble = {"now": failing}
    workspace = lambda: replace(base, registry=index.read_index(spark, stores.index), errors=trouble["now"])
    work = incremental.queue_worker(stores, workspace, lambda: sync.SyncOptions(now=datetime(2024, 6, 1)))
    landed = tmp_path / "events"
    landed.mkdir()

    def arrive(name, *pages):
        lines = [{"received_at": "2024-02-01T00:00:00Z", "body": json.dumps({"id": f"e-{p}", "type": "page.created", "entity": {"id": p, "type": "page"}})} for p in pages]
        (landed / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
        events.ingest(
            events.read_events(spark, str(landed)), registry=lambda: index.read_index(spark, stores.index), queue_path=f"{path}/q",
            deletions_path=f"{path}/d", rejects_path=f"{path}/x", checkpoint=f"{path}/c", log_path=stores.log, others_path=f"{path}/o", after_batch=work,
        ).awaitTermination()

    def registered():
        return {r["id"]: r["file_path"] for r in index.read_index(spark, stores.index).collect()}

    arrive("one", "a", "b")
    assert registered() == {"r": "tech/r.md", "a": "tech/r/a.md"}
    assert [(r[2], r[3]) for r in waiting(spark, stores.log)] == [("b", 1), ("kid", 0)]
    trouble["now"] = None
    arrive("two", "a")  # says nothing about b or kid
    assert registered() == {"r": "tech/r.md", "a": "tech/r/a.md", "b": "tech/r/b.md", "kid": "tech/r/a/kid.md"}
    assert waiting(spark, stores.log) == []
    assert [(r["parent_id"], r["child_id"]) for r in index.read_children(spark, stores.children).collect()] == [("a", "kid")]
    before, mark = [c.name for c in queue_log.commits(spark, stores.log)], staged_so_far()
    documents = sorted(map(str, spark.read.parquet(f"{path}/out/documents").collect()))
    for batch in (0, 1):  # a replay of either batch changes nothing
        work(spark.createDataFrame([], "id STRING"), batch)
    assert before == [c.name for c in queue_log.commits(spark, stores.log)] and staged_so_far() == mark
    assert documents == sorted(map(str, spark.read.parquet(f"{path}/out/documents").collect()))
    assert len(registered()) == 4 and waiting(spark, stores.log) == []


def test_other_routes_have_a_sink(spark, tmp_path):
    landed = tmp_path / "events"
    landed.mkdir()
    bodies = [{"id": "1", "verification_token": "t"}, {"id": "2", "type": "page.locked", "entity": {"id": "x", "type": "page"}},
              {"id": "3", "type": "page.deleted", "entity": {"id": "x", "type": "page"}}, {"id": "4", "type": "page.created", "entity": {"id": "y", "type": "page"}}]
    (landed / "one.json").write_text("\n".join(json.dumps({"received_at": "2024-02-01T00:00:00Z", "body": json.dumps(b)}) for b in bodies))
    path = str(tmp_path)
    events.ingest(
        events.read_events(spark, str(landed)), registry=lambda: spark.createDataFrame([], schemas.REGISTRY), queue_path=f"{path}/q",
        deletions_path=f"{path}/d", rejects_path=f"{path}/x", checkpoint=f"{path}/c", others_path=f"{path}/o",
    ).awaitTermination()
    assert {(r["event_id"], r["route"]) for r in spark.read.parquet(f"{path}/o").collect()} == {("1", "verification"), ("2", "ignored")}


def test_periodic_commits(spark, tmp_path):
    """Two triggers: what was rendered in between is one change set, and a repeated trigger adds none."""
    from leafwork.streaming import publish

    out, commits = str(tmp_path / "out"), str(tmp_path / "commits")

    def render(batch, *rows):
        frame = spark.createDataFrame([(p, f, n, "", h) for p, f, n, h in rows], publish.DOCUMENT)
        frame.write.parquet(f"{out}/batch={batch}")

    def trigger(checkpoint="c"):
        publish.publish(spark, out, commits, checkpoint=str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r["commit"], r["path"], r["change"]) for r in publish.read_commits(spark, commits).collect())

    render(0, ("a", "f/a.md", 0, "1"), ("b", "f/b.md", 0, "1"), ("b", "f/b.md", 1, "2"))
    render(1, ("a", "f/a.md", 0, "3"))
    first = [(1, "f/a.md", "new"), (1, "f/b.md", "new"), (1, "f/b.part1.md", "new")]
    assert trigger() == first
    render(2, ("a", "f/a.md", 0, "3"), ("b", "g/b.md", 0, "1"), ("c", "f/c.md", 0, "1"))
    render(3, ("c", "f/c.md", 0, "9"))
    second = [(2, "f/b.md", "deleted"), (2, "f/b.part1.md", "deleted"), (2, "f/c.md", "new"), (2, "g/b.md", "new")]
    assert trigger() == first + second
    assert trigger() == first + second
    now = {r["path"]: r["content_hash"] for r in publish.published(publish.read_commits(spark, commits)).collect()}
    assert now == {"f/a.md": "3", "g/b.md": "1", "f/c.md": "9"}
    assert publish.commit_documents(spark.read.parquet(out).withColumn("version", F.col("batch")), commits, 2) == 0


def test_blocks_by_bucket(spark, tmp_path):
    """Blocks of few pages are read in their buckets only."""
    from leafwork.sources import landed

    path = str(tmp_path / "blocks")
    rows = [json.dumps({"page_id": f"p-{i % 200}", "block_id": f"b{i}", "type": "paragraph"}) for i in range(2000)]
    blocks = spark.createDataFrame(rows, "string").select(F.from_json("value", schemas.BLOCK).alias("b")).select("b.*")
    landed.land_blocks(blocks, path)
    pages = spark.createDataFrame([("p7", "page"), ("p9", "page"), ("p11", "database")], "page_id STRING, type STRING")
    pages.write.parquet(str(tmp_path / "pages"))
    wanted = spark.read.parquet(str(tmp_path / "pages")).where("type = 'page'")
    found = landed.blocks_of(landed.read_bucketed_blocks(spark, path), wanted)
    assert {(r["page_id"], r["block_id"]) for r in found.collect()} == {(f"p-{i % 200}", f"b{i}") for i in range(2000) if i % 200 in (7, 9)}
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert sorted(map(str, landed.blocks_of(blocks, wanted).collect())) == sorted(map(str, found.select(blocks.columns).collect()))


def test_keys_and_columns_of_the_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    queue_log.commit(spark, path, "pull", 0, rows(spark, (1000, 0, "a"), (1000, 1, "b"), (1001, 0, "c")))
    queue_log.commit(spark, path, "sync", 0, rows(spark, (1000, 0, "a2")), rows(spark, (1000, 0, "a"), (1000, 1, "b")))
    assert waiting(spark, path) == [(1000, 0, "a2", 0), (1001, 0, "c", 0)]
    keys = queue_log.read_log(spark, path, columns=queue_log.KEY)
    assert keys.columns == ["seq", "pos"] and sorted(map(tuple, keys.collect())) == [(1000, 0), (1001, 0)]
    some = queue_log.read_log(spark, path, columns=["page_id", "seq"])
    assert some.columns == ["page_id", "seq"] and sorted(map(tuple, some.collect())) == [("a2", 1000), ("c", 1001)]
    # settling reads whole rows once, for those that stay
    read, whole = queue_log.read_log, []

    def noted(*args, **options):
        whole.extend([True] if "columns" not in options else [])
        return read(*args, **options)

    monkeypatch.setattr(queue_log, "read_log", noted)
    outcomes = spark.createDataFrame([(1000, 0, "retry"), (1001, 0, "written")], "seq BIGINT, pos INT, outcome STRING")
    follow_up = rows(spark).drop("seq", "pos").withColumn("position", F.lit(0).cast("bigint"))
    queue_log.settle(spark, path, 1, outcomes, follow_up)
    assert len(whole) == 1
    assert waiting(spark, path) == [(1000, 0, "a2", 1)]
