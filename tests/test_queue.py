"""Numbering, ordering, budgets and queue files."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafwork.operators import ordering, queueing, roots, skew
from leafwork.sources import documents as files
from leafwork.sources import queue as source

T0 = datetime(2024, 1, 1)
ROWS = "type STRING, folder STRING, parent_id STRING, page_id STRING, last_edited TIMESTAMP"


def test_index_and_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(10)) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "k STRING, i INT, n INT").repartition(7)
    order = [F.col("k").desc(), F.col("i")]
    want = sorted(rows, key=lambda r: (-ord(r[0]), r[1]))
    got = {r["i"]: r["at"] for r in ordering.with_index(df, order, "at").collect()}
    assert got == {r[1]: at for at, r in enumerate(want)}
    sums, total = {}, 0
    for r in want:
        sums[r[1]] = total
        total += r[2]
    assert {r["i"]: r["s"] for r in ordering.with_running_sum(df, order, "n", "s").collect()} == sums


def test_ordered_text_cuts_large_groups(spark):
    rows = [("big", i, f"{i},") for i in range(25)] + [("small", i, f"{i};") for i in range(3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, i INT, t STRING")
    parts = ordering.ordered_text(df, ["k"], ["i"], "t", limit=20_000).orderBy("k", "part_no").collect()
    assert [r["part_no"] for r in parts] == [0, 1, 2, 0]
    assert "".join(r["content"] for r in parts[:3]) == "".join(f"{i}," for i in range(25))
    assert parts[3]["content"] == "0;1;2;"


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_hot_and_null_keys(spark, how):
    rows = [("hot", i) for i in range(2000)] + [(f"k{i % 50}", i) for i in range(1000)] + [(None, i) for i in range(500)]
    left = spark.createDataFrame(rows, "k STRING, n INT")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("zzz", 3)], "r STRING, v INT")
    assert {r[0] for r in skew.hot_keys(left, "k", floor=100).collect()} == {"hot"}
    assert skew.hot_keys(left, "k", floor=10_000) is None
    plain = left.join(right, F.col("k") == F.col("r"), how)
    split = skew.lookup(left, right, "k", "r", how=how, floor=100)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_files_of_ten(spark):
    rows = [("update", "a", None, f"p{i:03d}", T0 + timedelta(hours=i)) for i in range(23)]
    rows += [("init", "a", "x", f"q{i:03d}", T0) for i in range(10)] + [("init", "b", None, "z", T0)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, ROWS)
    for floor in (10**6, 1):
        numbered = queueing.number_files(df, [F.col("last_edited").desc(), F.col("page_id")], floor=floor)
        got = {r["page_id"]: (r["seq"], r["pos"]) for r in numbered.collect()}
        assert [got[f"q{i:03d}"] for i in range(10)] == [(1000, i) for i in range(10)]
        assert got["p022"] == (1001, 0) and got["p012"] == (1002, 0) and got["p000"] == (1003, 2)
        assert got["z"] == (1004, 0)


def test_event_numbers_and_next_number(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "at INT, page_id STRING")
    got = queueing.number_events(df, [F.col("at")]).orderBy("at").collect()
    assert [r["seq"] for r in got] == [999, 998, 997]
    empty = spark.createDataFrame([], "seq BIGINT")
    assert queueing.next_number(empty) == 1000
    assert queueing.next_number(spark.createDataFrame([(999,)], "seq BIGINT")) == 1000
    assert queueing.next_number(spark.createDataFrame([(999,), (1000,), (1002,)], "seq BIGINT")) == 1003


def spend(rows, limit):
    """Rows a run reaches that stops once `limit` costs are spent."""
    spent, reached = 0, []
    for seq, pos, cost in sorted(rows):
        if spent >= limit:
            break
        reached.append((seq, pos))
        spent += cost
    return set(reached)


def test_budget(spark):
    rng = random.Random(3)
    rows = [(seq, pos, rng.randrange(2)) for seq in range(990, 1020) for pos in range(rng.randrange(1, 10))]
    df = spark.createDataFrame(rows, "seq BIGINT, pos INT, cost INT")
    for limit in (1, 7, 40, 10_000):
        found = queueing.within_budget(df, max_pages=limit, page_cost=F.col("cost")).where("in_budget")
        assert {(r["seq"], r["pos"]) for r in found.collect()} == spend(rows, limit)
    first = queueing.within_budget(df, max_queue_files=3).where("in_budget").select("seq").distinct()
    assert {r[0] for r in first.collect()} == {990, 991, 992}


def test_skips(spark):
    queue = spark.createDataFrame(
        [(1, 0, "update", "new", T0, False), (1, 1, "update", "old", T0, False), (1, 2, "update", "old", T0 + timedelta(1), False),
         (2, 0, "init", "old", None, True), (2, 1, "init", "new", None, True), (3, 0, "update", "old", None, True)],
        "seq BIGINT, pos INT, type STRING, page_id STRING, last_edited TIMESTAMP, legacy BOOLEAN")
    registry = spark.createDataFrame([("old", T0)], "id STRING, last_edited TIMESTAMP")
    got = queueing.with_skips(queue, registry).orderBy("seq", "pos").collect()
    assert [r["skip"] for r in got] == [False, True, False, True, False, False]


def test_queue_files_and_table(spark, tmp_path):
    folder = tmp_path / "queue"
    folder.mkdir()
    (folder / "00000999.json").write_text(json.dumps({"type": "update", "folder": "a", "pages": [
        {"id": "ab-cd", "last_edited": "2024-01-01T00:00:00Z"}], "createdAt": "2024-01-01T00:00:00Z"}, indent=2))
    (folder / "00001000.json").write_text(json.dumps({"type": "init", "folder": "b", "pageIds": ["x", "y"], "parentId": "p-1"}))
    (folder / "notes.json").write_text("{}")
    rows = queueing.explode_queue(source.read_queue_files(spark, str(folder))).orderBy("seq", "pos").collect()
    assert [(r["seq"], r["pos"], r["page_id"], r["legacy"], r["parent_id"]) for r in rows] == [
        (999, 0, "abcd", False, None), (1000, 0, "x", True, "p1"), (1000, 1, "y", True, "p1")]

    table = str(tmp_path / "table")
    more = spark.createDataFrame([("update", "a", None, f"p{i:02d}", T0) for i in range(25)], ROWS).withColumn("legacy", F.lit(False))
    source.append_queue(queueing.number_files(more, [F.col("page_id")]), table)
    assert queueing.next_number(source.read_queue(spark, table)) == 1003
    queue = queueing.explode_queue(source.read_queue(spark, table))
    done = queue.where("seq = 1000 or page_id = 'p24'")
    left = queueing.remaining(queue, done)
    source.acknowledge(spark, table, left, done.select("seq"))
    after = source.read_queue(spark, table).orderBy("seq").collect()
    assert [(r["seq"], len(r["pages"])) for r in after] == [(1001, 10), (1002, 4)]
    queue = queueing.explode_queue(source.read_queue(spark, table))
    source.acknowledge(spark, table, queue.where("false"), queue.select("seq"))
    assert source.read_queue(spark, table).isEmpty()


def test_summary_counts_both_encodings(spark):
    raw = spark.createDataFrame(
        [(1, "init", "a", None, ["x", "y"], None), (2, "update", "a", [("z", T0)], None, None), (3, "other", "b", None, ["q"], None)],
        "seq BIGINT, type STRING, folder STRING, pages ARRAY<STRUCT<id: STRING, last_edited: TIMESTAMP>>, pageIds ARRAY<STRING>, parentId STRING")
    got = {(r["folder"], r["type"]): (r["files"], r["pages"], r["pages_legacy_only"]) for r in queueing.queue_summary(raw).collect()}
    assert got == {("a", "init"): (1, 2, 2), ("a", "update"): (1, 1, 0), ("b", "update"): (1, 1, 1)}


def test_errors(spark):
    rows = [("a", 401, None, False), ("b", 403, None, False), ("c", 404, None, False), ("d", 400, "validation_error", False),
            ("e", 400, "other", False), ("f", 429, None, False), ("g", None, None, True), ("h", 500, "validation_error", None)]
    errors = spark.createDataFrame(rows, "page_id STRING, status INT, code STRING, no_data_sources BOOLEAN")
    got = {r["page_id"]: r["action"] for r in queueing.split_errors(errors).collect()}
    assert got == dict(zip("abcdefgh", ["drop"] * 4 + ["retry"] * 2 + ["drop", "retry"], strict=True))


MANIFEST = """# Root Pages

- [x] **tech**: https://pages.example/Handbook-2a10b3c4d5e647089929a3b4c5d6e7f8
- [ ] **sales**:    https://pages.example/3a10b3c4d5e647089929a3b4c5d6e7f8
- [X] **docs**: 4a10b3c4-d5e6-4708-9929-a3b4c5d6e7f8
- [x] **again**: https://pages.example/Other-2a10b3c4d5e647089929a3b4c5d6e7f8
- [x] **docs**: nothing-to-open
* [x] **no**: 5a10b3c4d5e647089929a3b4c5d6e7f8
some text
"""


def test_manifest_round_trip(spark, tmp_path):
    path = tmp_path / "root.md"
    path.write_text(MANIFEST)
    entries = roots.first_per_page(files.read_root_manifest(spark, str(path))).orderBy("line_no")
    assert [(r["folder"], r["enabled"], r["page_id"][0]) for r in entries.collect()] == [
        ("tech", True, "2"), ("sales", False, "3"), ("docs", True, "4")]
    assert files.write_root_manifest(entries, str(path))
    written = path.read_text()
    assert written == "# Root Pages\n\n" + "".join(
        f"- [{'x' if r['enabled'] else ' '}] **{r['folder']}**: {r['url']}\n" for r in entries.collect())
    again = roots.first_per_page(files.read_root_manifest(spark, str(path)))
    assert not files.write_root_manifest(again, str(path)) and path.read_text() == written
    assert files.write_root_manifest(again.where("folder <> 'sales'"), str(path)) and "sales" not in path.read_text()
    assert files.write_root_manifest(again, str(tmp_path / "new.md")) and (tmp_path / "new.md").read_text() == path.read_text()
    assert files.read_root_manifest(spark, str(tmp_path / "none.md")).isEmpty()


def test_reconcile(spark, tmp_path):
    registry = spark.createDataFrame(
        [("2a10b3c4d5e647089929a3b4c5d6e7f8", "old", "x.md", False, False, T0), ("3a10b3c4d5e647089929a3b4c5d6e7f8", "p", None, True, True, None),
         ("other", "z", "z.md", True, True, T0)],
        "id STRING, folder STRING, file_path STRING, is_root BOOLEAN, enabled BOOLEAN, last_synced TIMESTAMP")
    path = tmp_path / "root.md"
    path.write_text(MANIFEST)
    after = roots.reconcile_roots(files.read_root_manifest(spark, str(path)), registry)
    got = {r["id"][0]: (r["folder"], r["file_path"], r["is_root"], r["enabled"], r["needs_sync"]) for r in after.collect()}
    assert got == {"2": ("tech", "x.md", True, True, False), "3": ("sales", None, True, False, True),
                   "4": ("docs", None, True, True, True), "o": ("z", "z.md", True, True, False)}
    queued = roots.roots_to_queue(after, F.lit(T0)).collect()
    assert [(r["folder"], r["type"]) for r in queued] == [("docs", "init")]


def test_sidecars_round_trip(spark, tmp_path):
    root = str(tmp_path / "files")
    rows = [("a/files/x.png.meta.json", "f1", "p1", T0), ("a/files/y z.png.meta.json", "f2", None, T0 + timedelta(microseconds=5))]
    schema = "path STRING, file_id STRING, parent_page_id STRING, downloaded_at TIMESTAMP"
    assert files.write_sidecars(spark.createDataFrame(rows + rows[:1], schema), root) == 2
    read = lambda: sorted(map(tuple, files.read_sidecars(spark, root).collect()))
    assert read() == rows
    # only what differs is written again
    before = (tmp_path / "files" / rows[0][0]).stat().st_mtime_ns
    changed = [rows[0], (rows[1][0], "f2", "p9", T0), ("b.meta.json", "f3", "p1", T0)]
    assert files.write_sidecars(spark.createDataFrame(changed, schema), root) == 2
    assert read() == changed and (tmp_path / "files" / rows[0][0]).stat().st_mtime_ns == before
    assert files.write_sidecars(spark.createDataFrame([], schema), root) == 0


@pytest.mark.parametrize("threshold, floor", [("10m", 10**6), ("-1", 10**6), ("-1", 50)])
def test_lookup_of_several_columns(spark, threshold, floor):
    """Two keys of a row are looked up in one go, whether the table is broadcast or a key is hot."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "k1", "k2", "lost", None]), rng.choice(["hot", "k3", None])) for i in range(400)]
    table = {k: f"value of {k}" for k in ("hot", "k1", "k2", "k3")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = skew.lookup_slots(
            spark.createDataFrame(rows, "i INT, a STRING, b STRING"), spark.createDataFrame(list(table.items()), "k STRING, v STRING"),
            {"va": F.col("a"), "vb": F.col("b")}, "k", "v", row_id="i", floor=floor)
        got = sorted((r["i"], r["a"], r["b"], r["va"], r["vb"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(i, a, b, table.get(a), table.get(b)) for i, a, b in rows]
