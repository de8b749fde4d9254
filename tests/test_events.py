"""Event ingest as a stream and as a batch."""

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.plans.pull import PullOptions
from leafwork.session import staged_so_far
from leafwork.streaming import events, incremental

T0 = datetime(2024, 1, 1, 12)
SECRET = "s3cret"


def request(at, kind, entity, *, secret=SECRET, sent=None, body=None, token=None):
    payload = body if body is not None else json.dumps(
        {"id": f"e{at}", "type": kind, "entity": {"id": entity, "type": "page"}, "verification_token": token, "extra": [1]})
    received = T0 + timedelta(seconds=at)
    stamp = str(int((received - datetime(1970, 1, 1)).total_seconds()) if sent is None else sent)
    signature = hmac.new(secret.encode(), (stamp + payload).encode(), hashlib.sha256).hexdigest()
    return received, signature, stamp, payload


def requests():
    rows = [request(0, "page.created", "ab-cd"), request(1, "page.updated", "abcd"), request(2, "database.updated", "db"),
            request(3, "page.deleted", "ab-cd"), request(4, "page.locked", "x"), request(5, "", "", token="t"),
            request(6, "page.created", "x", secret="wrong"), request(7, "page.created", "x", sent=5),
            request(8, "page.created", "y", body="{broken"), request(9, "page.created", ""),
            (T0 + timedelta(seconds=10), None, None, "{}")]
    return rows


def test_classification(spark):
    raw = spark.createDataFrame(requests(), schemas.EVENT)
    got = events.classify_events(raw, SECRET).orderBy("received_at").collect()
    assert [(r["status"], r["route"]) for r in got] == [
        ("accepted", "queue"), ("accepted", "queue"), ("accepted", "queue"), ("accepted", "deletion"), ("accepted", "ignored"),
        ("accepted", "verification"), ("unauthorized", None), ("unauthorized", None), ("malformed", None),
        ("accepted", "ignored"), ("unauthorized", None)]
    assert got[0]["entity_id"] == "abcd"
    unchecked = events.classify_events(raw).where("status = 'unauthorized'")
    assert unchecked.isEmpty()


REGISTRY = "id STRING, folder STRING, last_edited TIMESTAMP"


def test_queue_rows_count_down(spark):
    raw = spark.createDataFrame(requests(), schemas.EVENT)
    registry = spark.createDataFrame([("abcd", "tech", T0), ("db", "", T0)], REGISTRY)
    rows = events.event_queue_rows(events.classify_events(raw, SECRET), registry).orderBy("seq").collect()
    assert [(r["seq"], r["page_id"], r["folder"], r["type"]) for r in rows] == [
        (997, "db", "default", "update"), (998, "abcd", "tech", "update"), (999, "abcd", "tech", "update")]


def land(spark, folder, rows):
    spark.createDataFrame(rows, schemas.EVENT).coalesce(1).write.mode("append").json(str(folder))


def test_stream_equals_batch_and_replays(spark, tmp_path):
    landed = tmp_path / "landed"
    registry = spark.createDataFrame([("abcd", "tech", T0)], REGISTRY)
    seen = []

    def start(checkpoint):
        return events.ingest(
            events.read_events(spark, str(landed)), registry=lambda: registry, secret=SECRET,
            queue_path=str(tmp_path / "queue"), deletions_path=str(tmp_path / "deletions"),
            rejects_path=str(tmp_path / "rejects"), checkpoint=str(tmp_path / checkpoint),
            after_batch=lambda rows, batch: seen.append((batch, rows.count())))

    land(spark, landed, requests())
    start("c1").awaitTermination()
    land(spark, landed, [request(60, "page.updated", "new")])
    start("c1").awaitTermination()
    queue = spark.read.parquet(str(tmp_path / "queue"))
    order = queue.orderBy(events.priority(F.col("batch"), F.col("seq"))).collect()
    assert [(r["batch"], r["page_id"], r["folder"]) for r in order] == [(1, "new", "default"), (0, "db", "default"), (0, "abcd", "tech")]
    assert spark.read.parquet(str(tmp_path / "deletions")).count() == 1
    assert spark.read.parquet(str(tmp_path / "rejects")).groupBy("status").count().orderBy("status").collect() == [
        ("malformed", 1), ("unauthorized", 3)]
    assert seen == [(0, 2), (1, 1)]
    batch = events.coalesced(events.classify_events(spark.createDataFrame(requests(), schemas.EVENT), SECRET))
    assert {(r["entity_id"], r["notifications"]) for r in batch.collect()} == {("abcd", 2), ("db", 1)}
    # a lost checkpoint replays everything into the same folders
    start("c2").awaitTermination()
    assert {r["page_id"] for r in spark.read.parquet(str(tmp_path / "queue")).where("batch = 0").collect()} == {"abcd", "db", "new"}


def sessions(rows, gap):
    by_entity, found = {}, set()
    for at, entity in sorted(rows):
        by_entity.setdefault(entity, []).append(at)
    for entity, times in by_entity.items():
        run = [times[0]]
        for at in times[1:]:
            if at - run[-1] > gap:
                found.add((entity, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        found.add((entity, run[0], run[-1], len(run)))
    return found


def test_bursts_stream_and_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((rng.randrange(0, 50_000) * 1.5, rng.choice("aaab")) for _ in range(400))
    table = spark.createDataFrame([(T0 + timedelta(seconds=s), e, "queue") for s, e in rows],
                                  "received_at TIMESTAMP, entity_id STRING, route STRING")
    want = {(e, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b), n) for e, a, b, n in sessions(rows, 300)}
    got = {tuple(r) for r in events.bursts(table, 300).select("entity_id", "first_at", "last_at", "events").collect()}
    assert got == want
    folder = str(tmp_path / "events")
    table.coalesce(1).write.json(folder)
    tail = [(T0 + timedelta(seconds=900_000), "end", "queue")]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).json(folder)
    query = events.debounced(stream, "300 seconds").writeStream.format("memory").queryName("bursts").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "cp"))
    running = query.start()
    running.processAllAvailable()
    spark.createDataFrame(tail, table.schema).coalesce(1).write.mode("append").json(folder)
    running.processAllAvailable()
    running.stop()
    streamed = {tuple(r) for r in spark.table("bursts").collect()}
    # the watermark closes every burst but those of the last event
    assert streamed == want


def test_periods(spark):
    table = spark.createDataFrame([(T0, "queue", "accepted"), (T0 + timedelta(minutes=59), "queue", "accepted"),
                                   (T0 + timedelta(hours=1), None, "malformed")], "received_at TIMESTAMP, route STRING, status STRING")
    got = {(r["period_start"], r["route"]): r["events"] for r in events.periods(table, "1 hour").collect()}
    assert got == {(T0, "queue"): 2, (T0 + timedelta(hours=1), "malformed"): 1}


def test_newer_than_processed(spark):
    rows = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(1)), ("b", T0), ("c", None)], "page_id STRING, last_edited TIMESTAMP")
    registry = spark.createDataFrame([("a", "f", T0), ("c", "f", T0)], REGISTRY)
    got = incremental.newer_than_processed(rows, registry).collect()
    assert sorted((r["page_id"], r["last_edited"] is None) for r in got) == [("a", False), ("b", False), ("c", True)]


def test_pull_stream(spark, tmp_path):
    landed = tmp_path / "pages"
    landed.mkdir()
    page = {"object": "page", "parent": {"type": "page_id", "page_id": "r"}}
    lines = [{**page, "id": "a-1", "last_edited_time": "2024-01-03T00:00:00Z"}, {**page, "id": "b", "last_edited_time": "2023-01-01T00:00:00Z"}]
    (landed / "one.json").write_text("\n".join(map(json.dumps, lines)))
    registry = spark.createDataFrame(
        [("r", "", True, True, "tech"), ("a1", "r", False, False, "tech"), ("b", "r", False, False, "tech")],
        "id STRING, parent_id STRING, is_root BOOLEAN, enabled BOOLEAN, folder STRING")
    incremental.pull_stream(
        spark, str(landed), registry=lambda: registry, options=PullOptions(cutoff=datetime(2024, 1, 1)),
        queue_path=str(tmp_path / "q"), state_path=str(tmp_path / "s"), checkpoint=str(tmp_path / "c"), now=lambda: T0,
    ).awaitTermination()
    assert [(r["page_id"], r["folder"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [("a1", "tech", 1000)]
    assert spark.read.parquet(str(tmp_path / "s")).first()["oldest_pull_result"] == datetime(2024, 1, 3)


def test_pull_stream_finds_parents_of_other_batches(spark, tmp_path):
    landed = tmp_path / "pages"
    landed.mkdir()
    registry = spark.createDataFrame([("r", "", True, True, "tech")], "id STRING, parent_id STRING, is_root BOOLEAN, enabled BOOLEAN, folder STRING")

    def arrive(name, **parents):
        rows = [{"object": "page", "id": i, "last_edited_time": "2024-01-03T00:00:00Z", "parent": {"type": "page_id", "page_id": p}} for i, p in parents.items()]
        (landed / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        before = staged_so_far()
        incremental.pull_stream(
            spark, str(landed), registry=lambda: registry, options=PullOptions(cutoff=datetime(2024, 1, 1), include_untracked=True),
            queue_path=str(tmp_path / "q"), state_path=str(tmp_path / "s"), checkpoint=str(tmp_path / "c"), now=lambda: T0,
        ).awaitTermination()
        assert staged_so_far() == before
        return sorted((r["page_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "q")).collect())

    assert arrive("one", p="r", early="late") == [("p", 1000)]  # early waits for its parent
    assert arrive("two", child="p") == [("child", 1001), ("p", 1000)]
    assert arrive("three", late="r") == [("child", 1001), ("early", 1002), ("late", 1002), ("p", 1000)]
