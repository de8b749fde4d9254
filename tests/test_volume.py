"""What large tables send, write and recompute: plans that keep it small."""

from datetime import datetime

from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions.ids import packed, unpacked
from leafwork.operators import blocks, hierarchy, skew
from leafwork.streaming import events


def plans_of_staged(monkeypatch, module):
    seen, real = [], module.staged

    def noted(df, *args, **kwargs):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(module, "staged", noted)
    return seen


def test_packed_ids_come_back(values):
    ids = ["0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "", "a", "x" * 15, "0123456789abcdef" * 2 + "\n", "é", None]
    assert values(lambda v: unpacked(packed(v)), ids) == ids
    found = values(packed, ids)
    assert len(set(map(bytes, found[:-1]))) == len(ids) - 1 and len(found[0]) == 16


def test_pointers_take_packed_ids(spark):
    rows = [("a", None, True), ("b", "a", False), ("c", "b", False), ("d", "gone", False), ("e", "f", False), ("f", "e", False), ("g", "e", False), (None, "b", False)]
    df = spark.createDataFrame(rows, "id string, up string, root boolean")
    nodes = df.select(packed(F.col("id")).alias("id"), packed(F.col("up")).alias("next_id"), F.when(F.col("root"), F.lit(1)).alias("payload"))
    found = hierarchy.resolve_pointers(nodes, floor=1).select(unpacked(F.col("id")).alias("id"), "outcome", "hops").collect()
    ended = {r["id"]: (r["outcome"], r["hops"]) for r in found if r["outcome"] != "cycle"}
    assert ended == {"a": ("found", 0), "b": ("found", 1), "c": ("found", 2), "d": ("dangling", 1), None: ("found", 2)}
    assert {r["id"] for r in found if r["outcome"] == "cycle"} == {"e", "f", "g"} and len(found) == len(rows)


def test_pointer_rounds_leave_out_nodes_nobody_points_to(spark, monkeypatch):
    sizes, real = [], hierarchy.lookup

    def noted(left, *args, rows=None, **kwargs):
        sizes.append(left.count())
        return real(left, *args, rows=rows, **kwargs)

    monkeypatch.setattr(hierarchy, "lookup", noted)
    rows = [("r", None, 1)] + [(f"p{i}", "r", None) for i in range(3)] + [(f"q{i}", f"p{i % 3}", None) for i in range(50)]
    found = hierarchy.resolve_pointers(spark.createDataFrame(rows, "id string, next_id string, payload int"))
    assert found.where("outcome = 'found'").count() == 54
    assert sizes.count(50) == 1 and all(n <= 3 for n in sizes if n != 50)


def test_hot_keys_are_counted_by_bucket(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert [r[0] for r in skew.hot_keys(df, "k", floor=500).collect()] == ["hot"]
    assert skew.hot_keys(df, "k", floor=601) is None
    assert skew.hot_keys(df.where("false"), "k", floor=1) is None
    joined = skew.lookup(df.where("k <> 'hot'"), df.select(F.col("k").alias("r")).distinct(), "k", "r", how="inner", floor=500)
    assert "_spread" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 1400


def exploded(spark, pages):
    rows = spark.range(pages).select(
        F.col("id").cast("string").alias("page_id"),
        F.inline(F.array(*(F.struct(F.concat_ws("-", F.col("id"), F.lit(i)).alias("block_id"), F.lit(i).alias("ordinal")) for i in range(6)))),
    )
    given = {
        "page_id": F.col("page_id"), "block_id": F.col("block_id"), "ordinal": F.col("ordinal"), "type": F.lit("quote"),
        "parent_id": F.when(F.col("ordinal") == 0, F.col("page_id")).otherwise(F.concat_ws("-", "page_id", (F.col("ordinal") - 1).cast("string"))),
        "has_children": F.col("ordinal") < 5, "payload_present": F.lit(True),
    }
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schemas.BLOCK).fields
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def test_exploded_blocks_are_not_broadcast(spark, monkeypatch):
    seen = plans_of_staged(monkeypatch, blocks)
    tree = blocks.nested_context(exploded(spark, 20), max_level=1)
    assert tree.count() == 20
    assert not any("Generate" in plan and "BroadcastExchange" in plan for plan in seen)


def test_depth_limit_reads_blocks_once(spark, monkeypatch):
    seen = plans_of_staged(monkeypatch, blocks)
    found = blocks.depth_limited(exploded(spark, 20), 3)
    plans = [*seen, found._jdf.queryExecution().executedPlan().toString()]
    assert sum("Generate" in plan for plan in plans) == 1
    assert {(r["blocks_kept"], r["was_limited"]) for r in found.collect()} == {(4, True)}
    everything = blocks.depth_limited(exploded(spark, 20), 0)
    assert {(r["blocks_kept"], r["was_limited"]) for r in everything.collect()} == {(6, False)}


def test_events_are_verified_once(spark):
    at = datetime(2024, 1, 1)
    rows = [(at, "s", "1704067200", '{"id":"1","type":"page.created","entity":{"id":"a-b"}}')]
    raw = spark.createDataFrame(rows, "received_at timestamp, signature string, timestamp string, body string")
    known = spark.createDataFrame([("ab", "docs")], "id string, folder string")
    queued = events.event_queue_rows(events.classify_events(raw), known)
    assert [(r["page_id"], r["folder"], r["seq"]) for r in queued.collect()] == [("ab", "docs", 999)]


def test_event_passes_read_staged_changes(spark, monkeypatch):
    seen = plans_of_staged(monkeypatch, events)
    raw = spark.createDataFrame([], "received_at timestamp, signature string, timestamp string, body string")
    known = spark.createDataFrame([("ab", "docs")], "id string, folder string")
    events.event_queue_rows(events.classify_events(raw, "secret"), known)
    assert len(seen) == 1
