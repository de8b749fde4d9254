"""Edit events: from landed requests to queue rows, as a stream or a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions.events import is_authentic, route
from leafwork.functions.ids import blank_to_null, normalize_id
from leafwork.operators.queueing import number_events
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged
from leafwork.sources import queue_log

DEFAULT_FOLDER = "default"  # fixed value


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of landed event requests (JSON files)."""
    return spark.readStream.schema(schemas.EVENT).json(path)


def classify_events(raw: DataFrame, secret: str | None = None) -> DataFrame:
    """Parsed requests with `status` and `route`; works on streams and tables alike.

    Status is `accepted`, `unauthorized` (signature, header or freshness) or `malformed`.
    """
    body = F.from_json("body", schemas.EVENT_BODY, {"mode": "PERMISSIVE"})
    authentic = is_authentic(
        secret, F.col("signature"), F.col("timestamp"), F.col("body"), F.col("received_at")
    )
    readable = F.try_parse_json(F.col("body")).isNotNull() & F.col("event").isNotNull()
    status = (
        F.when(~authentic, "unauthorized").when(~readable, "malformed").otherwise("accepted")
    )
    entity = normalize_id(F.col("event.entity.id"))
    return raw.withColumn("event", body).select(
        "received_at",
        F.col("event.id").alias("event_id"),
        F.col("event.type").alias("event_type"),
        entity.alias("entity_id"),
        F.col("event.entity.type").alias("entity_type"),
        status.alias("status"),
        F.when(
            status == "accepted",
            route(F.col("event.type"), entity, F.col("event.verification_token")),
        ).alias("route"),
    )


def with_folder(events: DataFrame, registry: DataFrame, *, floor: int | None = HOT_FLOOR) -> DataFrame:
    """Folder of the edited page; pages that are not registered use the default folder.

    Pass `floor=None` on a stream, where counting keys beforehand is not possible.
    """
    known = registry.select(F.col("id").alias("g_id"), blank_to_null(F.col("folder")).alias("g_folder"))
    if floor is None:
        joined = events.join(known, F.col("entity_id") == F.col("g_id"), "left")
    else:
        joined = lookup(events, known, "entity_id", "g_id", floor=floor)
    return joined.withColumn("folder", F.coalesce("g_folder", F.lit(DEFAULT_FOLDER))).drop("g_id", "g_folder")


def event_queue_rows(events: DataFrame, registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Queue rows of a batch of classified events, the latest arrival first.

    The changes are staged, so that a request is verified and parsed once and not for every pass.
    """
    changed = staged(events.where("route = 'queue'").select("entity_id", "received_at", "event_id"))
    changes = with_folder(changed, registry, floor=floor).select(
        F.lit("update").alias("type"),
        "folder",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("entity_id").alias("page_id"),
        F.col("received_at").alias("last_edited"),
        "event_id",
    )
    return number_events(changes, [F.col("last_edited"), F.col("event_id")])


def coalesced(events: DataFrame) -> DataFrame:
    """One row per changed entity: notifications that are already pending add nothing."""
    return events.where("route = 'queue'").groupBy("entity_id").agg(
        F.count("*").alias("notifications"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
    )


def debounced(events: DataFrame, delay: str) -> DataFrame:
    """Stream form of the debounce: bursts per entity, closed after `delay` of silence."""
    return (
        events.where("route = 'queue'")
        .withWatermark("received_at", delay)
        .groupBy("entity_id", F.session_window("received_at", delay).alias("burst"))
        .agg(F.count("*").alias("events"), F.min("received_at").alias("first_at"),
             F.max("received_at").alias("last_at"))
        .select("entity_id", "first_at", "last_at", "events")
    )


def bursts(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Batch form of the debounce: `(entity_id, first_at, last_at, events)`.

    Events shrink to one row per entity and time slot of the length of the delay before anything
    is shuffled; within a slot no gap can be that long. The window over an entity then sees at
    most one row per slot of the covered time, however many events the entity has.
    """
    micros = delay_seconds * 1_000_000
    slot = F.floor(F.unix_micros("received_at") / F.lit(micros))
    slots = (
        events.where("route = 'queue'")
        .groupBy("entity_id", slot.alias("slot"))
        .agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
             F.count("*").alias("events"))
    )
    per_entity = Window.partitionBy("entity_id").orderBy("slot")
    gap = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(per_entity))
    started = slots.withColumn("starts", F.coalesce((gap > micros).cast("int"), F.lit(1)))
    numbered = started.withColumn("burst", F.sum("starts").over(per_entity))
    return numbered.groupBy("entity_id", "burst").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum("events").alias("events"),
    ).drop("burst")


def periods(events: DataFrame, length: str) -> DataFrame:
    """Events per route and commit period."""
    return (
        events.groupBy(F.window("received_at", length).alias("period"), F.coalesce("route", "status").alias("route"))
        .agg(F.count("*").alias("events"))
        .select(F.col("period.start").alias("period_start"), "route", "events")
    )


def ingest(
    raw: DataFrame,
    *,
    registry: Callable[[], DataFrame],
    queue_path: str,
    deletions_path: str,
    rejects_path: str,
    checkpoint: str,
    secret: str | None = None,
    trigger: dict | None = None,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    log_path: str | None = None,
    others_path: str | None = None,
):
    """Start the event stream: queue rows, deletions and rejects per micro-batch.

    Each micro-batch overwrites its own `batch=<id>` folder, so a replay after a failure writes the
    same rows again instead of duplicating them. `registry()` is called per micro-batch and sees
    the records of that moment. An entity that changed several times in a micro-batch is queued
    once. `after_batch(queue_rows, batch_id)` may run the sync for the new rows.

    With `log_path` the rows are also committed to that queue log, numbered below all that waits there
    (see `sources.queue_log`). `others_path` gets the accepted events of all other routes, such as the
    verification of the endpoint.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = batch.persist()
        try:
            pending = (
                with_folder(
                    coalesced(events).withColumnRenamed("last_at", "last_edited"), registry()
                )
                .select(
                    F.lit("update").alias("type"), "folder", F.lit(None).cast("string").alias("parent_id"),
                    F.col("entity_id").alias("page_id"), "last_edited", "notifications",
                )
                .transform(lambda df: number_events(df, [F.col("last_edited"), F.col("page_id")]))
            )
            pending.write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
            events.where("route = 'deletion'").write.mode("overwrite").parquet(
                f"{deletions_path}/batch={batch_id}"
            )
            events.where("status <> 'accepted'").write.mode("overwrite").parquet(
                f"{rejects_path}/batch={batch_id}"
            )
            if others_path is not None:
                events.where("status = 'accepted' and route not in ('queue', 'deletion')").write.mode("overwrite").parquet(
                    f"{others_path}/batch={batch_id}"
                )
            if log_path is not None:
                stored = batch.sparkSession.read.parquet(f"{queue_path}/batch={batch_id}")
                queue_log.add_events(batch.sparkSession, log_path, batch_id, stored.drop("seq", "pos"))
            if after_batch is not None:
                after_batch(batch.sparkSession.read.parquet(f"{queue_path}/batch={batch_id}"), batch_id)
        finally:
            events.unpersist()

    writer = (
        classify_events(raw, secret)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    return writer.start()


def priority(batch: Column, seq: Column) -> Column:
    """Sort key of event rows across micro-batches: later batches first, all before regular rows."""
    return F.struct(F.lit(0).alias("class"), (-batch).alias("batch"), seq.alias("seq"))
