"""Continuous sync: retry what is left, pull what is new."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions.ids import normalize_id
from leafwork.operators.queueing import collapse_queue
from leafwork.plans.pull import PullOptions, classify_changes, next_state, queue_rows, workspace_nodes
from leafwork.plans.sync import SyncOptions, Workspace, sync
from leafwork.session import drop_staged, staged, staged_so_far
from leafwork.sources import queue_log
from leafwork.sources.index import _filesystem, path_exists, write_children, write_index


def newer_than_processed(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Stream-static filter: rows whose page is unknown or edited after its registered time."""
    known = registry.select(F.col("id").alias("k_id"), F.col("last_edited").alias("k_edited"))
    joined = events.join(known, F.col("page_id") == F.col("k_id"), "left")
    newer = F.col("k_id").isNull() | F.col("last_edited").isNull() | (
        F.col("last_edited") > F.col("k_edited")
    )
    return joined.where(newer).drop("k_id", "k_edited")


def sync_batch(
    workspace: Callable[[], Workspace], options: Callable[[], SyncOptions], output: str
) -> Callable[[DataFrame, int], None]:
    """An `after_batch` hook for `events.ingest` that syncs the pages of each micro-batch.

    `workspace()` gives the tables and the registry of that moment. Documents, registry rows, child
    edges, follow-up work and the rows to retry go to folders of their own per micro-batch, which a
    replay overwrites; the caller queues follow-up work and retries again.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        mark = staged_so_far()
        waiting = rows.withColumn("legacy", F.lit(False))
        result = sync(workspace(), collapse_queue(waiting), options())
        tables = {
            "documents": result.written.documents,
            "registry": result.written.registry,
            "children": result.written.children,
            "child_queue": result.written.child_queue,
            "retry": result.remaining,
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")
        drop_staged(rows.sparkSession, mark)

    return handle


@dataclass(frozen=True)
class Stores:
    """Where a run of the queue keeps its results: all folders of a shared store."""

    log: str  # the queue (`sources.queue_log`)
    output: str  # documents, registry rows and child edges per batch
    index: str  # record index
    children: str  # child edges of all pages


def work_on_queue(
    spark: SparkSession, stores: Stores, workspace: Callable[[], Workspace], options: Callable[[], SyncOptions], batch_id: int
) -> None:
    """Sync all that waits in the queue log, put retries and follow-up work back, update the index.

    Results go to folders of the batch first, then the log gets its commit, then index and child edges
    are brought up to the batch's rows. A batch that failed before its commit starts anew from the same
    registry; one that failed after it only repeats the last step, which replaces the same rows.
    """
    mark = staged_so_far()
    parts = {name: f"{stores.output}/{name}/batch={batch_id}" for name in ("documents", "registry", "children")}
    if queue_log.committed(spark, stores.log, "sync", batch_id) is None:
        waiting = staged(queue_log.read_log(spark, stores.log))
        result = sync(workspace(), waiting.drop("attempts"), options())
        written = result.written
        for name, table in (("documents", written.documents), ("registry", written.registry), ("children", written.children)):
            table.write.mode("overwrite").parquet(parts[name])
        queue_log.settle(spark, stores.log, batch_id, result.outcomes, written.child_queue)
    registry = spark.read.parquet(parts["registry"])
    write_index(registry, registry.select("id").where("false"), stores.index)
    write_children(spark.read.parquet(parts["children"]), registry.select("id"), stores.children)
    drop_staged(spark, mark)


def queue_worker(
    stores: Stores, workspace: Callable[[], Workspace], options: Callable[[], SyncOptions]
) -> Callable[[DataFrame, int], None]:
    """An `after_batch` hook for `events.ingest` with a log: works on the whole queue after each micro-batch."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        work_on_queue(rows.sparkSession, stores, workspace, options, batch_id)

    return handle


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches that have a folder below `path`."""
    if not path_exists(spark, path):
        return []
    system, target = _filesystem(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(target)]
    return [int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")]


def pull_stream(
    spark: SparkSession,
    pages_path: str,
    *,
    registry: Callable[[], DataFrame],
    options: PullOptions,
    queue_path: str,
    state_path: str,
    checkpoint: str,
    now: Callable[[], datetime],
):
    """Pull landed page files as they arrive; queue rows and the state go out per micro-batch.

    The stream's own checkpoint remembers which files were read, so the edit-time bound is not
    needed; the cutoff still applies. Ancestors are looked up among all pages landed so far, whose
    pointers are kept as Parquet in `{queue_path}_pointers`; no page file is read twice. A new page whose
    ancestors have not landed yet is written to `{queue_path}_waiting` and judged again with every later
    micro-batch. Queue numbers go on after those of earlier micro-batches, from the one that
    `{state_path}_numbers` remembers.
    """
    raw = spark.readStream.schema(schemas.PAGE).json(pages_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = staged_so_far()
        waiting = f"{queue_path}_waiting"
        # the waiting pages of the batch before, so a replayed batch finds what it found at first
        earlier = [b for b in _batches(spark, waiting) if b < batch_id]
        pages = batch
        if earlier:
            pages = batch.unionByName(spark.read.schema(schemas.PAGE).parquet(f"{waiting}/batch={max(earlier)}"))
        pages = staged(pages)
        pointers, numbers = f"{queue_path}_pointers", f"{state_path}_numbers"
        workspace_nodes(batch).write.mode("overwrite").parquet(f"{pointers}/batch={batch_id}")
        landed = spark.read.parquet(pointers).where(F.col("batch") <= batch_id)
        latest = landed.groupBy("id").agg(F.max_by("parent_id", "batch").alias("parent_id"))
        decided = staged(classify_changes(pages, latest, registry(), options))
        first = options.first_number
        done = [b for b in _batches(spark, numbers) if b < batch_id]
        if done:
            first = max(first, spark.read.parquet(f"{numbers}/batch={max(done)}").first()["next_number"])
        rows = staged(queue_rows(decided, first=first))
        rows.write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
        following = rows.agg(F.coalesce(F.max("seq") + 1, F.lit(first)).cast("bigint").alias("next_number"))
        following.write.mode("overwrite").parquet(f"{numbers}/batch={batch_id}")
        next_state(decided, None, options, now()).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        lost = decided.where("decision = 'trace_failed'").select(F.col("id").alias("_lost"))
        kept = pages.join(lost, normalize_id(F.col("id")) == F.col("_lost"), "left_semi")
        kept.write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        drop_staged(spark, mark)

    return (
        raw.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
