"""Change detection: which pages were edited since the last pull and belong in the queue."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import normalize_id, packed, parent_id, unpacked
from leafwork.operators.frontier import open_walk, pointers_of, registry_walk
from leafwork.operators.hierarchy import CYCLE, DANGLING, nearest_registered, with_roots
from leafwork.operators.ordering import with_index
from leafwork.operators.queueing import number_files
from leafwork.operators.skew import HOT_FLOOR
from leafwork.session import staged


@dataclass(frozen=True)
class PullOptions:
    """`cutoff`: edits up to it are old. `bound`: oldest edit queued by the previous pull."""

    cutoff: datetime
    bound: datetime | None = None
    folder: str | None = None
    max_pages: int = 0
    include_untracked: bool = False
    first_number: int = 1000


def workspace_nodes(pages: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Parent pointers `(id, parent_id)` of all pages and databases."""
    def pointers(df: DataFrame) -> DataFrame:
        return df.select(
            normalize_id(F.col("id")).alias("id"),
            normalize_id(parent_id(F.col("parent"))).alias("parent_id"),
        )

    nodes = pointers(pages)
    return nodes if databases is None else nodes.unionByName(pointers(databases))


def classify_changes(
    pages: DataFrame, nodes: DataFrame, registry: DataFrame, options: PullOptions,
    *, changed_only: bool = False, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Every page newer than the bound with its `decision`: `queue`, or why it is not queued.

    With `changed_only` pages that were not edited after the cutoff have no row. Only the pages that
    have one, and what lies above them, are looked up if they are few (`frontier`).

    Pages are taken newest first, ids breaking ties. Once `max_pages` are queued, the next edited
    page ends the pull and it and everything after it is `not_reached`.
    """
    recent = pages.select(
        normalize_id(F.col("id")).alias("id"), F.col("last_edited_time").alias("last_edited")
    )
    if options.bound is not None:
        recent = recent.where(F.col("last_edited") > F.lit(options.bound))
    if changed_only:
        recent = recent.where(F.col("last_edited") > F.lit(options.cutoff))
    short = staged(recent.withColumn("id", packed(F.col("id"))))  # ids of half the size also go through the joins
    recent = short.withColumn("id", unpacked(F.col("id")))
    if options.include_untracked:
        near, above, _ = open_walk(pointers_of(nodes), registry, recent, floor=floor)
    else:
        near, above = None, registry_walk(registry, recent, floor=floor)
    traced = staged(with_roots(above, floor=floor).select("id", "folder", "root_enabled"))
    known = traced.select(
        packed(F.col("id")).alias("k_id"), F.col("folder").alias("k_folder"), F.col("root_enabled").alias("k_enabled")
    )
    joined = short.join(known, F.col("id") == F.col("k_id"), "left")
    if near is not None:
        anchors = nearest_registered(near, traced, floor=floor).select(
            packed(F.col("id")).alias("a_id"), F.col("folder").alias("a_folder"), "found_root", "outcome"
        )
        joined = joined.join(anchors, F.col("id") == F.col("a_id"), "left")
    else:
        joined = joined.select(
            "*", F.lit(None).cast("string").alias("a_folder"), F.lit(False).alias("found_root"),
            F.lit(None).cast("string").alias("outcome"),
        )
    tracked = F.col("k_id").isNotNull()
    folder = F.when(tracked, F.col("k_folder")).otherwise(F.col("a_folder"))
    decision = (
        F.when(F.col("last_edited") <= F.lit(options.cutoff), "unchanged")
        .when(~tracked & F.lit(not options.include_untracked), "untracked")
        .when(tracked & ~F.col("k_enabled"), "root_disabled")
        .when(~tracked & F.coalesce(F.col("outcome").isin(DANGLING, CYCLE), F.lit(True)), "trace_failed")
        .when(~tracked & ~F.coalesce("found_root", F.lit(False)), "no_root")
        .when(
            F.lit(options.folder is not None) & ~folder.eqNullSafe(F.lit(options.folder)), "other_folder"
        )
        .otherwise("queue")
    )
    decided = joined.select(
        unpacked(F.col("id")).alias("id"), "last_edited", tracked.alias("tracked"), folder.alias("folder"), decision.alias("decision")
    )
    return _limited(decided, options) if options.max_pages else decided


def _limited(decided: DataFrame, options: PullOptions) -> DataFrame:
    decided = staged(decided)
    order = [F.col("last_edited").desc(), F.col("id")]
    ranked = with_index(decided.where("decision = 'queue'"), order, "rank")
    final = ranked.where(F.col("rank") == options.max_pages - 1).first()
    if final is None:
        return decided
    after = (F.col("last_edited") < F.lit(final["last_edited"])) | (
        (F.col("last_edited") == F.lit(final["last_edited"])) & (F.col("id") > final["id"])
    )
    if decided.where(after & (F.col("decision") != "unchanged")).isEmpty():
        return decided
    return decided.withColumn("decision", F.when(after, "not_reached").otherwise(F.col("decision")))


def queue_rows(decided: DataFrame, *, first: int, floor: int = HOT_FLOOR) -> DataFrame:
    """Numbered queue rows of the changed pages, newest first within a folder."""
    rows = decided.where("decision = 'queue'").select(
        F.lit("update").alias("type"),
        "folder",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("id").alias("page_id"),
        "last_edited",
    )
    return number_files(
        rows, [F.col("last_edited").desc(), F.col("page_id")], first=first, floor=floor
    )


def pull_counters(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """`(metric, value)`: pages found, queued, skipped, new and updated.

    New and updated pages are counted before the folder filter.
    """
    passed = F.col("decision").isin("queue", "other_folder")
    counts = decided.agg(
        F.count_if(F.col("decision") == "queue").alias("queued"),
        F.count_if(~F.col("decision").isin("queue", "not_reached")).alias("skipped"),
        F.count_if(passed & ~F.col("tracked")).alias("new"),
        F.count_if(passed & F.col("tracked")).alias("updated"),
    )
    found = pages.agg(F.count("*").alias("found"))
    return counts.unpivot([], counts.columns, "metric", "value").unionByName(
        found.unpivot([], found.columns, "metric", "value")
    )


def next_state(decided: DataFrame, state: DataFrame | None, options: PullOptions, now: datetime) -> DataFrame:
    """State row after the pull: folders in use, pull time, and the bound for the next pull."""
    queued = F.col("decision") == "queue"
    row = decided.agg(
        F.coalesce(F.min(F.when(queued, F.col("last_edited"))), F.lit(options.cutoff)).alias(
            "oldest_pull_result"
        ),
        F.array_sort(F.collect_set(F.when(queued, F.col("folder")))).alias("seen"),
    )
    known = F.array().cast("array<string>")
    if state is not None:
        first = state.first()
        known = F.array(*[F.lit(f) for f in first["folders"]]).cast("array<string>")
    return row.select(
        F.lit(3).alias("version"),
        F.concat(known, F.array_except("seen", known)).alias("folders"),
        F.lit(now).alias("last_pull_time"),
        "oldest_pull_result",
    )
