"""Smaller jobs on the registry: fetch, scan, add roots, clean up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id
from leafwork.operators.blocks import child_edges, normalized
from leafwork.operators.hierarchy import (
    CYCLE, FOUND, ancestor_chains, nearest_registered, trace_roots, with_roots,
)
from leafwork.operators.frontier import Fetch, ancestor_ids, open_walk, pointers_of
from leafwork.operators.roots import valid_folder
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.plans.sync import SyncOptions, Workspace, Written, item_pointers, workspace_items, write_items
from leafwork.session import staged


def _anchored(
    fetch: Fetch, registry: DataFrame, requested: DataFrame, default_folder: str, floor: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested pages and their unregistered ancestors, the registered pages above them, and what the anchor tells of each node."""
    nodes, above, _ = open_walk(fetch, registry, requested, floor=floor)
    traced = staged(with_roots(above, floor=floor).select("id", "folder", "root_enabled"))
    anchors = nearest_registered(nodes, traced, default_folder=default_folder, floor=floor)
    return nodes, traced, staged(anchors.drop("anchor_id", "found_root"))


def write_set(
    fetch: Fetch, registry: DataFrame, requested: DataFrame, *, default_folder: str = "default", floor: int = HOT_FLOOR
) -> DataFrame:
    """Everything to write for the requested pages: `(id, folder, write_order)`, one row per page.

    Each requested page and each of its unregistered ancestors occurs once, however many pages need
    it. `write_order` counts from the anchor downwards and so is the same for all of them.
    """
    nodes, traced, anchors = _anchored(fetch, registry, requested, default_folder, floor)
    ends = anchors.where((F.col("outcome") == FOUND) & valid_folder(F.col("folder")))
    wanted = requested.select("id").join(ends.select("id"), "id", "left_semi")
    ids = ancestor_ids(wanted, pointers_of(nodes), traced.select("id"), floor=floor)
    return ends.join(ids, "id", "left_semi").select("id", "folder", F.col("missing_ancestors").alias("write_order"))


def get_plan(
    items: DataFrame, registry: DataFrame, requested: DataFrame, *, default_folder: str = "default",
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """What to write for each requested page: `(page_id, write_order, id, folder)`.

    The page itself and its unregistered ancestors, root first. Pages whose ancestors cannot be
    read, and folders with invalid names, give no rows.
    """
    nodes, _, anchors = _anchored(pointers_of(items), registry, requested, default_folder, floor)
    chains = ancestor_chains(requested, nodes, anchors, floor=floor)
    steps = chains.select("page_id", "depth", F.col("ancestor_id").alias("id")).unionByName(
        requested.select(F.col("id").alias("page_id"), F.lit(0).alias("depth"), "id")
    )
    ends = anchors.where(F.col("outcome") == FOUND).select(
        F.col("id").alias("a_id"), "folder", "missing_ancestors"
    )
    return (
        steps.join(ends, F.col("page_id") == F.col("a_id"))
        .where(valid_folder(F.col("folder")))
        .select("page_id", (F.col("missing_ancestors") - F.col("depth")).alias("write_order"), "id", "folder")
    )


def get_pages(ws: Workspace, requested: DataFrame, options: SyncOptions) -> Written:
    """Write the requested pages and their unregistered ancestors; nothing becomes a root by it."""
    floor = options.floor
    plan = staged(write_set(
        item_pointers(ws, floor=floor), ws.registry, requested, default_folder=options.folder or "default", floor=floor
    ))
    due = plan.select(
        "id", "folder", F.lit(False).alias("enabled"), F.lit(False).alias("as_root"),
        F.col("write_order").cast("bigint").alias("priority"),
    )
    return write_items(ws, staged(workspace_items(ws, plan.select("id"), floor=floor)), due, options)


def new_children(
    blocks: DataFrame, registry: DataFrame, requested: DataFrame, *, floor: int = HOT_FLOOR
) -> DataFrame:
    """Queue rows for unregistered children of registered pages, in document order."""
    pages = registry.join(requested.select("id"), "id", "left_semi").select("id", "folder")
    mine = normalized(blocks).join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    edges = child_edges(mine, floor=floor)
    unknown = edges.join(registry.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    origin = pages.select(F.col("id").alias("o_id"), "folder")
    return lookup(unknown, origin, "parent_id", "o_id", how="inner", floor=floor).select(
        F.lit("init").alias("type"), "folder", "parent_id", F.col("child_id").alias("page_id"),
        F.lit(None).cast("timestamp").alias("last_edited"), "position",
    )


def add_roots(ws: Workspace, requested: DataFrame, options: SyncOptions) -> Written:
    """Make pages or databases roots of a folder: `requested(id, folder, force_update)`.

    Children are queued as `init`, or as `update` where an update is forced. A database without
    entries is not added, nor is a folder with an invalid name accepted.
    """
    items = staged(workspace_items(ws, requested.select("id"), floor=options.floor))
    filled = ws.entries.select(normalize_id(F.col("parent.database_id")).alias("id")).where(
        blank_to_null(F.col("id")).isNotNull()
    ).distinct()
    usable = items.where("type = 'page'").select("id").unionByName(
        items.where("type = 'database'").select("id").join(filled, "id", "left_semi")
    )
    due = (
        requested.where(valid_folder(F.col("folder")))
        .join(usable, "id", "left_semi")
        .select("id", "folder", F.lit(True).alias("enabled"), F.lit(True).alias("as_root"),
                F.lit(0).cast("bigint").alias("priority"), "force_update")
    )
    kind = F.when(F.col("force_update"), "update").otherwise("init")
    return write_items(ws, items, due, options, queue_type=kind)


def orphaned_pages(registry: DataFrame, roots: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Registered pages to delete: `(id, file_path, root_id)`.

    A page stays when its walk ends at a root listed in `roots(page_id)`, or runs in a cycle; all
    others are orphans, also under a root that is no longer listed.
    """
    traced = staged(trace_roots(registry, floor=floor).where(F.col("outcome") != CYCLE).select("id", "root_id"))
    listed = roots.select(F.col("page_id").alias("m_id")).distinct()
    doomed = (
        lookup(traced, listed, "root_id", "m_id", floor=floor).where("m_id is null").select("id", "root_id")
    )
    return registry.select("id", "file_path").join(doomed, "id")


def cleanup_counters(orphans: DataFrame, *, dry_run: bool = False) -> DataFrame:
    """`(metric, value)`: orphans found, registry rows and files deleted."""
    has_file = blank_to_null(F.col("file_path")).isNotNull()
    none = F.lit(0).cast("bigint")
    counts = orphans.agg(
        F.count("*").alias("orphaned_pages"),
        (none if dry_run else F.count("*")).alias("deleted_registries"),
        (none if dry_run else F.count_if(has_file)).alias("deleted_files"),
    )
    return counts.unpivot([], counts.columns, "metric", "value")
