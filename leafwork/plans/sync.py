"""Queue to documents: resolve, place, render and register the pages that are due."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id, parent_id
from leafwork.functions.properties import page_title
from leafwork.functions.richtext import plain_text
from leafwork.operators import attachments as files_op
from leafwork.operators.blocks import child_edges, depth_limited, normalized, positions
from leafwork.operators.frontier import Fetch, ancestor_ids, open_walk, pointers_of
from leafwork.operators.hierarchy import FOUND, nearest_registered, with_roots
from leafwork.operators.ordering import PART_BYTES, text_hashes
from leafwork.operators.paths import assign_paths
from leafwork.operators.queueing import explode_queue, split_errors, with_skips, within_budget
from leafwork.operators.render import direct_entries, keyed_entries, render_databases, render_pages
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.operators.users import enrich_users
from leafwork.session import staged
from leafwork.sources.landed import blocks_of


@dataclass(frozen=True)
class Workspace:
    """The landed tables (schemas in `leafwork.schemas`) and the current registry.

    `files`, `file_manifests`, `file_sizes` and `errors` may be left out.
    """

    pages: DataFrame
    databases: DataFrame
    entries: DataFrame
    blocks: DataFrame
    users: DataFrame
    registry: DataFrame
    files: DataFrame | None = None
    file_manifests: DataFrame | None = None
    file_sizes: DataFrame | None = None
    errors: DataFrame | None = None


@dataclass(frozen=True)
class SyncOptions:
    now: datetime
    folder: str | None = None
    max_pages: int = 0
    max_files: int = 0
    max_queue_files: int = 0
    max_level: int = 0
    header: bool = True
    version_key: str = "tool_version"
    part_bytes: int = PART_BYTES
    floor: int = HOT_FLOOR


@dataclass(frozen=True)
class Written:
    """Results of writing a set of items."""

    documents: DataFrame  # page_id, file_path, part_no, content, content_hash
    registry: DataFrame  # new and replaced registry rows
    children: DataFrame  # parent_id, position, child_id
    child_queue: DataFrame  # type, folder, parent_id, page_id, last_edited
    files: DataFrame | None = None
    file_manifests: DataFrame | None = None


@dataclass(frozen=True)
class SyncResult:
    written: Written
    outcomes: DataFrame  # one row per queue row with its outcome
    remaining: DataFrame  # queue rows to keep


def workspace_items(ws: Workspace, ids: DataFrame | None = None, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Pages and databases as `(id, type, title, last_edited, parent_id)`, all or those in `ids(id)`.

    A page inside a block gets the page that contains the block as its parent; when that block is
    unknown the page counts as a root, like a page without any parent.
    """
    def item(df: DataFrame, kind: str, title: Column) -> DataFrame:
        named = df.withColumn("id", normalize_id(F.col("id")))
        return (named if ids is None else named.join(ids, "id", "left_semi")).select(
            "id",
            F.lit(kind).alias("type"),
            title.alias("title"),
            F.col("last_edited_time").alias("last_edited"),
            F.when(F.col("parent.type") == "block_id", normalize_id(F.col("parent.block_id"))).alias("block"),
            normalize_id(parent_id(F.col("parent"))).alias("parent"),
        )

    items = item(ws.pages, "page", page_title(F.col("properties"))).unionByName(
        item(ws.databases, "database", plain_text(F.col("title")))
    )
    containers = ws.blocks.select(
        normalize_id(F.col("block_id")).alias("c_block"), normalize_id(F.col("page_id")).alias("c_page")
    )
    # only the pages that sit in blocks take part in the join, and of the blocks those they sit in
    direct = items.where("block is null").select(*items.columns, F.col("parent").alias("parent_id"))
    inside = staged(items.where("block is not null"))
    if inside.isEmpty():
        return direct.drop("block", "parent")
    containers = containers.join(inside.select(F.col("block").alias("c_block")).distinct(), "c_block", "left_semi")
    inside = lookup(inside, containers, "block", "c_block", floor=floor)
    inside = inside.select(*items.columns, F.col("c_page").alias("parent_id"))
    return direct.unionByName(inside).drop("block", "parent")


def item_pointers(ws: Workspace, *, floor: int = HOT_FLOOR) -> Fetch:
    """Pointers of pages and databases to their parents, for `frontier`."""

    def fetch(ids: DataFrame | None) -> DataFrame:
        items = workspace_items(ws, ids, floor=floor)
        return items.select("id", blank_to_null(F.col("parent_id")).alias("next_id"))

    return fetch


def place_items(ws: Workspace, items: DataFrame, due: DataFrame, options: SyncOptions) -> DataFrame:
    """Parents, flags and paths of `due(id, folder, enabled, as_root, priority, …)`.

    `as_root` makes the item a root without a parent whatever the workspace says. Flags that a
    registered root got from the manifest win over what the page says.
    """
    floor = options.floor
    existing = ws.registry.select(
        F.col("id").alias("x_id"), F.col("is_root").alias("x_root"), F.col("enabled").alias("x_enabled")
    )
    parent = F.when(~F.col("as_root"), blank_to_null(F.col("parent_id")))
    plan = staged(
        items.join(due, "id")
        .withColumn("parent_id", parent)
        .withColumn("placed_as_root", F.col("parent_id").isNull())
        .join(existing, F.col("id") == F.col("x_id"), "left")
        .withColumn("keeps_flags", F.coalesce("x_root", F.lit(False)) & ~F.col("as_root"))
        .withColumn("is_root", F.col("placed_as_root") | F.col("keeps_flags"))
        .withColumn("enabled", F.when(F.col("keeps_flags"), F.col("x_enabled")).otherwise(F.col("enabled")))
        .drop("x_id", "x_root", "x_enabled", "keeps_flags")
    )
    wanted = plan.select(
        "id", "parent_id", "title", "folder", F.col("placed_as_root").alias("is_root"), "priority"
    )
    return plan.join(assign_paths(wanted, ws.registry, floor=floor), "id")


def _due(placed: DataFrame, kind: str, options: SyncOptions) -> DataFrame:
    return placed.where(F.col("type") == kind).select(
        F.col("id").alias("w_id"), "folder", "file_path", F.lit(options.now).alias("last_synced"),
        F.col("placed_as_root").alias("is_root"), F.col("parent_id").alias("resolved_parent_id"),
    )


def _due_blocks(ws: Workspace, placed: DataFrame) -> DataFrame:
    """Blocks of the pages that are due; no other content is read."""
    pages = placed.where("type = 'page'").select(F.col("id").alias("page_id"))
    return normalized(blocks_of(ws.blocks, pages))


def due_entries(ws: Workspace, placed: DataFrame, options: SyncOptions) -> DataFrame:
    """`keyed_entries` of the databases that are due, staged: lists and child edges read them several times."""
    wanted = placed.where("type = 'database'").select(F.col("id").alias("w_id")).distinct()
    return staged(lookup(keyed_entries(ws.entries), wanted, "database_id", "w_id", how="inner", floor=options.floor).drop("w_id"))


def discovered_children(ws: Workspace, placed: DataFrame, options: SyncOptions, entries: DataFrame | None = None) -> DataFrame:
    """Child edges of the due items: mentions in pages and entries of databases.

    `entries` are those of `due_entries`, where they are at hand.
    """
    floor = options.floor
    databases = ws.databases.join(
        _due(placed, "database", options).select("w_id"), normalize_id(F.col("id")) == F.col("w_id"), "left_semi"
    )
    entries = due_entries(ws, placed, options) if entries is None else entries
    entries = direct_entries(databases, entries, floor=floor).select(
        F.col("database_id").alias("parent_id"), F.col("position").cast("bigint").alias("position"),
        F.col("entry_id").alias("child_id"),
    )
    mentions = child_edges(_due_blocks(ws, placed), max_level=options.max_level, floor=floor)
    return mentions.unionByName(positions(entries, "position", floor=floor))


def follow_up(
    ws: Workspace, placed: DataFrame, children: DataFrame, options: SyncOptions, *,
    queue_type: Column | None = None,
) -> DataFrame:
    """Queue rows for children that are neither registered nor written now."""
    known = ws.registry.select("id").unionByName(placed.select("id"))
    fresh = children.join(known.select(F.col("id").alias("child_id")), "child_id", "left_anti")
    kind = F.lit("init") if queue_type is None else queue_type
    origin = placed.select(F.col("id").alias("o_id"), "folder", kind.alias("kind"))
    return lookup(fresh, origin, "parent_id", "o_id", how="inner", floor=options.floor).select(
        F.col("kind").alias("type"), "folder", "parent_id", F.col("child_id").alias("page_id"),
        F.lit(None).cast("timestamp").alias("last_edited"), "position",
    )


def document_hashes(documents: DataFrame) -> DataFrame:
    """`(page_id, content_hash)` over all parts in order, the same however the text was cut."""
    return text_hashes(documents, "page_id")


def write_items(
    ws: Workspace, items: DataFrame, due: DataFrame, options: SyncOptions, *,
    queue_type: Column | None = None,
) -> Written:
    """Place, render and register the due items (see `place_items`)."""
    floor = options.floor
    placed = staged(place_items(ws, items, due, options))
    due_pages = _due(placed, "page", options)
    blocks, new_files, new_manifests = _with_local_files(ws, _due_blocks(ws, placed), due_pages, options)
    pages = ws.pages.join(due_pages, normalize_id(F.col("id")) == F.col("w_id"))
    if options.max_level:
        cut = depth_limited(blocks, options.max_level, floor=floor).where("was_limited")
        cut = cut.select(F.col("page_id").alias("c_id"), F.lit(options.max_level).alias("simplified_depth"))
        pages = pages.join(cut, F.col("w_id") == F.col("c_id"), "left").drop("c_id")
    databases = ws.databases.join(
        _due(placed, "database", options), normalize_id(F.col("id")) == F.col("w_id")
    )
    page_documents = render_pages(
        enrich_users(pages, ws.users, floor=floor), blocks, header=options.header,
        version_key=options.version_key, max_level=options.max_level, limit=options.part_bytes, floor=floor,
    )
    entries = due_entries(ws, placed, options)
    database_documents = render_databases(
        enrich_users(databases, ws.users, floor=floor), entries, header=options.header,
        version_key=options.version_key, limit=options.part_bytes, floor=floor,
    )
    documents = staged(page_documents.unionByName(database_documents))
    hashes = document_hashes(documents).withColumnRenamed("page_id", "h_id")
    registry = placed.join(hashes, F.col("id") == F.col("h_id")).select(
        "id", "type", "folder", "file_path", "title", "last_edited",
        F.lit(options.now).alias("last_synced"), "is_root", "enabled",
        F.coalesce("parent_id", F.lit("")).alias("parent_id"), "content_hash",
    )
    children = staged(discovered_children(ws, placed, options, entries))
    child_queue = follow_up(ws, placed, children, options, queue_type=queue_type)
    return Written(documents, registry, children, child_queue, new_files, new_manifests)


def _with_local_files(
    ws: Workspace, blocks: DataFrame, due_pages: DataFrame, options: SyncOptions
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Media blocks with the local path of their file in place of the hosted URL."""
    if ws.files is None or ws.file_manifests is None or ws.file_sizes is None:
        return blocks, None, None
    is_media = F.coalesce(F.col("type").isin("image", "video", "file", "pdf"), F.lit(False))
    media = blocks.where(is_media)
    paths = due_pages.select(F.col("w_id").alias("p_id"), F.col("file_path").alias("page_path"))
    links = files_op.attachment_links(
        lookup(media, paths, "page_id", "p_id", how="inner", floor=options.floor).select(
            "page_id", "page_path", F.col("block_id").alias("position"),
            F.coalesce("external_url", "file_url", F.lit("")).alias("url"),
        )
    )
    placed = staged(
        files_op.with_sizes(
            files_op.place_files(links, ws.files, ws.file_manifests, floor=options.floor), ws.file_sizes
        )
    )
    shown = files_op.resolve_links(links, placed, floor=options.floor).select(
        F.col("position").alias("s_block"), "shown"
    )
    local = media.join(shown, F.col("block_id") == F.col("s_block"), "left")
    local = local.withColumn("external_url", F.coalesce("shown", "external_url")).drop("s_block", "shown")
    registry, manifests = files_op.file_records(placed, F.lit(options.now))
    return blocks.where(~is_media).unionByName(local), registry, manifests


@dataclass(frozen=True)
class Judged:
    """The queue with its outcomes and what has to be written."""

    outcomes: DataFrame
    remaining: DataFrame
    items: DataFrame
    due: DataFrame


def judge_queue(ws: Workspace, queue_raw: DataFrame, options: SyncOptions) -> Judged:
    """Decide the outcome of every queue row and collect the items to write.

    The queue comes as files, or as rows of `explode_queue` whose places are kept.

    Outcomes: `skipped` (unchanged or known), `waiting` (budget), `dropped` and `retry` (errors),
    `root_disabled` and `no_root` (processed without writing) and `written`. Unregistered
    ancestors of a written page are written too, so children find their directory. Of a large workspace only the queued pages and what
    lies above them is looked at (`frontier`).
    """
    floor = options.floor
    queue = queue_raw if "page_id" in queue_raw.columns else explode_queue(queue_raw)
    in_folder = F.lit(True) if options.folder is None else F.col("folder").eqNullSafe(F.lit(options.folder))
    active = staged(with_skips(queue.where(in_folder), ws.registry, floor=floor))
    asked_for = active.where(~F.coalesce("skip", F.lit(False))).select(F.col("page_id").alias("id"))
    nodes, above_them, narrow = open_walk(item_pointers(ws, floor=floor), ws.registry, asked_for, floor=floor)
    items = staged(workspace_items(ws, nodes.select("id") if narrow else None, floor=floor))
    traced = staged(with_roots(above_them, floor=floor).select("id", "folder", "root_id", "root_enabled"))
    anchors = staged(nearest_registered(nodes, traced, floor=floor))
    # all that is known about a page goes into one row first, so the queue is joined once; every page
    # that was landed has an anchor row, which also tells which were
    facts = traced.select("id", "root_enabled", "root_id").join(
        anchors.select("id", F.col("id").alias("a_id"), F.col("folder").alias("a_folder"), "found_root"), "id", "full_outer"
    )
    errors = None if ws.errors is None else split_errors(ws.errors).select(F.col("page_id").alias("id"), "action")
    facts = facts.withColumn("action", F.lit(None).cast("string")) if errors is None else facts.join(errors, "id", "full_outer")
    judged = lookup(active, facts.withColumnRenamed("id", "f_id"), "page_id", "f_id", floor=floor)
    outcome = (
        F.when(F.col("skip"), "skipped")
        .when(F.col("root_id").isNotNull() & ~F.col("root_enabled"), "root_disabled")
        .when(F.col("action") == "drop", "dropped")
        .when((F.col("action") == "retry") | F.col("a_id").isNull(), "retry")
        .when(~F.col("registered") & ~F.coalesce("found_root", F.lit(False)), "no_root")
        .otherwise("written")
    )
    judged = staged(
        judged.select(
            *queue.columns, "registered", outcome.alias("outcome"),
            F.when(F.col("registered"), F.col("folder")).otherwise(F.col("a_folder")).alias("target_folder"),
            F.coalesce("root_enabled", F.lit(False)).alias("enabled"),
        )
    )
    outcomes = judged
    if options.max_pages or options.max_files or options.max_queue_files:
        budgeted = within_budget(
            judged,
            max_pages=options.max_pages,
            max_files=options.max_files,
            max_queue_files=options.max_queue_files,
            page_cost=F.col("outcome").isin("written", "root_disabled", "no_root").cast("int"),
            file_cost=(F.col("outcome") == "written").cast("int"),
        )
        reached = F.when(F.col("in_budget"), F.col("outcome")).otherwise("waiting")
        outcomes = staged(budgeted.withColumn("outcome", reached).drop("in_budget"))
    # a page queued several times is written once, as its first row asks
    asked = staged(
        outcomes.where("outcome = 'written'")
        .groupBy(F.col("page_id").alias("id"))
        .agg(
            F.min_by(
                F.struct(F.col("target_folder").alias("folder"), "enabled", "registered"),
                F.struct("seq", "pos"),
            ).alias("row"),
            F.min("seq").alias("priority"),
        )
        .select("id", "row.folder", "row.enabled", "row.registered", "priority")
    )
    ends = anchors.where(F.col("outcome") == FOUND)
    fresh = asked.where("not registered").join(ends.select("id"), "id", "left_semi")
    ancestors = (
        ancestor_ids(fresh, pointers_of(nodes), traced.select("id"), floor=floor)
        .join(asked.select("id"), "id", "left_anti")
        .join(ends.select("id", "folder"), "id")
        .select("id", "folder", F.lit(False).alias("enabled"), F.lit(0).cast("bigint").alias("priority"))
    )
    due = asked.select("id", "folder", "enabled", "priority").unionByName(ancestors)
    kept = outcomes.where(F.col("outcome").isin("retry", "waiting")).select(*queue.columns)
    return Judged(
        outcomes,
        kept.unionByName(queue.where(~in_folder)),
        items,
        due.withColumn("as_root", F.lit(False)),
    )


def sync(ws: Workspace, queue_raw: DataFrame, options: SyncOptions) -> SyncResult:
    """Process the queue: outcomes per queue row, documents, registry rows and follow-up work."""
    judged = judge_queue(ws, queue_raw, options)
    written = write_items(ws, judged.items, judged.due, options)
    return SyncResult(written, judged.outcomes, judged.remaining)


def sync_counters(outcomes: DataFrame, written: DataFrame) -> DataFrame:
    """`(metric, value)`: pages processed, skipped, dropped and kept, and files written.

    `written` has one row per written item.
    """
    counts = outcomes.agg(
        F.count_if(F.col("outcome").isin("written", "root_disabled", "no_root")).alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"),
        F.count_if(F.col("outcome").isin("retry", "waiting")).alias("kept"),
    )
    files = written.agg(F.count("*").alias("files_written"))
    return counts.unpivot([], counts.columns, "metric", "value").unionByName(
        files.unpivot([], files.columns, "metric", "value")
    )
