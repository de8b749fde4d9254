"""Registered queries. Each has a name, a Spark job over the views, and (mostly) its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import kinds, oracles
from leafwork.catalog import records as rec
from leafwork.catalog.views import Views
from leafwork.functions.ids import blank_to_null, normalize_id, page_id_from_text, shard_key
from leafwork.functions.paths import attachment_name, child_directory, hosted_file_id
from leafwork.functions.properties import property_lines
from leafwork.functions.richtext import user_label
from leafwork.functions.text import slug
from leafwork.operators import attachments, blocks, diff, frontier, hierarchy, ordering, paths, queueing, registry
from leafwork.operators import reindex, render, reports, roots, users
from leafwork.plans import maintenance, pull, sync
from leafwork.session import prepare, scratch_folder, staged
from leafwork.sources import landed, queue_log
from leafwork.streaming import events as edits
from leafwork.streaming import publish
from leafwork.streaming.incremental import newer_than_processed

AS_OF = datetime(2024, 6, 1)
QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Views(prepare(spark), sf_dir))


def seconds(name: str) -> F.Column:
    return F.unix_seconds(F.col(name)).alias(name)


# -- hierarchy ---------------------------------------------------------------------------------


@query
def root_status(v: Views) -> DataFrame:
    """Pages per folder and outcome of the walk to the root, and how many roots are enabled."""
    traced = hierarchy.with_roots(v["fx_registry"])
    return traced.groupBy("folder").agg(
        F.count("*").alias("pages"),
        F.count_if("is_root").alias("roots"),
        F.count_if(F.col("outcome") == hierarchy.FOUND).alias("traced"),
        F.count_if(F.col("outcome") == hierarchy.DANGLING).alias("orphans"),
        F.count_if(F.col("outcome") == hierarchy.CYCLE).alias("cyclic"),
        F.count_if("root_enabled").alias("under_enabled_root"),
        F.unix_seconds(F.max("last_synced")).alias("last_synced"),
    )


@query
def page_roots(v: Views) -> DataFrame:
    """Root, enabled flag and distance of every registered page."""
    found = F.col("outcome") == hierarchy.FOUND
    return hierarchy.trace_roots(v["fx_registry"]).select(
        "id", "root_id", "root_enabled", "outcome", F.when(found, F.col("hops")).alias("hops")
    )


@query
def missing_parents(v: Views) -> DataFrame:
    return hierarchy.missing_parents(v["fx_registry"]).select("id", "parent_id", "folder")


@query
def cleanup_orphans(v: Views) -> DataFrame:
    """Pages to delete because no listed root is above them."""
    listed = roots.parse_manifest(v["fx_root_lines"])
    return maintenance.orphaned_pages(v["fx_registry"], listed).select("id", "file_path", "root_id")


@query
def cleanup_counters(v: Views) -> DataFrame:
    listed = roots.parse_manifest(v["fx_root_lines"])
    return maintenance.cleanup_counters(maintenance.orphaned_pages(v["fx_registry"], listed))


def _nodes(v: Views) -> DataFrame:
    return v["fx_pages"].select(normalize_id(F.col("id")).alias("id"), "parent_id")


@query
def nearest_ancestors(v: Views) -> DataFrame:
    """Nearest registered ancestor of every page, when orders' customers are the registry."""
    traced = staged(hierarchy.with_roots(v["fx_registry"]))
    found = hierarchy.nearest_registered(_nodes(v), traced)
    ended = F.col("outcome") == hierarchy.FOUND
    return found.select(
        "id", "anchor_id", "folder", "found_root",
        F.when(ended, F.col("missing_ancestors")).alias("missing_ancestors"), "outcome",
    )


@query
def ancestor_chain(v: Views) -> DataFrame:
    """What has to be written, root first, to bring in every part page."""
    requested = v["part"].select(F.md5(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("id"))
    plan = maintenance.get_plan(_nodes(v), v["fx_registry"], requested)
    return plan.select("page_id", "write_order", "id", "folder")


@query
def write_set(v: Views) -> DataFrame:
    """Every page that has to be written to bring in all part pages, once, in levels below its anchor."""
    requested = v["part"].select(F.md5(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("id"))
    return maintenance.write_set(frontier.pointers_of(_nodes(v)), v["fx_registry"], requested)


@query
def block_to_page(v: Views) -> DataFrame:
    return hierarchy.block_containers(v["fx_block_parents"])


@query
def folder_listing(v: Views) -> DataFrame:
    return reports.folder_listing(v["fx_registry"])


@query
def page_listing(v: Views) -> DataFrame:
    return reports.page_listing(v["fx_registry"], F.lit(AS_OF))


def _child_table(v: Views) -> DataFrame:
    """Ordered child edges of the registry: customers by name, orders by number."""
    child = v["fx_customer"].select("parent_id", F.col("c_custkey").alias("position"), F.col("id").alias("child_id"))
    order = v["fx_order"].select("parent_id", F.col("o_orderkey").alias("position"), F.col("id").alias("child_id"))
    nation = v["fx_nation"].select("parent_id", F.col("n_nationkey").cast("bigint").alias("position"), F.col("id").alias("child_id"))
    return child.unionByName(order).unionByName(nation)


@query
def tree_listing(v: Views) -> DataFrame:
    return hierarchy.tree_listing(v["fx_registry"], _child_table(v)).select(
        "folder", "root_id", "id", "depth", "sort_key", "is_last"
    )


@query
def tree_order(v: Views) -> DataFrame:
    """The listing by places: each root's pages are numbered depth first."""
    return hierarchy.preorder(v["fx_registry"], _child_table(v))


@query
def folder_status(v: Views) -> DataFrame:
    status = reports.folder_status(v["fx_registry"], rec.queue_entries(v), F.lit(AS_OF))
    return status.withColumn("last_synced", F.unix_seconds("last_synced"))


# -- change detection --------------------------------------------------------------------------

PULL = pull.PullOptions(cutoff=datetime(2000, 6, 1), bound=datetime(1998, 1, 1), include_untracked=True)


def _decided(v: Views, options: pull.PullOptions = PULL, changed_only: bool = False) -> DataFrame:
    pages = rec.page_records(v["fx_pages"])
    return staged(pull.classify_changes(pages, _nodes(v), v["fx_registry"], options, changed_only=changed_only))


@query
def pull_decisions(v: Views) -> DataFrame:
    return _decided(v).select("id", seconds("last_edited"), "tracked", "folder", "decision")


@query
def pull_queue(v: Views) -> DataFrame:
    rows = pull.queue_rows(_decided(v, changed_only=True), first=1000)
    return rows.select("seq", "pos", "type", "folder", "page_id", seconds("last_edited"))


@query
def pull_counters(v: Views) -> DataFrame:
    options = pull.PullOptions(cutoff=PULL.cutoff, bound=PULL.bound, include_untracked=True, folder="asia")
    return pull.pull_counters(_decided(v, options), v["fx_pages"])


@query
def pull_limited(v: Views) -> DataFrame:
    """Counters of a pull that ends after 25 pages."""
    options = pull.PullOptions(cutoff=PULL.cutoff, bound=PULL.bound, max_pages=25)
    return pull.pull_counters(_decided(v, options), v["fx_pages"])


@query
def pull_bounds(v: Views) -> DataFrame:
    state = pull.next_state(_decided(v), None, PULL, AS_OF)
    return state.select(
        "version", F.array_join("folders", ",").alias("folders"), seconds("last_pull_time"), seconds("oldest_pull_result")
    )


@query
def workspace_pages(v: Views) -> DataFrame:
    """Pages at the top of the workspace whose title contains a word."""
    found = landed.search(rec.page_records(v["fx_pages"]), kind="page", query="A", workspace_level=True)
    return found.select("id", F.col("properties.title.title")[0]["plain_text"].alias("title"))


@query
def newest_pages(v: Views) -> DataFrame:
    return landed.newest_first(rec.page_records(v["fx_pages"]), 100).select("id", seconds("last_edited_time"))


# -- queue -------------------------------------------------------------------------------------


@query
def queue_order(v: Views) -> DataFrame:
    """Queue rows of both encodings with their global turn."""
    rows = queueing.explode_queue(rec.queue_entries(v))
    numbered = ordering.with_index(rows, [F.col("seq"), F.col("pos")], "turn")
    return numbered.select("turn", "seq", "pos", "type", "folder", "page_id", seconds("last_edited"), "legacy")


@query
def queue_chunks(v: Views) -> DataFrame:
    """All orders queued again: files of ten per folder and type, numbered from 1000."""
    rows = v["fx_queue_rows"].select(
        "type", "folder", F.lit(None).cast("string").alias("parent_id"), "page_id", "last_edited"
    )
    numbered = queueing.number_files(rows, [F.col("last_edited").desc(), F.col("page_id")])
    return numbered.select("seq", "pos", "type", "folder", "page_id")


@query
def queue_skip(v: Views) -> DataFrame:
    rows = queueing.with_skips(queueing.explode_queue(rec.queue_entries(v)), v["fx_registry"])
    return rows.select("seq", "pos", "page_id", "registered", "skip")


@query
def queue_budget(v: Views) -> DataFrame:
    """Which rows a run may touch that processes 100 pages out of the first 60 files."""
    rows = queueing.with_skips(queueing.explode_queue(rec.queue_entries(v)), v["fx_registry"])
    limited = queueing.within_budget(
        rows, max_pages=100, max_queue_files=60, page_cost=(~F.col("skip")).cast("int")
    )
    return limited.select("seq", "pos", "page_id", "in_budget")


@query
def queue_log_rows(v: Views) -> DataFrame:
    """What waits after a pull, events that go before it, and a run with retries and follow-up work.

    Every commit is made twice, as after a failure.
    """
    path = scratch_folder(v.spark, "queue-log")
    pulled = v["fx_queue_rows"].withColumn("parent_id", F.lit(None).cast("string"))
    changed = v["fx_customer"].where("c_custkey % 3 = 0").select(
        F.lit("update").alias("type"), "folder", F.lit(None).cast("string").alias("parent_id"), F.col("id").alias("page_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") % 50).alias("last_edited"),
    )
    found = v["fx_order"].where("o_orderkey % 5 = 0").select(
        F.lit("init").alias("type"), "folder", "parent_id", F.col("id").alias("page_id"), F.lit(None).cast("timestamp").alias("last_edited"),
        F.col("o_orderkey").alias("position"),
    )
    for _ in range(2):
        queue_log.commit(v.spark, path, "pull", 0, pulled)
        queue_log.add_events(v.spark, path, 0, changed)
        turn = F.pmod(F.col("seq") + F.col("pos"), F.lit(3))
        outcome = F.when(turn == 0, "written").when(turn == 1, "retry").otherwise("waiting")
        ran = queue_log.read_log(v.spark, path, upto=2, columns=queue_log.KEY).select("seq", "pos", outcome.alias("outcome"))
        queue_log.settle(v.spark, path, 0, ran, found)
    columns = ["seq", "pos", "type", "folder", "parent_id", "page_id", "attempts"]
    return queue_log.read_log(v.spark, path, columns=columns)


@query
def queue_summary(v: Views) -> DataFrame:
    return queueing.queue_summary(rec.queue_entries(v))


@query
def queue_by_folder(v: Views) -> DataFrame:
    return reports.queue_by_folder(rec.queue_entries(v))


@query
def queue_remaining(v: Views) -> DataFrame:
    """Queue files after the rows that need no work are acknowledged."""
    rows = staged(queueing.with_skips(queueing.explode_queue(rec.queue_entries(v)), v["fx_registry"]))
    left = queueing.remaining(rows, rows.where("skip"))
    files = queueing.collapse_queue(left)
    pages = F.transform("pages", lambda p: p["id"])
    return files.select("seq", "type", "folder", F.array_join(F.coalesce(pages, "pageIds"), ",").alias("pages"))


@query
def folders_in_use(v: Views) -> DataFrame:
    return queueing.folders_in_use(v["fx_queue_rows"], "seq")


@query
def error_split(v: Views) -> DataFrame:
    """Which failed pages are dropped and which are tried again."""
    errors = v["events"].select(
        F.md5(F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("page_id"),
        F.get(F.array(*[F.lit(s) for s in (401, 403, 404, 400, 429, 500)]), (F.col("event_id") % 6).cast("int")).alias("status"),
        F.when(F.col("event_id") % 4 == 3, "validation_error").otherwise("rate_limited").alias("code"),
        (F.col("event_id") % 10 == 0).alias("no_data_sources"),
    )
    return queueing.split_errors(errors)


# -- paths -------------------------------------------------------------------------------------


@query
def page_slugs(v: Views) -> DataFrame:
    """File-name form of every line of every document."""
    lines = v["documents"].select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", slug(F.col("line")).alias("slug"))


def _new_paths(v: Views, order_id: F.Column | None = None) -> DataFrame:
    """Orders as new pages, named after their priority, below customers with and without paths."""
    kept = v["fx_region"].unionByName(v["fx_nation"], allowMissingColumns=True)
    customers = v["fx_customer"].where("c_custkey % 4 <> 2")
    known = kept.unionByName(customers, allowMissingColumns=True).select("id", "file_path")
    rest = v["fx_customer"].where("c_custkey % 4 = 2").select(
        "id", "parent_id", F.lit("A customer").alias("title"), "folder", "is_root", F.lit(1).cast("bigint").alias("priority")
    )
    new = v["fx_order"].select(
        (F.col("id") if order_id is None else order_id).alias("id"), "parent_id", F.col("o_orderpriority").alias("title"), "folder", "is_root",
        (F.col("o_orderkey") % 3).alias("priority"),
    )
    return paths.assign_paths(new.unionByName(rest), known)


@query
def page_paths(v: Views) -> DataFrame:
    return _new_paths(v)


@query
def path_collisions(v: Views) -> DataFrame:
    """Pages and paths when the ids of many pages start alike; no path may be held twice."""
    alike = F.concat(F.substring(F.md5((F.col("o_orderkey") % 8).cast("string")), 1, 4), F.substring("id", 5, 28))
    placed = _new_paths(v, alike)
    held = placed.groupBy(F.lower("file_path")).agg(F.count("*").alias("n"))
    return held.agg(F.sum("n").alias("pages"), F.count("*").alias("paths"), (F.count("*") - F.sum("n")).alias("missing"))


# -- rendering ---------------------------------------------------------------------------------


def _placed_docs(v: Views) -> DataFrame:
    flat = v["fx_doc_pages"].select(
        F.col("id").alias("p_id"), F.lit("notes").alias("folder"),
        F.concat(F.lit("notes/note-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.expr("timestamp '2024-05-01 00:00:00'").alias("last_synced"),
        (F.col("doc_id") % 2 == 0).alias("is_root"),
        F.col("parent_id").alias("resolved_parent_id"),
    )
    pages = rec.doc_page_records(v).join(flat, F.col("id") == F.col("p_id"))
    return users.enrich_users(pages, v["fx_users"])


@query
def render_pages(v: Views) -> DataFrame:
    return render.render_pages(_placed_docs(v), rec.doc_blocks(v))


@query
def render_kinds(v: Views) -> DataFrame:
    """A page per customer with a block of every kind and a property of every type."""
    return render.render_pages(kinds.kind_pages(v), blocks.prepared(kinds.kind_blocks(v)))


@query
def block_paths(v: Views) -> DataFrame:
    """Level, indentation and position of every block that is shown."""
    tree = blocks.with_context(rec.doc_blocks(v)).where("visible")
    return tree.select("block_id", "level", "depth", F.array_join("path", ".").alias("path"))


@query
def block_depth_limit(v: Views) -> DataFrame:
    """Orders whose lines, each below the one before, are cut below the fourth level."""
    return blocks.depth_limited(rec.line_blocks(v), 3).select("page_id", "blocks_kept", "was_limited")


def _placed_databases(v: Views) -> DataFrame:
    return rec.database_records(v).select(
        "*", F.lit("data").alias("folder"),
        F.concat(F.lit("data/"), slug(F.col("title")[0]["plain_text"]), F.lit(".md")).alias("file_path"),
        F.lit(None).cast("timestamp").alias("last_synced"), F.lit(False).alias("is_root"),
        F.col("parent.page_id").alias("resolved_parent_id"),
    )


@query
def render_databases(v: Views) -> DataFrame:
    return render.render_databases(_placed_databases(v), rec.entry_records(v))


@query
def entry_properties(v: Views) -> DataFrame:
    return rec.entry_records(v).select("id", property_lines(F.col("properties")).alias("lines"))


@query
def user_labels(v: Views) -> DataFrame:
    """Authors and editors of all pages as they are shown."""
    pages = users.enrich_users(rec.doc_page_records(v), v["fx_users"])
    return pages.select("id", user_label(F.col("created_by")).alias("author"), user_label(F.col("last_edited_by")).alias("editor"))


@query
def unknown_users(v: Views) -> DataFrame:
    known = v["fx_users"].where("type = 'bot'")
    return users.unknown_users(rec.doc_page_records(v), known)


@query
def child_ids(v: Views) -> DataFrame:
    return blocks.child_edges(rec.link_blocks(v))


@query
def database_children(v: Views) -> DataFrame:
    entries = render.direct_entries(rec.database_records(v), rec.entry_records(v))
    edges = entries.select(F.col("database_id").alias("parent_id"), F.col("position").alias("at"), F.col("entry_id").alias("child_id"))
    return blocks.positions(edges, "at")


@query
def database_sources(v: Views) -> DataFrame:
    """Databases whose first data source was landed, and the rejects, in one list."""
    containers = rec.database_records(v).withColumn(
        "data_sources", F.when(F.col("id").rlike("^[0-7]"), F.col("data_sources")).otherwise(F.array().cast("array<struct<id:string,name:string>>"))
    )
    sources = containers.where(F.col("id").rlike("^[0-3]")).select(
        F.col("data_sources")[0]["id"].alias("id"), F.col("data_sources")[0]["name"].alias("name")
    )
    databases, rejects = landed.join_databases(containers, sources)
    good = databases.select(F.col("id").alias("page_id"), F.lit("database").alias("result"))
    bad = queueing.split_errors(rejects).select("page_id", F.col("action").alias("result"))
    return good.unionByName(bad)


@query
def new_children(v: Views) -> DataFrame:
    """Customers that a scan of the nation pages finds and that are not registered yet."""
    known = v["fx_nation"].unionByName(v["fx_customer"].where("c_custkey % 7 <> 0"), allowMissingColumns=True)
    found = maintenance.new_children(rec.link_blocks(v), known, v["fx_nation"].select("id"))
    return found.select("type", "folder", "parent_id", "page_id", "position")


# -- registry ----------------------------------------------------------------------------------


def _stored(v: Views) -> DataFrame:
    return v["fx_stored"].select("id", "type", "folder", "title", "parent_id")


@query
def registry_overlay(v: Views) -> DataFrame:
    """Stored records with pending changes and deletions applied."""
    pending = v["fx_customer"].where("c_custkey % 6 = 0 or c_custkey % 4 = 1").select("id", "type", F.lit("pending").alias("folder"), "title", "parent_id")
    deleted = v["fx_customer"].where("c_custkey % 10 = 0").select("id")
    return registry.overlay(_stored(v), pending, deleted).select("id", "folder", "title")


@query
def registry_union(v: Views) -> DataFrame:
    """Index records and not yet migrated files as one listing."""
    deleted = v["fx_customer"].where("c_custkey % 9 = 0").select("id")
    legacy = v["fx_legacy"].select("file_name", "id", "type", "folder", "title", "parent_id")
    stored = _stored(v).join(deleted, "id", "left_anti")
    return registry.listed_registry(stored, legacy, deleted).select("id", "folder")


@query
def compact_merge(v: Views) -> DataFrame:
    return registry.compact(_stored(v), v["fx_legacy"], "page").select("id", "folder", "parent_id")


@query
def compact_files(v: Views) -> DataFrame:
    return registry.absorbed(v["fx_legacy"], "file", ["id", "title", "source_url"])


@query
def compact_counters(v: Views) -> DataFrame:
    return registry.compaction_counters(v["fx_legacy"])


@query
def shard_occupancy(v: Views) -> DataFrame:
    return registry.shard_occupancy(v["fx_registry"])


@query
def index_lines(v: Views) -> DataFrame:
    return registry.index_lines(v["fx_registry"])


@query
def shard_keys(v: Views) -> DataFrame:
    """Shard of ids of every shape: hex ids, upper case, words, short and empty ones."""
    return v["fx_legacy"].select("file_name", "id", shard_key(F.col("id")).alias("shard"))


@query
def reindex_latest(v: Views) -> DataFrame:
    parsed = reindex.parse_documents(v["fx_markdown"].where(reindex.corpus_path(F.col("path"))))
    return reindex.latest_records(parsed).select(
        "id", "type", "folder", "file_path", "title", seconds("last_edited"), seconds("last_synced"), "is_root", "parent_id"
    )


@query
def reindex_duplicates(v: Views) -> DataFrame:
    parsed = reindex.parse_documents(v["fx_markdown"].where(reindex.corpus_path(F.col("path"))))
    return reindex.duplicate_files(staged(parsed))


@query
def reindex_rejects(v: Views) -> DataFrame:
    parsed = reindex.parse_documents(v["fx_markdown"].where(reindex.corpus_path(F.col("path"))))
    return parsed.where("reject is not null").select("path", "reject")


@query
def reindex_counters(v: Views) -> DataFrame:
    parsed = reindex.parse_documents(v["fx_markdown"].where(reindex.corpus_path(F.col("path"))))
    return reindex.reindex_counters(staged(parsed))


@query
def document_diff(v: Views) -> DataFrame:
    hashed = v["fx_published"].select("edition", "path", F.sha2("content", 256).alias("content_hash"))
    old = hashed.where("edition = 'old'").drop("edition")
    new = hashed.where("edition = 'new'").drop("edition")
    return diff.diff_documents(old, new)


@query
def commit_log(v: Views) -> DataFrame:
    """Two commits of rendered documents, the second made twice: a third of the pages moved in between."""
    path = scratch_folder(v.spark, "commits")
    docs = v["documents"].withColumn("edited", F.concat("text", F.when(F.col("doc_id") % 4 == 0, "\nedited").otherwise("")))

    def rendered(text: str, folder: F.Column) -> DataFrame:
        name = F.concat(folder, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
        return docs.select(
            F.md5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("page_id"), name.alias("file_path"),
            F.lit(0).cast("bigint").alias("part_no"), F.sha2(text, 256).alias("content_hash"), F.lit(1).alias("version"),
        )

    publish.commit_documents(rendered("text", F.col("lang")), path, 1)
    moved = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("lang"))
    for _ in range(2):
        publish.commit_documents(rendered("edited", moved), path, 2)
    return publish.read_commits(v.spark, path).select("commit", "page_id", "path", "content_hash", "change")


# -- root manifest -----------------------------------------------------------------------------


@query
def root_manifest(v: Views) -> DataFrame:
    entries = roots.parse_manifest(v["fx_root_lines"])
    return roots.first_per_page(entries).withColumn("folder_ok", roots.valid_folder(F.col("folder")))


def _reconciled(v: Views) -> DataFrame:
    """The registry of regions, nations and two of three customers after the manifest is applied."""
    known = v["fx_region"].unionByName(v["fx_nation"], allowMissingColumns=True)
    known = known.unionByName(v["fx_customer"].where("c_custkey % 3 <> 0"), allowMissingColumns=True)
    known = known.drop("r_regionkey", "n_nationkey", "c_custkey")
    return roots.reconcile_roots(roots.parse_manifest(v["fx_root_lines"]), known)


@query
def root_reconcile(v: Views) -> DataFrame:
    return _reconciled(v).select("id", "folder", "is_root", "enabled", "needs_sync")


@query
def root_queue(v: Views) -> DataFrame:
    rows = queueing.number_files(roots.roots_to_queue(_reconciled(v), F.lit(AS_OF)), [F.col("page_id")])
    return rows.select("seq", "pos", "type", "folder", "page_id")


@query
def root_text(v: Views) -> DataFrame:
    """The manifest without duplicates, line by line."""
    return roots.format_manifest(roots.first_per_page(roots.parse_manifest(v["fx_root_lines"])))


@query
def ids_in_links(v: Views) -> DataFrame:
    """Page ids found in the URLs of pages and in URLs made from them."""
    url = F.concat("url", F.lit("#"), F.md5("url"))
    made = F.concat(F.lit("https://example.com/team/A-Page-"), F.md5("url"), F.lit("?v="), F.col("page_id").cast("string"))
    both = v["pages"].select("page_id", F.explode(F.array(url, made)).alias("link"))
    return both.select("page_id", "link", page_id_from_text(F.col("link")).alias("found_id"))


# -- attachments -------------------------------------------------------------------------------


def page_links(v: Views) -> DataFrame:
    """Links of the web pages; every second link of a page points to a hosted file."""
    href = v["pages"].select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("position", "href")
    )
    uuid = F.regexp_replace(F.md5("href"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    hosted = F.concat(
        F.lit("https://bucket.s3.region.amazonaws.com/ws/"), uuid, F.lit("/"),
        F.regexp_replace("href", "[^a-zA-Z]", ""), F.lit("%20File.PNG?sig="), F.col("page_id").cast("string"),
    )
    return href.select(
        F.md5(F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("page_id"),
        F.concat(F.lit("web/page-"), (F.col("page_id") % 20).cast("string"), F.lit(".md")).alias("page_path"),
        "position",
        F.when(F.col("position") % 2 == 0, hosted).otherwise(F.concat(F.lit("https://example.com"), "href")).alias("url"),
    )


def _placed_files(v: Views) -> tuple[DataFrame, DataFrame]:
    links = staged(attachments.attachment_links(page_links(v)))
    ids = links.where("file_id is not null").select("file_id").distinct()
    files = ids.where(F.col("file_id").rlike("^[0-3]")).select(
        F.col("file_id").alias("id"), F.concat(F.lit("web/old/files/"), "file_id", F.lit(".png")).alias("file_path")
    )
    # of files that would go to their first page, some are stored there already, some find a stranger's file
    first = links.where("file_id is not null").groupBy("file_id").agg(
        F.min_by(F.struct("page_path", "url"), F.struct("page_path", "position", "url")).alias("at")
    )
    stored = first.where(F.col("file_id").rlike("^[45]"))
    manifests = stored.select(
        F.concat(child_directory(F.col("at.page_path")), F.lit("/files/"), attachment_name(F.col("at.url")), F.lit(attachments.SIDECAR)).alias("path"),
        F.when(F.col("file_id").rlike("^4"), F.col("file_id")).otherwise(F.md5(F.concat(F.lit("stranger:"), "file_id"))).alias("file_id"),
    )
    sizes = ids.select("file_id", (F.conv(F.substring("file_id", 1, 5), 16, 10).cast("bigint")).alias("size"))
    placed = attachments.with_sizes(attachments.place_files(links, files, manifests), sizes)
    return links, placed


@query
def attachment_names(v: Views) -> DataFrame:
    return _placed_files(v)[1].select("file_id", "file_path", "is_new", "page_id", "source_url", "too_large")


@query
def attachment_links(v: Views) -> DataFrame:
    links, placed = _placed_files(v)
    return attachments.resolve_links(links, staged(placed)).select("page_id", "position", "file_id", "shown")


@query
def attachment_sizes(v: Views) -> DataFrame:
    """Files over and under the limit; a document's text stands for a file."""
    files = v["documents"].select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return attachments.size_profile(files, limit=4096)


@query
def hosted_links(v: Views) -> DataFrame:
    return page_links(v).groupBy(hosted_file_id(F.col("url")).alias("file_id")).agg(F.count("*").alias("links"))


# -- events ------------------------------------------------------------------------------------


def _classified(v: Views) -> DataFrame:
    return edits.classify_events(rec.raw_events(v), rec.SECRET)


@query
def event_status(v: Views) -> DataFrame:
    """What happens to every request: status, route and the time it arrived."""
    return _classified(v).select(
        "event_id", F.unix_micros("received_at").alias("received_at"), "status", "route"
    )


@query
def event_queue(v: Views) -> DataFrame:
    known = v["fx_customer"].where("c_custkey % 3 <> 0")
    rows = edits.event_queue_rows(_classified(v), known)
    return rows.select("seq", "type", "folder", "page_id", F.unix_micros("last_edited").alias("arrived"))


@query
def event_routes(v: Views) -> DataFrame:
    return _classified(v).groupBy("status", "route").agg(F.count("*").alias("events"))


@query
def event_coalesced(v: Views) -> DataFrame:
    """Pending changes with the registry's knowledge of them: what is still newer."""
    rows = edits.coalesced(_classified(v)).select(
        F.col("entity_id").alias("page_id"), F.col("last_at").alias("last_edited"), "notifications"
    )
    known = v["fx_customer"].select(
        "id", F.when(F.col("c_custkey") % 2 == 0, F.expr("timestamp '2024-01-30 12:00:00'"))
        .otherwise(F.col("last_edited")).alias("last_edited"),
    )
    return newer_than_processed(rows, known).select(
        "page_id", F.unix_micros("last_edited").alias("last_edited"), "notifications"
    )


@query
def event_debounce(v: Views) -> DataFrame:
    """Bursts of changes per page that are at most four hours apart."""
    found = edits.bursts(_classified(v), 4 * 3600)
    return found.select(
        "entity_id", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "events"
    )


@query
def event_periods(v: Views) -> DataFrame:
    return edits.periods(_classified(v), "1 hour").withColumn("period_start", F.unix_seconds("period_start"))


@query
def event_deletions(v: Views) -> DataFrame:
    return _classified(v).where("route = 'deletion'").select(
        "event_id", "entity_id", "event_type", F.unix_micros("received_at").alias("received_at")
    )


# -- sync --------------------------------------------------------------------------------------


def _landed_blocks(v: Views) -> DataFrame:
    path = scratch_folder(v.spark, "blocks")
    landed.land_blocks(rec.doc_blocks(v), path)
    return landed.read_bucketed_blocks(v.spark, path)


def workspace(v: Views) -> sync.Workspace:
    """The example workspace as landed tables: written once, read by every step of the job."""
    known = v["fx_region"].unionByName(v["fx_nation"], allowMissingColumns=True).drop("r_regionkey", "n_nationkey")
    errors = v["fx_doc_pages"].where("doc_id % 29 = 8").select(
        F.col("id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, 404).otherwise(500).alias("status"),
        F.lit(None).cast("string").alias("code"), F.lit(False).alias("no_data_sources"),
    )
    return sync.Workspace(
        pages=staged(rec.doc_page_records(v)), databases=staged(rec.database_records(v)),
        entries=staged(rec.entry_records(v)), blocks=_landed_blocks(v), users=v["fx_users"],
        registry=staged(known), errors=errors,
    )


def sync_queue(v: Views) -> DataFrame:
    """Eight of ten document pages, and all databases with entries, ten per file."""
    docs = v["fx_doc_pages"].where("doc_id % 10 not in (2, 3)").select(
        (F.lit(1000) + F.floor(F.col("doc_id") / 10)).cast("bigint").alias("seq"), F.col("doc_id").alias("at"),
        F.lit("update").alias("type"), "id", "last_edited",
    )
    dbs = v["fx_databases"].select(
        (F.lit(100) + F.replace("title", F.lit("Brand#"), F.lit("")).cast("int")).cast("bigint").alias("seq"),
        F.lit(0).cast("bigint").alias("at"), F.lit("update").alias("type"), "id",
        F.expr("timestamp '2024-03-01 00:00:00'").alias("last_edited"),
    )
    rows = F.sort_array(F.collect_list(F.struct("at", "id", "last_edited")))
    return docs.unionByName(dbs).groupBy("seq", "type").agg(rows.alias("rows")).select(
        "seq", "type", F.lit("requested").alias("folder"),
        F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["last_edited"].alias("last_edited"))).alias("pages"),
        F.lit(None).cast("array<string>").alias("pageIds"), F.lit(None).cast("string").alias("parentId"),
    )


OPTIONS = sync.SyncOptions(now=AS_OF)


@query
def sync_placement(v: Views) -> DataFrame:
    """Parent, flags and path of every item a sync of the whole queue writes."""
    ws = workspace(v)
    judged = sync.judge_queue(ws, sync_queue(v), OPTIONS)
    placed = sync.place_items(ws, judged.items, judged.due, OPTIONS)
    return placed.select("id", "type", "folder", "file_path", "title", "is_root", "enabled", "parent_id")


@query
def sync_outcomes(v: Views) -> DataFrame:
    return sync.judge_queue(workspace(v), sync_queue(v), OPTIONS).outcomes.select("seq", "pos", "page_id", "outcome")


@query
def sync_counters(v: Views) -> DataFrame:
    judged = sync.judge_queue(workspace(v), sync_queue(v), OPTIONS)
    return sync.sync_counters(judged.outcomes, judged.due)


@query
def sync_child_queue(v: Views) -> DataFrame:
    """Follow-up work: entries of the synchronised databases that are not registered."""
    ws = workspace(v)
    judged = sync.judge_queue(ws, sync_queue(v), OPTIONS)
    placed = staged(sync.place_items(ws, judged.items, judged.due, OPTIONS))
    rows = sync.follow_up(ws, placed, sync.discovered_children(ws, placed, OPTIONS), OPTIONS)
    numbered = queueing.number_files(rows, [F.col("position"), F.col("page_id")], first=5000)
    return numbered.select("seq", "pos", "type", "folder", "parent_id", "page_id")


@query
def sync_documents(v: Views) -> DataFrame:
    """The documents a sync of the whole queue writes."""
    documents = sync.sync(workspace(v), sync_queue(v), OPTIONS).written.documents
    return documents.select("page_id", "file_path", "part_no", "content_hash", F.length("content").alias("chars"))


@query
def add_roots(v: Views) -> DataFrame:
    """Databases added as roots: their registry rows."""
    wanted = rec.database_records(v).select("id", F.lit("data").alias("folder"), F.lit(True).alias("force_update"))
    written = maintenance.add_roots(workspace(v), wanted, OPTIONS)
    return written.registry.select("id", "type", "folder", "file_path", "is_root", "enabled", "parent_id")


ORACLES: dict[str, str] = oracles.build()
