"""Work queues: reading both encodings, numbering, chunking, skipping, budgets, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id
from leafwork.operators.ordering import with_index, with_running_sum
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

PAGES_PER_FILE = 10  # fixed value
FIRST_REGULAR = 1000  # fixed value: regular files count up from here, event files down from 999


def explode_queue(raw: DataFrame) -> DataFrame:
    """One row per queued page: `(seq, pos, type, folder, parent_id, page_id, last_edited, legacy)`.

    A file with `pages` uses the current encoding; otherwise its `pageIds` are read and the edit
    time is null.
    """
    current = F.size(F.coalesce("pages", F.array())) > 0
    rows = F.when(
        current,
        F.transform("pages", lambda p: F.struct(
            p["id"].alias("id"), p["last_edited"].alias("last_edited"))),
    ).otherwise(
        F.transform("pageIds", lambda i: F.struct(
            i.alias("id"), F.lit(None).cast("timestamp").alias("last_edited")))
    )
    return raw.select(
        "seq", "type", "folder",
        normalize_id(F.col("parentId")).alias("parent_id"),
        (~current).alias("legacy"),
        F.posexplode(rows).alias("pos", "page"),
    ).select(
        "seq", "pos", "type", "folder", "parent_id",
        normalize_id(F.col("page.id")).alias("page_id"), "page.last_edited", "legacy",
    )


def collapse_queue(rows: DataFrame) -> DataFrame:
    """Queue files again, at most PAGES_PER_FILE pages each, in the encoding the rows came in."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "page_id", "last_edited")))
    return rows.groupBy("seq", "type", "folder", "parent_id", "legacy").agg(
        ordered.alias("rows")
    ).select(
        "seq", "type", "folder", F.col("parent_id").alias("parentId"),
        F.when(~F.col("legacy"), F.transform("rows", lambda r: F.struct(
            r["page_id"].alias("id"), r["last_edited"].alias("last_edited")))).alias("pages"),
        F.when(F.col("legacy"), F.transform("rows", lambda r: r["page_id"])).alias("pageIds"),
    )


def next_number(queue: DataFrame) -> int:
    """Next free regular file number."""
    highest = queue.where(F.col("seq") >= FIRST_REGULAR).agg(F.max("seq")).first()[0]
    return FIRST_REGULAR if highest is None else int(highest) + 1


def number_files(
    rows: DataFrame, order: Sequence[Column], *, first: int = FIRST_REGULAR,
    per_file: int = PAGES_PER_FILE, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Add `seq` and `pos`: files of `per_file` pages per (type, folder, parent), numbered from `first`.

    `rows(type, folder, parent_id, page_id, …)`. Groups are numbered in the order of their keys
    and rows within a group in `order`, which ends with something unique. One folder may hold
    most of the queue, so rows get a global number first and only the group table, one row per
    group, carries the sums of files in the groups before.
    """
    group = F.concat_ws(
        "\x00", "folder", "type", F.coalesce("parent_id", F.lit(""))
    )
    indexed = staged(with_index(rows.withColumn("_group", group), [F.col("_group"), *order], "_at"))
    groups = indexed.groupBy("_group").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    groups = groups.withColumn("_files", F.ceil(F.col("_rows") / F.lit(per_file)))
    before = with_running_sum(groups, [F.col("_group")], "_files", "_before").select(
        F.col("_group").alias("_g"), "_first", "_before"
    )
    place = F.col("_at") - F.col("_first")
    return (
        lookup(indexed, before, "_group", "_g", how="inner", floor=floor)
        .withColumn("seq", (F.lit(first) + F.col("_before") + F.floor(place / per_file)).cast("bigint"))
        .withColumn("pos", (place % per_file).cast("int"))
        .drop("_group", "_g", "_at", "_first", "_before")
    )


def number_events(rows: DataFrame, order: Sequence[Column], *, first: int = FIRST_REGULAR) -> DataFrame:
    """Event files: one page each, the latest arrival first, all before the regular files.

    `seq` counts down from 999 with arrival; it may pass below zero, where the order still holds.
    """
    return (
        with_index(rows, order, "_at")
        .withColumn("seq", (F.lit(first - 1) - F.col("_at")).cast("bigint"))
        .withColumn("pos", F.lit(0))
        .drop("_at")
    )


def with_skips(queue: DataFrame, registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Add `registered` and `skip`.

    Current encoding: skip a registered page whose queued edit time is not newer, whatever the
    entry type. Old encoding: skip any registered page of an `init` entry, never of an `update`.
    """
    known = registry.select(F.col("id").alias("k_id"), F.col("last_edited").alias("k_edited"))
    joined = lookup(queue, known, "page_id", "k_id", floor=floor)
    registered = F.col("k_id").isNotNull()
    unchanged = F.coalesce(F.col("last_edited") <= F.col("k_edited"), F.lit(False))
    return (
        joined.withColumn("registered", registered)
        .withColumn(
            "skip",
            F.when(F.col("legacy"), registered & (F.col("type") == "init")).otherwise(
                registered & unchanged
            ),
        )
        .drop("k_id", "k_edited")
    )


def within_budget(
    rows: DataFrame, *, max_pages: int = 0, max_files: int = 0, max_queue_files: int = 0,
    page_cost: Column | None = None, file_cost: Column | None = None,
) -> DataFrame:
    """Add `in_budget`: whether the limits are still open when the row's turn comes.

    Turns follow `(seq, pos)`. A row is reached while fewer than `max_pages` pages have been
    processed, fewer than `max_files` files written and its queue file is among the first
    `max_queue_files`. Zero means no limit. Skipped rows cost nothing.
    """
    order = [F.col("seq"), F.col("pos")]
    result = rows.withColumn("in_budget", F.lit(True))
    for limit, cost in ((max_pages, page_cost), (max_files, file_cost)):
        if limit:
            result = (
                with_running_sum(
                    result.withColumn("_cost", F.lit(1) if cost is None else cost), order, "_cost", "_spent"
                )
                .withColumn("in_budget", F.col("in_budget") & (F.col("_spent") < limit))
                .drop("_cost", "_spent")
            )
    if max_queue_files:
        files = with_index(rows.select("seq").distinct(), [F.col("seq")], "_file")
        allowed = files.where(F.col("_file") < max_queue_files).select("seq", F.lit(True).alias("_open"))
        result = result.join(allowed, "seq", "left").withColumn(
            "in_budget", F.col("in_budget") & F.coalesce("_open", F.lit(False))
        ).drop("_open")
    return result


def permanent_error(status: Column, code: Column, no_data_sources: Column) -> Column:
    """Errors that no retry can cure."""
    return (
        status.isin(401, 403, 404)
        | ((status == 400) & (F.coalesce(code, F.lit("")) == "validation_error"))
        | F.coalesce(no_data_sources, F.lit(False))
    )


def split_errors(errors: DataFrame) -> DataFrame:
    """Errors with `action`: `drop` or `retry`."""
    lasting = permanent_error(F.col("status"), F.col("code"), F.col("no_data_sources"))
    return errors.withColumn("action", F.when(lasting, "drop").otherwise("retry"))


def remaining(queue: DataFrame, done: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Queue rows whose `(seq, pos)` is not in `done`; files without rows left disappear."""
    return queue.join(done.select("seq", "pos"), ["seq", "pos"], "left_anti")


def queue_summary(raw: DataFrame) -> DataFrame:
    """Files and pages per folder and type, counting both encodings.

    `pages_legacy_only` is the count a report would show that looks at the old encoding alone.
    """
    old = F.size(F.coalesce("pageIds", F.array()))
    new = F.size(F.coalesce("pages", F.array()))
    kind = F.when(F.col("type") == "init", "init").otherwise("update")
    return (
        raw.select("folder", kind.alias("type"), F.when(new > 0, new).otherwise(old).alias("n"), old.alias("o"))
        .groupBy("folder", "type")
        .agg(
            F.count("*").alias("files"),
            F.sum("n").alias("pages"),
            F.sum("o").alias("pages_legacy_only"),
        )
    )


def folders_in_use(rows: DataFrame, order: str) -> DataFrame:
    """Distinct folders by first appearance: `(folder, first_seen)`."""
    return (
        rows.where(blank_to_null(F.col("folder")).isNotNull())
        .groupBy("folder")
        .agg(F.min(order).alias("first_seen"))
    )
