"""Folder listings and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.text import age_label
from leafwork.operators.hierarchy import with_orphan_flag
from leafwork.operators.queueing import queue_summary


def folder_listing(registry: DataFrame) -> DataFrame:
    """Pages, roots and orphans per folder."""
    return with_orphan_flag(registry).groupBy("folder").agg(
        F.count("*").alias("pages"),
        F.count_if(F.coalesce("is_root", F.lit(False))).alias("roots"),
        F.count_if("is_orphaned").alias("orphans"),
    )


def page_listing(registry: DataFrame, as_of: Column) -> DataFrame:
    """One line per page as a flat listing shows it."""
    mark = F.when(F.col("is_orphaned"), " (ORPHANED - parent deleted)").otherwise("")
    return with_orphan_flag(registry).select(
        "folder",
        "id",
        F.concat(
            F.lit("  "), F.coalesce("file_path", F.lit("")), F.lit(' - "'), F.coalesce("title", F.lit("")),
            F.lit('" (last synced: '), age_label(F.col("last_synced"), as_of), F.lit(")"), mark,
        ).alias("line"),
    )


def folder_status(registry: DataFrame, queue_raw: DataFrame, as_of: Column) -> DataFrame:
    """Pages, roots, last sync and queued pages per folder, with the grand total (`is_total`).

    `queued_legacy_only` counts queue files of the old encoding only.
    """
    pages = registry.groupBy("folder").agg(
        F.count("*").alias("pages"),
        F.count_if(F.coalesce("is_root", F.lit(False))).alias("roots"),
        F.max("last_synced").alias("last_synced"),
    )
    queued = queue_summary(queue_raw).groupBy(F.col("folder").alias("q_folder")).agg(
        F.sum("pages").alias("queued_pages"), F.sum("pages_legacy_only").alias("queued_legacy_only")
    )
    per_folder = pages.join(queued, F.col("folder") == F.col("q_folder"), "left")
    return (
        per_folder.rollup("folder")
        .agg(
            (F.grouping("folder") == 1).alias("is_total"),
            F.sum("pages").alias("pages"),
            F.sum("roots").alias("roots"),
            F.max("last_synced").alias("last_synced"),
            F.coalesce(F.sum("queued_pages"), F.lit(0)).alias("queued_pages"),
            F.coalesce(F.sum("queued_legacy_only"), F.lit(0)).alias("queued_legacy_only"),
        )
        .withColumn("age", age_label(F.col("last_synced"), as_of))
    )


def queue_by_folder(queue_raw: DataFrame) -> DataFrame:
    """Queued pages per folder as columns `init` and `update`."""
    return (
        queue_summary(queue_raw)
        .groupBy("folder")
        .pivot("type", ["init", "update"])
        .agg(F.sum("pages"))
        .na.fill(0)
        .withColumn("pages", F.col("init") + F.col("update"))
    )
