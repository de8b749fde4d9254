"""The root manifest: a task list of the pages that anchor each folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import page_id_from_text
from leafwork.operators.ordering import with_index

ENTRY = r"^- \[([ xX])\] \*\*([^*]+)\*\*:\s*(.+)$"  # fixed value: line format
HEADING = ("# Root Pages", "")  # fixed value: first lines


def valid_folder(folder: Column) -> Column:
    return F.coalesce(folder.rlike("^[a-z0-9-]+$"), F.lit(False))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Entries of `lines(line_no, line)`: `(line_no, folder, enabled, url, page_id)`.

    Lines in another form and lines without a page id are not entries.
    """
    line = F.trim("line")
    return (
        lines.where(line.rlike(ENTRY))
        .select(
            "line_no",
            F.trim(F.regexp_extract(line, ENTRY, 2)).alias("folder"),
            (F.lower(F.regexp_extract(line, ENTRY, 1)) == "x").alias("enabled"),
            F.trim(F.regexp_extract(line, ENTRY, 3)).alias("url"),
        )
        .withColumn("page_id", page_id_from_text(F.col("url")))
        .where((F.col("folder") != "") & (F.col("url") != "") & F.col("page_id").isNotNull())
    )


def manifest_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of whole-text files with a `value` column."""
    return files.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def first_per_page(entries: DataFrame) -> DataFrame:
    """The first line of each page; later lines for the same page are duplicates."""
    return entries.groupBy("page_id").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("folder", "line_no").alias("folder"),
        F.min_by("enabled", "line_no").alias("enabled"),
        F.min_by("url", "line_no").alias("url"),
    )


def format_manifest(entries: DataFrame) -> DataFrame:
    """The lines of the manifest, `(line_no, text)` from 0: the heading, a blank line, and the entries in order."""
    box = F.when(F.col("enabled"), "- [x] **").otherwise("- [ ] **")
    lines = entries.select("line_no", "page_id", F.concat(box, "folder", F.lit("**: "), "url").alias("text"))
    numbered = with_index(lines, [F.col("line_no"), F.col("page_id")], "_at")
    heading = entries.sparkSession.createDataFrame(list(enumerate(HEADING)), "line_no BIGINT, text STRING")
    return heading.unionByName(numbered.select((F.col("_at") + len(HEADING)).cast("bigint").alias("line_no"), "text"))


def reconcile_roots(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows after the manifest is applied, with `needs_sync`.

    Listed pages become roots with the folder and enabled flag of the manifest, and new rows where
    they were not registered. `needs_sync` marks listed pages that are new or were never synced.
    Other rows pass through unchanged.
    """
    wanted = first_per_page(entries).select(
        F.col("page_id").alias("m_id"),
        F.col("folder").alias("m_folder"),
        F.col("enabled").alias("m_enabled"),
    )
    merged = registry.join(wanted, F.col("id") == F.col("m_id"), "full_outer")
    listed = F.col("m_id").isNotNull()
    changed = {
        "id": F.coalesce("id", "m_id"),
        "folder": F.coalesce("m_folder", "folder"),
        "is_root": F.coalesce(F.when(listed, F.lit(True)), F.col("is_root"), F.lit(False)),
        "enabled": F.coalesce("m_enabled", "enabled", F.lit(False)),
    }
    return merged.select(
        *[changed[name].alias(name) if name in changed else F.col(name) for name in registry.columns],
        (listed & F.col("last_synced").isNull()).alias("needs_sync"),
    )


def roots_to_queue(reconciled: DataFrame, now: Column) -> DataFrame:
    """Queue rows for enabled roots that need a first sync."""
    return reconciled.where(F.col("needs_sync") & F.col("enabled")).select(
        F.lit("init").alias("type"),
        "folder",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("id").alias("page_id"),
        now.alias("last_edited"),
    )
