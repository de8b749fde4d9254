"""Rebuild page records from a corpus of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id
from leafwork.functions.paths import stem
from leafwork.functions.text import trim_space

MARK = "---"  # fixed value: first and last line of a metadata header
_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def corpus_path(path: Column) -> Column:
    """Markdown files outside hidden directories."""
    folders = F.split(path, "/")
    hidden = F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda part: part.startswith("."))
    return path.endswith(".md") & ~hidden


def parse_documents(files: DataFrame) -> DataFrame:
    """Page records of `files(path, value)`, with `reject` where a file gives none.

    Result: `(path, id, type, folder, file_path, title, last_edited, last_synced, is_root,
    parent_id, reject)`. The last line of a key wins, values are not unquoted, and lines are
    trimmed first, so an indented property named like a field counts as that field.
    """
    end = F.locate(f"\n{MARK}\n", F.concat("value", F.lit("\n")), 4)
    shaped = F.col("value").startswith(MARK + "\n") & (F.locate("\n", F.col("value"), 5) > 0)
    header = F.substr(F.col("value"), F.lit(5), F.greatest(end - 5, F.lit(0)))
    lines = F.filter(F.transform(F.split(header, "\n"), trim_space), lambda line: line.contains(":"))
    fields = F.transform(
        lines,
        lambda line: F.struct(
            trim_space(F.substring_index(line, ":", 1)).alias("key"),
            trim_space(F.substr(line, F.locate(":", line) + 1, F.length(line))).alias("value"),
        ),
    )
    parsed = files.select(
        "path",
        F.when(~shaped, "no_header").when(end == 0, "header_not_closed").alias("reject"),
        fields.alias("fields"),
        F.regexp_replace(F.substr(F.col("value"), end + 5, F.length("value")), r"(?U)^\s+", "").alias(
            "body"
        ),
    )

    def last(key: str, *, accept: str | None = None) -> Column:
        matches = F.filter(
            "fields",
            lambda f: (f["key"] == key) & (f["value"].rlike(accept) if accept else F.lit(True)),
        )
        return F.try_element_at(matches, F.lit(-1))["value"]

    first_line = trim_space(F.substring_index("body", "\n", 1))
    heading = trim_space(F.regexp_replace(first_line, "^#+", ""))
    record_id = normalize_id(last("notion_id"))
    reject = F.coalesce(
        F.col("reject"), F.when(blank_to_null(record_id).isNull(), "no_id")
    )
    return parsed.select(
        "path",
        record_id.alias("id"),
        last("notion_type").alias("type"),
        last("notion_folder").alias("folder"),
        F.coalesce(last("file_path", accept="."), F.col("path")).alias("file_path"),
        F.when(first_line.startswith("#"), heading).otherwise(stem(F.col("path"))).alias("title"),
        F.try_to_timestamp(last("last_edited", accept=_INSTANT)).alias("last_edited"),
        F.try_to_timestamp(last("last_synced", accept=_INSTANT)).alias("last_synced"),
        F.coalesce(last("is_root") == "true", F.lit(False)).alias("is_root"),
        normalize_id(last("notion_parent_id")).alias("parent_id"),
        reject.alias("reject"),
    )


RECORD = ("id", "type", "folder", "file_path", "title", "last_edited", "last_synced", "is_root", "parent_id")


def latest_records(parsed: DataFrame) -> DataFrame:
    """The record with the latest edit time per id; the first path wins a tie."""
    edited = F.coalesce(F.unix_micros("last_edited"), F.lit(-(2**62)))
    return (
        parsed.where("reject is null")
        .groupBy("id")
        .agg(F.min_by(F.struct(*RECORD), F.struct(-edited, F.col("path"))).alias("record"))
        .select("record.*")
    )


def duplicate_files(parsed: DataFrame) -> DataFrame:
    """Files to delete: `(id, path, kept_path)` for ids that several files carry.

    The path to keep is the one the winning record names, so a winner that names another path
    leaves none of its files.
    """
    accepted = parsed.where("reject is null")
    repeated = accepted.groupBy(F.col("id").alias("g_id")).agg(F.count("*").alias("n")).where("n > 1")
    keep = (
        latest_records(parsed)
        .select(F.col("id").alias("k_id"), F.col("file_path").alias("kept_path"))
        .join(repeated, F.col("k_id") == F.col("g_id"))
        .select("k_id", "kept_path")
    )
    return (
        accepted.select("id", "path")
        .join(keep, F.col("id") == F.col("k_id"))
        .where("path <> kept_path")
        .select("id", "path", "kept_path")
    )


def reindex_counters(parsed: DataFrame) -> DataFrame:
    """`(metric, value)` rows: files, rejects, unique pages, repeated ids, files to delete."""
    per_id = parsed.where("reject is null").groupBy("id").agg(F.count("*").alias("n"))
    ids = per_id.agg(
        F.count("*").alias("unique_pages"), F.count_if(F.col("n") > 1).alias("duplicate_ids")
    )
    files = parsed.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("reject").isNotNull()).alias("rejected_files")
    )
    gone = duplicate_files(parsed).agg(F.count("*").alias("files_to_delete"))
    return as_metrics(files).unionByName(as_metrics(ids)).unionByName(as_metrics(gone))


def as_metrics(row: DataFrame) -> DataFrame:
    """A one-row frame of counts as `(metric, value)` rows."""
    return row.unpivot([], row.columns, "metric", "value")
