"""Attachments: which links are hosted files, where each file goes, which are too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.paths import (
    MAX_ATTACHMENT_BYTES, attachment_name, child_directory, directory, hosted_file_id, joined_path,
    relative_to, suffixed, without_query,
)
from leafwork.operators.paths import SHORT_ID, with_suffixes
from leafwork.operators.skew import HOT_FLOOR, lookup


SIDECAR = ".meta.json"  # fixed value: ending of the file that describes a stored file


def attachment_links(links: DataFrame) -> DataFrame:
    """`links(page_id, page_path, position, url)` with `file_id` (null for other URLs)."""
    return links.withColumn("file_id", hosted_file_id(F.col("url")))


def place_files(
    links: DataFrame, files: DataFrame, manifests: DataFrame, *, floor: int = HOT_FLOOR
) -> DataFrame:
    """Local path of each hosted file: `(file_id, file_path, is_new, page_id, source_url)`.

    A registered file keeps its path. A new one goes below the first page that links it; when its
    name is taken by another file it gets a suffix, long enough to be alone. `files(id, file_path)`
    are the registered ones, `manifests(path, file_id)` the sidecars of files already stored; both
    occupy their paths. Each file shrinks to one row before names are compared, so a file linked
    from very many pages costs no more.
    """
    wanted = links.where(F.col("file_id").isNotNull())
    firsts = wanted.groupBy("file_id").agg(
        F.min_by(F.struct("page_id", "page_path", "url"), F.struct("page_path", "position", "url")).alias("at")
    )
    known = files.select(F.col("id").alias("r_id"), F.col("file_path").alias("r_path"))
    base = firsts.join(known, F.col("file_id") == F.col("r_id"), "left").select(
        "file_id",
        "r_path",
        F.col("at.page_id").alias("page_id"),
        without_query(F.col("at.url")).alias("source_url"),
        F.concat(child_directory(F.col("at.page_path")), F.lit("/files")).alias("dir"),
        attachment_name(F.col("at.url")).alias("name"),
    )
    fresh = base.where("r_path is null")
    stored = _stored_paths(manifests)
    registered = files.select(F.col("file_path").alias("path"), F.col("id").alias("file_id"), F.lit(0).alias("rank"))
    holder = registered.unionByName(stored.withColumn("rank", F.lit(1))).groupBy(F.col("path").alias("m_path")).agg(
        F.min_by("file_id", F.struct("rank", "file_id")).alias("m_file")
    )
    best = fresh.groupBy("dir", "name").agg(F.min("file_id").alias("best"))
    held = best.join(holder, F.concat("dir", F.lit("/"), "name") == F.col("m_path"), "left")
    # an occupied name belongs to the file stored there, a free one to the smallest id
    owners = held.select(F.coalesce("m_file", "best").alias("o_file"), F.col("dir").alias("o_dir"),
                         F.col("name").alias("o_name"))
    placed = fresh.join(
        owners,
        (F.col("file_id") == F.col("o_file")) & (F.col("dir") == F.col("o_dir")) & (F.col("name") == F.col("o_name")),
        "left",
    )
    taken = holder.select(
        directory(F.col("m_path")).alias("dir"), F.substring_index("m_path", "/", -1).alias("taken_name"),
        F.col("m_file").alias("taken_by"),
    )
    named = with_suffixes(
        placed.select("file_id", "dir", "name", "page_id", "source_url", F.col("o_file").isNotNull().alias("plain")),
        "file_id", lambda suffix: suffixed(F.col("name"), suffix), taken, SHORT_ID,
    )
    name = F.when(F.col("plain"), F.col("name")).otherwise(F.col("suffixed"))
    fresh_paths = named.select(
        "file_id", joined_path(F.col("dir"), name).alias("file_path"), "page_id", "source_url"
    )
    # one file may have several sidecars, so they are matched on both columns and once
    kept = stored.select(F.col("path").alias("s_path"), F.col("file_id").alias("s_file")).distinct()
    fresh_paths = fresh_paths.join(
        kept, (F.col("file_path") == F.col("s_path")) & (F.col("file_id") == F.col("s_file")), "left"
    ).select("file_id", "file_path", F.col("s_file").isNull().alias("is_new"), "page_id", "source_url")
    reused = base.where("r_path is not null").select(
        "file_id", F.col("r_path").alias("file_path"), F.lit(False).alias("is_new"), "page_id", "source_url"
    )
    return reused.unionByName(fresh_paths)


def _stored_paths(manifests: DataFrame) -> DataFrame:
    """Path of the stored file each sidecar `(path, file_id)` belongs to."""
    ending = SIDECAR.replace(".", r"\.") + "$"
    return manifests.select(F.regexp_replace("path", ending, "").alias("path"), "file_id")


def with_sizes(placed: DataFrame, sizes: DataFrame, *, limit: int = MAX_ATTACHMENT_BYTES) -> DataFrame:
    """Add `too_large`: new files over the limit are not stored and keep their remote URL."""
    known = sizes.select(F.col("file_id").alias("z_id"), "size")
    return placed.join(known, F.col("file_id") == F.col("z_id"), "left").drop("z_id").withColumn(
        "too_large", F.col("is_new") & F.coalesce(F.col("size") > limit, F.lit(False))
    )


def resolve_links(links: DataFrame, placed: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """What each link shows: the path relative to its page, or the URL itself.

    One file may be behind a large share of all links, so hot files are joined without a shuffle.
    """
    targets = placed.where(~F.col("too_large")).select(
        F.col("file_id").alias("t_id"), F.col("file_path").alias("t_path")
    )
    local = relative_to(F.col("t_path"), directory(F.col("page_path")))
    return lookup(links, targets, "file_id", "t_id", floor=floor).select(
        "page_id", "position", "url", "file_id", F.coalesce(local, F.col("url")).alias("shown")
    )


def size_profile(files: DataFrame, *, limit: int = MAX_ATTACHMENT_BYTES) -> DataFrame:
    """Number and bytes of files over and under the limit, from `files(file_id, size)`."""
    return files.groupBy((F.col("size") > limit).alias("over_limit")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def file_records(placed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Registry rows and sidecar manifests for files that are stored for the first time."""
    stored = placed.where(F.col("is_new") & ~F.col("too_large"))
    registry = stored.select(
        F.col("file_id").alias("id"), "file_path", "source_url", now.alias("last_synced")
    )
    manifests = stored.select(
        F.concat("file_path", F.lit(SIDECAR)).alias("path"),
        "file_id",
        F.col("page_id").alias("parent_page_id"),
        now.alias("downloaded_at"),
    )
    return registry, manifests
