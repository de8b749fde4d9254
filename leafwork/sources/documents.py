"""Markdown documents, the root manifest and the sync state as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.operators.attachments import SIDECAR
from leafwork.operators.diff import document_part_path
from leafwork.operators.reindex import corpus_path
from leafwork.operators.roots import format_manifest, manifest_lines, parse_manifest
from leafwork.session import staged
from leafwork.sources.index import path_exists


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """`(path, value)` of every Markdown file below `root` that is not in a hidden directory."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(
        root, wholetext=True
    )
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    full = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substring_index(full, base, -1)
    return files.select(path.alias("path"), "value").where(corpus_path(F.col("path")))


def write_documents(documents: DataFrame, root: str) -> None:
    """Write each document (part) to its own file below `root`, from the executors.

    `root` is a URI or absolute path of a store that every executor reaches; a machine's own disk
    is none on a cluster. A file appears whole, by a rename, under a temporary name that no other
    attempt uses, so a task that runs twice does no damage.
    """
    path = document_part_path(F.col("file_path"), F.col("part_no"))
    _write_files(documents.select(path.alias("path"), "content"), root)


def _write_files(files: DataFrame, root: str) -> None:
    """Write `files(path, content)` below `root`, each whole by a rename."""

    def write(rows) -> None:
        store, base = _store(root)
        known = set()
        for row in rows:
            target = f"{base}/{row['path']}"
            folder = target.rpartition("/")[0]
            if folder not in known:
                store.create_dir(folder, recursive=True)
                known.add(folder)
            temporary = f"{target}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temporary) as out:
                out.write(row["content"].encode("utf-8"))
            store.move(temporary, target)

    files.foreachPartition(write)


def read_root_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the root manifest file; none when the file does not exist."""
    if not path_exists(spark, path):
        return parse_manifest(spark.createDataFrame([], "line_no INT, line STRING"))
    return parse_manifest(manifest_lines(spark.read.text(path, wholetext=True)))


def _same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_side").alias("_rest")).where("_rest <> 0").isEmpty()


def _store(root: str):
    """A path as `pyarrow.fs` opens it; used in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + root[len("file:"):].lstrip("/") if root.startswith("file:") else root)


def write_root_manifest(entries: DataFrame, path: str) -> bool:
    """Write the manifest file if it differs from what is there; returns whether it was written.

    The lines are sorted by Spark and pass one by one through the task that writes the file, which
    appears whole by a rename. The list is as long as there are anchored pages.
    """
    spark = entries.sparkSession
    lines = staged(format_manifest(entries))
    if path_exists(spark, path):
        stored = manifest_lines(spark.read.text(path, wholetext=True)).select(F.col("line_no").cast("bigint").alias("line_no"), F.col("line").alias("text"))
        end = lines.agg((F.max("line_no") + 1).alias("line_no")).withColumn("text", F.lit(""))  # the text after the last line feed
        if _same_rows(stored, lines.unionByName(end)):
            return False

    def write(rows) -> None:
        store, target = _store(path)
        temporary = f"{target}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(temporary) as out:
            for row in rows:
                out.write(row["text"].encode("utf-8") + b"\n")
        store.move(temporary, target)

    lines.repartition(1).sortWithinPartitions("line_no").foreachPartition(write)
    return True


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """The descriptions of stored files below `root`: `(path, file_id, parent_page_id, downloaded_at)`."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "path STRING, " + schemas.FILE_MANIFEST)
    files = spark.read.schema(schemas.FILE_MANIFEST).option("recursiveFileLookup", True).json(root, pathGlobFilter=f"*{SIDECAR}")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    full = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(full, base, -1).alias("path"), *files.columns)


def write_sidecars(manifests: DataFrame, root: str) -> int:
    """Write one description per stored file below `root`, those that differ only; returns their number.

    What is new is found by comparing tables, so an unchanged file is not touched.
    """
    spark = manifests.sparkSession
    wanted = manifests.select("path", "file_id", "parent_page_id", "downloaded_at").distinct()
    there = read_sidecars(spark, root).select(*(F.col(c).alias(f"t_{c}") for c in wanted.columns))
    same = F.col("path") == F.col("t_path")
    for name in ("file_id", "parent_page_id", "downloaded_at"):
        same = same & F.col(name).eqNullSafe(F.col(f"t_{name}"))
    body = F.concat(F.to_json(F.struct("file_id", "parent_page_id", "downloaded_at"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}), F.lit("\n"))
    fresh = staged(wanted.join(there, same, "left_anti").select("path", body.alias("content")))
    _write_files(fresh, root)
    return fresh.count()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The sync state row; a fresh one when there is none yet."""
    if path_exists(spark, path):
        return spark.read.schema(schemas.SYNC_STATE).json(path)
    return spark.createDataFrame([(schemas.STATE_VERSION, [], None, None)], schemas.SYNC_STATE)


def write_state(state: DataFrame, path: str) -> None:
    """Replace the state row. The row is materialised first: it may come from the same file."""
    rows = state.limit(1).collect()
    state.sparkSession.createDataFrame(rows, schemas.SYNC_STATE).coalesce(1).write.mode("overwrite").json(path)
