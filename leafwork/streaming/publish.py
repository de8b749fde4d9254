"""Periodic commits: what was rendered since the last commit, as one change set with a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators.diff import diff_documents, document_part_path
from leafwork.session import drop_staged, staged, staged_so_far
from leafwork.sources.index import _filesystem, path_exists, remove

DOCUMENT = "page_id STRING, file_path STRING, part_no BIGINT, content STRING, content_hash STRING"
CHANGE = "page_id STRING, path STRING, content_hash STRING, change STRING"
MARKER = "_SUCCESS"


def commit_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that were finished."""
    if not path_exists(spark, path):
        return []
    system, target = _filesystem(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(target)]
    numbers = [int(name.removeprefix("commit=")) for name in names if name.startswith("commit=")]
    return sorted(n for n in numbers if path_exists(spark, f"{path}/commit={n}/{MARKER}"))


def read_commits(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All changes with their commit: `(commit, page_id, path, content_hash, change)`."""
    numbers = [n for n in commit_numbers(spark, path) if upto is None or n <= upto]
    if not numbers:
        return spark.createDataFrame([], f"commit INT, {CHANGE}")
    folders = [f"{path}/commit={n}" for n in numbers]
    return spark.read.schema(f"{CHANGE}, commit INT").option("basePath", path).parquet(*folders).select("commit", "page_id", "path", "content_hash", "change")


def published(commits: DataFrame) -> DataFrame:
    """The documents as of the last of `commits`: `(page_id, path, content_hash)`.

    The last change of a path says whether it is there.
    """
    last = commits.groupBy("path").agg(F.max_by(F.struct("page_id", "content_hash", "change"), "commit").alias("row"))
    return last.where("row.change <> 'deleted'").select("row.page_id", "path", "row.content_hash")


def commit_documents(documents: DataFrame, path: str, number: int) -> int:
    """Commit rendered `documents` as change set `number`; returns how many paths changed.

    `documents(page_id, file_path, part_no, content_hash, version)` may hold a page several times;
    the rows of its greatest version count. Only the pages in it are compared with what is published,
    so a document that is as it was adds nothing, and the old path of a page that moved is deleted.
    Nothing changed means no commit, and a commit that is there already is left alone.
    """
    spark = documents.sparkSession
    if number in commit_numbers(spark, path):
        return 0
    mark = staged_so_far()
    newest = documents.groupBy("page_id").agg(F.max("version").alias("version"))
    rendered = staged(
        documents.join(newest, ["page_id", "version"], "left_semi")
        .select("page_id", document_part_path(F.col("file_path"), F.col("part_no")).alias("path"), "content_hash").distinct()
    )
    touched = newest.select("page_id")
    before = staged(published(read_commits(spark, path, number - 1)).join(touched, "page_id", "left_semi"))
    owners = rendered.select("path", "page_id", "content_hash").unionByName(
        before.join(rendered.select("path"), "path", "left_anti").select("path", "page_id", F.lit(None).cast("string").alias("content_hash"))
    )
    changes = diff_documents(before, rendered).where("change <> 'unchanged'").select("path", "change")
    result = staged(changes.join(owners, "path").select("page_id", "path", "content_hash", "change"))
    count = result.count()
    if count:
        remove(spark, f"{path}/commit={number}")
        result.write.mode("overwrite").parquet(f"{path}/commit={number}")
    drop_staged(spark, mark)
    return count


def publish(spark: SparkSession, documents_path: str, commits_path: str, *, checkpoint: str, period: str | None = None):
    """Commit what the sync rendered, once per `period` ("30 seconds"), or what is there and stop.

    `documents_path` holds documents in `batch=<n>` folders as `streaming.incremental` writes them. The
    trigger gathers what arrived since the last commit; the number of a commit is that of the trigger,
    so a trigger that is repeated after a failure makes no second one.
    """
    stream = spark.readStream.schema(f"{DOCUMENT}, batch INT").parquet(documents_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        commit_documents(batch.withColumn("version", F.col("batch")), commits_path, batch_id + 1)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()
