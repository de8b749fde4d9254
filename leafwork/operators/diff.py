"""Changes between two published document sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


QUEUE_PREFIX = ".notion-sync/queue"  # fixed value: queue files live on a branch of their own


def is_queue_path(path: Column) -> Column:
    return (path == QUEUE_PREFIX) | path.startswith(QUEUE_PREFIX + "/")


def diff_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """`(path, change, is_queue)` with change new, modified, deleted or unchanged.

    Both inputs are `(path, content_hash)`; document bodies never enter the join.
    """
    before = old.select("path", F.col("content_hash").alias("old_hash"))
    after = new.select("path", F.col("content_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("modified")
    )
    return before.join(after, "path", "full_outer").select(
        "path", change.alias("change"), is_queue_path(F.col("path")).alias("is_queue")
    )


def document_part_path(path: Column, part_no: Column) -> Column:
    """Export path of a document part; the first part has the path of the document itself."""
    return F.when(part_no == 0, path).otherwise(
        F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit(".part"), part_no, F.lit(".md"))
    )
