"""The work queue as files of the service and as a table of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.operators.queueing import collapse_queue
from leafwork.session import staged
from leafwork.sources.index import path_exists, remove

# Entries of this many consecutive numbers share a partition, so acknowledging work rewrites
# little and a long queue does not become one directory per entry.
SPAN = 10_000


def read_queue_files(spark: SparkSession, path: str) -> DataFrame:
    """Queue entries from one JSON file each; the number is the file name."""
    entries = spark.read.schema(schemas.QUEUE).option("multiLine", True).json(path, pathGlobFilter="*.json")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1)
    return entries.select(number.alias("_n"), "*").where("_n <> ''").select(
        F.col("_n").cast("bigint").alias("seq"), *entries.columns
    )


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue table, one row per entry; `order by seq` is processing order."""
    schema = "seq BIGINT, " + schemas.QUEUE
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", span BIGINT").json(path).drop("span")


def _spans(entries: DataFrame) -> DataFrame:
    return entries.withColumn("span", F.floor(F.col("seq") / F.lit(SPAN)).cast("bigint"))


def append_queue(rows: DataFrame, path: str) -> None:
    """Add numbered queue rows as entries."""
    entries = collapse_queue(rows).withColumn("createdAt", F.current_timestamp())
    _spans(entries).repartitionByRange("span", "seq").write.mode("append").partitionBy("span").json(path)


def acknowledge(spark: SparkSession, path: str, remaining: DataFrame, touched: DataFrame) -> None:
    """Replace the `touched(seq)` entries by their `remaining` rows; finished entries disappear."""
    numbers = staged(touched.select("seq").distinct())
    spans = _spans(numbers).select("span").distinct()
    current = _spans(read_queue(spark, path)).join(spans, "span", "left_semi")
    kept = current.drop("span").join(numbers, "seq", "left_anti")
    updated = collapse_queue(remaining.join(numbers, "seq", "left_semi")).withColumn(
        "createdAt", F.lit(None).cast("timestamp")
    )
    result = staged(_spans(kept.unionByName(updated)))
    if not result.isEmpty():
        result.repartitionByRange("span", "seq").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("span").json(path)
    # dynamic overwrite leaves partitions alone that have no rows any more
    blank = spans.join(result.select("span").distinct(), "span", "left_anti")
    for row in blank.toLocalIterator():
        remove(spark, f"{path}/span={row['span']}")
