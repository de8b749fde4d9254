"""Landed exports of the workspace: pages, databases, entries, blocks, users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions.ids import is_workspace_level, normalize_id
from leafwork.functions.properties import page_title


def read_landed(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """JSON lines or Parquet under a fixed schema: unknown fields are ignored, missing ones null."""
    return spark.read.schema(schema).format(form).load(path)


def read_pages(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return read_landed(spark, path, schemas.PAGE, form)


def read_entries(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return read_landed(spark, path, schemas.ENTRY, form)


def read_blocks(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return read_landed(spark, path, schemas.BLOCK, form)


BUCKETS = 64


def page_bucket(page: Column) -> Column:
    """Bucket of a page's blocks."""
    return F.pmod(F.xxhash64(normalize_id(page)), F.lit(BUCKETS)).cast("int")


def land_blocks(blocks: DataFrame, path: str) -> None:
    """Write blocks in folders by bucket of their page, sorted by page.

    Who needs few pages reads their buckets, and of those the row groups that can hold the pages. Rows
    are dealt by ranges that end with the block, so a page with very many blocks is several files.
    """
    order = ["bucket", "page_id", "block_id"]
    placed = blocks.withColumn("bucket", page_bucket(F.col("page_id"))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.partitionBy("bucket").parquet(path)


def read_bucketed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of `land_blocks`, with their `bucket`."""
    return spark.read.schema(schemas.BLOCK + ", bucket INT").parquet(path)


def blocks_of(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks of `pages(page_id)`; bucketed blocks are read in the buckets of these pages only."""
    keyed = blocks.withColumn("_page", normalize_id(F.col("page_id")))
    wanted = pages.select(F.col("page_id").alias("_page"))
    if "bucket" not in blocks.columns:
        return keyed.join(wanted, "_page", "left_semi").drop("_page")
    wanted = wanted.withColumn("bucket", page_bucket(F.col("_page")))
    return keyed.join(wanted, ["bucket", "_page"], "left_semi").drop("_page", "bucket")


def read_users(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return read_landed(spark, path, schemas.USERS, form)


def join_databases(containers: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Databases with their first data source, and rejects `(page_id, status, code, no_data_sources)`.

    A container without data sources is rejected for good; one whose data source was not landed
    may be tried again.
    """
    first = F.try_element_at("data_sources", F.lit(1))["id"]
    known = sources.select(
        F.col("id").alias("data_source_id"), F.col("name").alias("data_source_name")
    )
    joined = containers.withColumn("_first", first).join(
        known, F.col("_first") == F.col("data_source_id"), "left"
    )
    databases = joined.where("data_source_id is not null").drop("_first")
    rejects = joined.where("data_source_id is null").select(
        normalize_id(F.col("id")).alias("page_id"),
        F.lit(None).cast("int").alias("status"),
        F.lit(None).cast("string").alias("code"),
        F.col("_first").isNull().alias("no_data_sources"),
    )
    return databases, rejects


def search(
    objects: DataFrame, *, kind: str | None = None, query: str | None = None,
    workspace_level: bool = False,
) -> DataFrame:
    """Objects by kind (`page`, `data_source`; `database` means `data_source`), title and level.

    The title matches when it contains the query, ignoring case.
    """
    found = objects
    if kind:
        found = found.where(F.col("object") == ("data_source" if kind == "database" else kind))
    if query:
        title = F.lower(page_title(F.col("properties")))
        found = found.where(F.contains(title, F.lower(F.lit(query))))
    if workspace_level:
        found = found.where(is_workspace_level(F.col("parent")))
    return found


def scan_until(pages: DataFrame, stop: Column) -> DataFrame:
    """Pages that a newest-first scan sees before the first one for which `stop` holds.

    The place to stop is one aggregate; what is left of the scan is a range predicate on the edit
    time, which reaches the files. Pages edited at the same moment as the stopping one are left out.
    """
    place = pages.where(stop).agg(F.max("last_edited_time")).first()[0]
    return pages if place is None else pages.where(F.col("last_edited_time") > F.lit(place))


def newest_first(pages: DataFrame, limit: int) -> DataFrame:
    """The `limit` most recently edited pages (a top-k: each task keeps `limit` rows)."""
    return pages.orderBy(F.col("last_edited_time").desc(), F.col("id")).limit(limit)
