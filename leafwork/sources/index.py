"""The sharded record index and the legacy one-file-per-record layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import __version__, schemas
from leafwork.functions.ids import shard_key
from leafwork.operators.registry import index_lines, overlay
from leafwork.session import staged


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = _filesystem(spark, path)
    system.delete(target, True)


def read_index(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """Page records of the index; `shards` prunes to those partitions."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.REGISTRY)
    index = spark.read.schema(schemas.REGISTRY + ", shard STRING").json(path)
    if shards is not None:
        index = index.where(F.col("shard").isin(shards))
    return index.drop("shard")


def point_lookup(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """Records of a few ids, reading only the shards that can hold them."""
    wanted = spark.createDataFrame([(i,) for i in ids], "id STRING")
    shards = [r[0] for r in wanted.select(shard_key(F.col("id"))).distinct().collect()]
    return read_index(spark, path, shards).join(wanted, "id", "left_semi")


def _like(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The columns of the index; those a job does not produce (`children`, see `write_children`) are null."""
    return rows.select(*(
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields
    ))


def read_children(spark: SparkSession, path: str) -> DataFrame:
    """Child edges `(parent_id, position, child_id)` as `write_children` keeps them."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.CHILDREN)
    return spark.read.schema(schemas.CHILDREN + ", shard STRING").parquet(path).drop("shard")


def write_children(edges: DataFrame, parents: DataFrame, path: str) -> list[str]:
    """Replace the child edges of `parents(id)`, rewriting only the shards they touch.

    Child lists are rows and not arrays in the parent's record, as one parent may have very many.
    """
    spark = edges.sparkSession
    touched = parents.select(F.col("id").alias("parent_id")).distinct()
    shards = sorted(r[0] for r in touched.select(shard_key(F.col("parent_id"))).distinct().collect())  # at most 256
    if not shards:
        return []
    stored = read_children(spark, path).where(shard_key(F.col("parent_id")).isin(shards))
    kept = stored.join(touched, "parent_id", "left_anti")
    fresh = edges.select("parent_id", F.col("position").cast("bigint").alias("position"), "child_id")
    rows = staged(kept.unionByName(fresh).withColumn("shard", shard_key(F.col("parent_id"))))
    (
        rows.repartitionByRange("shard", "parent_id", "position")
        .sortWithinPartitions("shard", "parent_id", "position")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    )
    filled = {row["shard"] for row in rows.select("shard").distinct().collect()}
    for shard in set(shards) - filled:
        remove(spark, f"{path}/shard={shard}")
    return shards


def write_index(pending: DataFrame, deleted: DataFrame, path: str) -> list[str]:
    """Apply changes to the index, rewriting only the shards they touch; returns those shards.

    Every file holds a range of ids in order, so a large shard is several sorted files and no
    task writes a whole one. Shards that end up empty are removed.
    """
    spark = pending.sparkSession
    touched = (
        pending.select("id").unionByName(deleted.select("id"))
        .select(shard_key(F.col("id")).alias("shard")).distinct()
    )
    shards = sorted(row["shard"] for row in touched.collect())  # at most 256
    if not shards:
        return []
    stored = read_index(spark, path, shards)
    lines = staged(index_lines(overlay(stored, _like(pending, stored), deleted)))
    (
        lines.repartitionByRange("shard", "id")
        .sortWithinPartitions("shard", "id")
        .select("shard", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .text(path)
    )
    filled = {row["shard"] for row in lines.select("shard").distinct().collect()}
    for shard in set(shards) - filled:
        remove(spark, f"{path}/shard={shard}")
    return shards


def write_manifest(spark: SparkSession, path: str) -> bool:
    """Version record of the index, written only when it differs; returns whether it was written."""
    wanted = spark.createDataFrame(
        [(__version__, schemas.INDEX_SCHEMA_VERSION)], "tool_version STRING, schema_version INT"
    )
    if path_exists(spark, path):
        current = spark.read.schema(wanted.schema).json(path)
        if current.exceptAll(wanted).isEmpty() and not current.isEmpty():
            return False
    wanted.coalesce(1).write.mode("overwrite").json(path)
    return True


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Records of the one-file-per-record layout, with their `file_name`.

    One schema covers pages, files and users; each kind fills its own fields.
    """
    schema = schemas.REGISTRY + ", source_url STRING, name STRING, email STRING, last_fetched TIMESTAMP"
    records = spark.read.schema(schema).option("multiLine", True).json(path, pathGlobFilter="*.json")
    name = F.col("_metadata.file_name")
    return records.select(name.alias("file_name"), "*").where(F.col("file_name") != "manifest.json")
