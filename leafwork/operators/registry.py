"""The record index: overlays, legacy layouts, compaction, canonical records, shard sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, normalize_id, shard_key
from leafwork.functions.paths import without_query

BARE_ID = r"^[0-9a-f]{32}\.json$"  # fixed value: oldest file name form


def overlay(stored: DataFrame, pending: DataFrame, deleted: DataFrame) -> DataFrame:
    """`stored` with `pending` rows in place of theirs and without `deleted(id)`.

    A row that is both pending and deleted is deleted. All inputs hold one row per id.
    """
    changed = pending.select("id").unionByName(deleted.select("id"))
    kept = stored.join(changed, "id", "left_anti")
    written = pending.join(deleted.select("id"), "id", "left_anti")
    return kept.unionByName(written.select(*stored.columns))


def legacy_kind(name: Column) -> Column:
    """Record kind of a legacy file name; null for other files."""
    return (
        F.when(name.startswith("page-") | name.rlike(BARE_ID), "page")
        .when(name.startswith("file-"), "file")
        .when(name.startswith("user-"), "user")
    )


def legacy_rank(name: Column) -> Column:
    """Precedence among files for one page: bare id < dashed id < normalised id."""
    width = F.length(F.regexp_replace(name, r"^page-|\.json$", ""))
    return (
        F.when(name.rlike(BARE_ID), 0)
        .when(name.startswith("page-"), F.when(width != 32, 1).otherwise(2))
        .otherwise(3)
    )


def listed_registry(sharded: DataFrame, legacy: DataFrame, deleted: DataFrame) -> DataFrame:
    """All page records: the index first, then `page-` files for ids it neither holds nor deleted.

    `legacy(file_name, <record columns>)`. Among several files of one id the first name counts.
    """
    served = sharded.select("id").unionByName(deleted.select("id"))
    records = F.struct(*[F.col(c) for c in sharded.columns])
    extra = (
        legacy.where(F.col("file_name").startswith("page-") & blank_to_null(F.col("id")).isNotNull())
        .withColumn("id", normalize_id(F.col("id")))
        .join(served.distinct(), "id", "left_anti")
        .groupBy("id")
        .agg(F.min_by(records, "file_name").alias("record"))
        .select("record.*")
    )
    return sharded.unionByName(extra)


def absorbed(legacy: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The winning legacy record of each id of one kind, cleaned for the index.

    Highest rank wins, then the last file name. Records without an id are unreadable and skipped.
    """
    record = F.struct(*[F.col(c) for c in columns])
    rows = legacy.where((legacy_kind(F.col("file_name")) == kind) & blank_to_null(F.col("id")).isNotNull())
    if kind == "page":
        rows = rows.withColumn("id", normalize_id(F.col("id"))).withColumn(
            "parent_id", normalize_id(F.col("parent_id"))
        )
    if kind == "file":
        rows = rows.withColumn("source_url", without_query(F.col("source_url")))
    order = F.struct(legacy_rank(F.col("file_name")), F.col("file_name"))
    return rows.groupBy("id").agg(F.max_by(record, order).alias("record")).select("record.*")


def compact(stored: DataFrame, legacy: DataFrame, kind: str) -> DataFrame:
    """The index after absorbing legacy files: an absorbed record replaces the stored one."""
    pending = absorbed(legacy, kind, stored.columns)
    return stored.join(pending, "id", "left_anti").unionByName(pending)


def compaction_counters(legacy: DataFrame) -> DataFrame:
    """Legacy files absorbed per kind."""
    kind = legacy_kind(F.col("file_name"))
    return (
        legacy.where(kind.isNotNull() & blank_to_null(F.col("id")).isNotNull())
        .groupBy(kind.alias("kind"))
        .agg(F.count("*").alias("files"), F.countDistinct(normalize_id(F.col("id"))).alias("records"))
    )


def _instant(value: Column) -> Column:
    """RFC 3339 with only as many fraction digits as needed."""
    fraction = F.rtrim(F.date_format(value, "SSSSSS"), F.lit("0"))
    text = F.concat(
        F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit("Z"),
    )
    return F.coalesce(text, F.lit("0001-01-01T00:00:00Z"))


def _escaped(json: Column) -> Column:
    """Escape the characters that the index keeps out of its text."""
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        json = F.replace(json, F.lit(char), F.lit("\\u" + code))
    # control characters: lower-case digits
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        json = F.replace(json, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return json


def page_record_json(columns: list[str]) -> Column:
    """Canonical JSON of a page record: compact, keys sorted, empty optional fields left out."""
    text = {name: F.coalesce(name, F.lit("")) for name in ("file_path", "folder", "id", "title", "type")}
    fields = {
        "children": F.when(F.size("children") > 0, F.col("children")) if "children" in columns
        else F.lit(None).cast("array<string>"),
        "content_hash": blank_to_null(F.col("content_hash")) if "content_hash" in columns
        else F.lit(None).cast("string"),
        "enabled": F.when(F.col("enabled"), F.lit(True)),
        "is_root": F.coalesce("is_root", F.lit(False)),
        "last_edited": _instant(F.col("last_edited")),
        "last_synced": _instant(F.col("last_synced")),
        "parent_id": blank_to_null(F.col("parent_id")),
        **text,
    }
    return _escaped(F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)])))


def record_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON of any other record; null fields are left out."""
    return _escaped(F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)])))


def index_lines(records: DataFrame) -> DataFrame:
    """Index rows `(shard, id, line)` of page records."""
    return records.select(
        shard_key(F.col("id")).alias("shard"), "id", page_record_json(records.columns).alias("line")
    )


def shard_occupancy(records: DataFrame) -> DataFrame:
    """Records and bytes per shard."""
    lines = index_lines(records)
    return lines.groupBy("shard").agg(
        F.count("*").alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes")
    )
