"""Global numbering, running sums and ordered text without a single-task window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.session import staged

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def _offsets(totals: DataFrame) -> DataFrame:
    """Exclusive prefix sums over one row per range partition (a few thousand rows at most)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Staged copy of `df`, range partitioned and sorted, with partition number and position."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = staged(placed.withColumn("_mid", F.monotonically_increasing_id()))
    return tagged.select(
        "*",
        F.shiftright("_mid", _LOCAL_BITS).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_pos"),
    ).drop("_mid")


def with_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, … in `order`, which has to be total (end it with a unique key).

    Rows are range partitioned on `order`, so one large group is split over many tasks; each task
    numbers its own rows and adds the number of rows in the partitions before it.
    """
    tagged = _ranged(df, order)
    totals = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    return (
        tagged.join(F.broadcast(_offsets(totals)), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )


def with_running_sum(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows strictly before each row in the total `order`."""
    tagged = _ranged(df, order)
    totals = tagged.groupBy("_part").agg(F.sum(value).alias("_n"))
    # one range partition per window group, so groups are balanced by construction
    local = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(F.broadcast(_offsets(totals)), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_pos", "_offset", "_local")
    )


# Text one task concatenates into one value; larger groups become several parts. A fragment costs its
# bytes plus ROW_COST for its place in the sort, so a part has few enough rows as well.
PART_BYTES = 8 * 1024 * 1024
ROW_COST = 2048


def cost(text: str) -> Column:
    return F.octet_length(text) + F.lit(ROW_COST)


def oversized(rows: DataFrame, keys: Sequence[str], text: str, *, limit: int = PART_BYTES) -> DataFrame | None:
    """Groups whose text costs more than `limit`, or None when there are none (the usual case).

    Every group is measured: one aggregate of bytes that tasks sum up before a number is shuffled.
    """
    costs = rows.groupBy(*keys).agg(F.sum(cost(text)).alias("_cost"))
    big = staged(costs.where(F.col("_cost") > limit).select(*keys))
    return None if big.isEmpty() else big


def in_parts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, *, limit: int = PART_BYTES
) -> DataFrame:
    """Large groups as consecutive parts `(*keys, part_no, content)` of about `limit` each.

    Parts are cut from a running sum over the global order, so no task ever holds a whole group. The
    sum and the cuts work on places and costs alone; each text is range partitioned once, and sent
    once more to its part.
    """
    keys, order = list(keys), list(order)
    measured = rows.select(*keys, *order, F.col(text).alias("_text"), cost(text).alias("_cost"))
    ranged = _ranged(measured, [F.col(c) for c in keys + order])
    slim = ranged.select(*keys, "_part", "_pos", "_cost")
    local = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("_part").agg(F.sum("_cost").alias("_n"))
    summed = staged(
        slim.withColumn("_local", F.coalesce(F.sum("_cost").over(local), F.lit(0)))
        .join(F.broadcast(_offsets(totals)), "_part")
        .select(*keys, "_part", "_pos", (F.col("_offset") + F.col("_local")).alias("_at"))
    )
    starts = summed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    # few groups are large, so their starts are a small table; AQE checks its size
    placed = staged(summed.join(starts, keys).withColumn("part_no", F.floor((F.col("_at") - F.col("_first")) / F.lit(limit))))
    # a fragment that crosses the limit ends its part, which may leave numbers out; close the gaps
    used = placed.groupBy(*keys, "part_no").agg(F.min("_at").alias("_start"))
    dense = staged(with_index(used, [*(F.col(c) for c in keys), F.col("part_no")], "_rank"))
    base = dense.groupBy(*keys).agg(F.min("_rank").alias("_base"))
    numbers = dense.join(base, keys).select(*keys, "part_no", (F.col("_rank") - F.col("_base")).alias("_number"))
    places = placed.join(numbers, [*keys, "part_no"]).select("_part", "_pos", F.col("_number").alias("part_no"))
    texts = ranged.drop("_cost").join(places, ["_part", "_pos"])
    return _joined(texts, [*keys, "part_no"], order, "_text").select(*keys, "part_no", "content")


def _joined(rows: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    fragments = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(fragments, lambda f: f["_t"]), "").alias("content")
    )


def ordered_text(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, *, limit: int = PART_BYTES
) -> DataFrame:
    """Concatenate `text` per group in `order`: `(*keys, part_no, content)`.

    Groups up to `limit` become one row with `part_no` 0, in one shuffle. Larger ones become
    consecutive parts, and nothing is left out (see `oversized` and `in_parts`).
    """
    keys, order = list(keys), list(order)
    first = F.lit(0).cast("bigint").alias("part_no")
    big = oversized(rows, keys, text, limit=limit)
    if big is None:
        return _joined(rows, keys, order, text).select(*keys, first, "content")
    small = _joined(rows.join(big, keys, "left_anti"), keys, order, text).select(*keys, first, "content")
    large = rows.join(big, keys, "left_semi")
    return small.unionByName(in_parts(large, keys, order, text, limit=limit))


def hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the contents of each key, for batches `(key, content)` in order: `(key, content_hash)`.

    One text is at hand at a time; the state goes on from part to part and from batch to batch.
    """
    at, state = None, None
    for batch in batches:
        done = []
        for key, content in zip(batch.column(0), batch.column(1), strict=True):
            key = key.as_py()
            if state is None or key != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256()
            state.update(content.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "content_hash"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([state.hexdigest()])], ["key", "content_hash"])


def text_hashes(parts: DataFrame, key: str) -> DataFrame:
    """`(key, content_hash)`: SHA-256 of a text in parts `(key, part_no, content, content_hash)`.

    The same for every way to cut the text. A text of one part has its part's hash; the parts of the
    others pass through a task in order, which keeps no more than the state of the hash.
    """
    counted = parts.groupBy(key).agg(F.count("*").alias("_parts"), F.min("content_hash").alias("content_hash"))
    whole = counted.where("_parts = 1").select(key, "content_hash")
    cut = staged(counted.where("_parts > 1").select(key))
    if cut.isEmpty():
        return whole
    in_order = parts.join(cut, key, "left_semi").select(key, "part_no", "content").repartition(key).sortWithinPartitions(key, "part_no")
    hashed = in_order.select(key, "content").mapInArrow(hash_in_order, "key string, content_hash string")
    return whole.unionByName(hashed.withColumnRenamed("key", key))
