"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.session import staged

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE
# hot keys however large the table is. That count bounds everything this module broadcasts.
HOT_SHARE = 1000
# Keys below this many rows are never worth treating apart.
HOT_FLOOR = 500_000
# Hashes that rows are counted by before keys are: so many that few buckets are hot without a hot key.
BUCKETS = 65_536
# Below this no counting pass is made. A hot key in few compressed bytes is then left to the skew
# join, which `session.prepare` always turns on and which splits partitions by their real size.
SMALL_BYTES = 64 * 1024 * 1024


def _source_bytes(df: DataFrame) -> int:
    """Size of the tables `df` reads, after the optimizer pruned columns and partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def hot_keys(df: DataFrame, key: str, *, floor: int = HOT_FLOOR) -> DataFrame | None:
    """The (at most HOT_SHARE) values of `key` that hold a hot share of `df`, or None.

    Rows are counted by BUCKETS hashes of the key first, which a task sums up to few rows whatever the
    number of keys. Only the keys of buckets that hold a hot share, as that of a hot key must, are
    counted one by one. Two sums and the numbers of such buckets (fewer than HOT_SHARE) reach the driver.
    """
    known = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_hot_key"))
    bucket = F.pmod(F.xxhash64("_hot_key"), F.lit(BUCKETS))
    sums = known.groupBy(bucket.alias("_bucket")).count()
    total, largest = sums.agg(F.sum("count"), F.max("count")).first()
    threshold = max(floor, (total or 0) // HOT_SHARE + 1)
    if largest is None or largest < threshold:
        return None
    buckets = [row["_bucket"] for row in sums.where(F.col("count") >= threshold).collect()]
    inside = known.where(bucket.isin(buckets))
    counts = inside.groupBy("_hot_key").count()
    hot = staged(counts.where(F.col("count") >= threshold).select("_hot_key"))
    return None if hot.isEmpty() else hot


def _spread_nulls(left: DataFrame, key: str) -> DataFrame:
    """`_spread`: the key, or a value that matches nothing and differs from row to row."""
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    other = F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string")).cast(left.schema[key].dataType)
    return left.withColumn("_spread", F.coalesce(F.col(key), other))


def lookup(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    *,
    how: str = "left",
    rows: int | None = None,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Join `left` to `right`, which holds at most one row per `right_key`.

    Rows of `left` under a hot key skip the shuffle: the matching rows of `right` (one per hot
    key, so fewer than HOT_SHARE) are broadcast to them. Rows with a null key match nothing and
    skip the shuffle too, or are spread over all tasks. All other rows take an ordinary shuffled
    join. For inputs that are small by `rows` or by the size of their source tables the counting pass
    is left out, and the skew join splits a hot key's partition when it meets one.
    """
    condition = F.col(left_key) == F.col(right_key)
    if rows is None:
        small = floor == HOT_FLOOR and _source_bytes(left) < SMALL_BYTES
    else:
        small = rows < floor
    if small:
        return left.join(right, condition, how)
    hot = hot_keys(left, left_key, floor=floor)
    if hot is None and how == "inner":  # the result is still dealt by the key
        return left.join(right, condition, how)
    if hot is None:
        return _spread_nulls(left, left_key).join(
            right, F.col("_spread") == F.col(right_key), how
        ).drop("_spread")
    marked = left.join(
        F.broadcast(hot.withColumn("_hot", F.lit(True))), F.col(left_key) == F.col("_hot_key"), "left"
    ).drop("_hot_key")
    spread = F.col("_hot").isNull() & F.col(left_key).isNotNull()
    few = right.join(F.broadcast(hot), F.col(right_key) == F.col("_hot_key"), "left_semi")
    cold = marked.where(spread).drop("_hot").join(right, condition, how)
    warm = marked.where(~spread).drop("_hot").join(F.broadcast(few), condition, how)
    return cold.unionByName(warm)


def _broadcastable(table: DataFrame) -> bool:
    """Whether Spark holds the table small enough to send it to every task by itself."""
    limit = table._jdf.queryExecution().sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def lookup_slots(
    rows: DataFrame, table: DataFrame, slots: dict[str, Column], table_key: str, value: str, *, row_id: str, floor: int = HOT_FLOOR
) -> DataFrame:
    """Add a column per slot: the `value` of the row of `table` that its key finds, or null.

    `slots` maps new columns to the keys they look up; `table` has at most one row per key and `row_id`
    is unique. A table that Spark broadcasts is joined once per slot without a shuffle. Otherwise the
    keys of all slots become rows of their own, `(row, slot, key)`, which are counted once and joined
    once (see `lookup`), and what was found is gathered by row; so the wide rows are moved once, and a
    key that is hot in any slot is joined apart.
    """
    found = table.select(F.col(table_key).alias("_t_key"), F.col(value).alias("_t_value"))
    if _broadcastable(found):
        for name, key in slots.items():
            one = found.select(F.col("_t_key").alias(f"_{name}_key"), F.col("_t_value").alias(name))
            rows = rows.join(one, key == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")
        return rows
    asked = rows.select(
        F.col(row_id).alias("_row"),
        F.inline(F.array(*(F.struct(F.lit(i).alias("_slot"), key.alias("_key")) for i, key in enumerate(slots.values())))),
    ).where("_key is not null")
    answered = lookup(asked, found, "_key", "_t_key", how="inner", floor=floor)
    gathered = answered.groupBy("_row").agg(
        *(F.first(F.when(F.col("_slot") == i, F.col("_t_value")), ignorenulls=True).alias(name) for i, name in enumerate(slots))
    )
    return rows.join(gathered, F.col(row_id) == F.col("_row"), "left").drop("_row")
