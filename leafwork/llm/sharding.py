"""Documents to shards of nearly equal bytes by a k-d tree over metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.session import staged

LEVEL_BITS = 20  # resolution of one metadata dimension
TIE_BITS = 40  # hash of the group and number of the chunk, which order units that are equal in the dimension
CHUNK_BITS = 12
BINS = 2048  # bins of one histogram round
DIMENSIONS = ("_d_size", "_d_source", "_d_lang")


@dataclass(frozen=True)
class Split:
    """Units of `node` below `cut` on `dimension` go to `left`, all others to `right`."""

    node: int
    dimension: str
    cut: int
    left: int
    right: int


def _coordinate(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), TIE_BITS).bitwiseOR(F.col("_tie"))


def _placed(splits: list[Split]) -> Column:
    """The leaf of a unit: the tree as one expression, at most one comparison per level."""
    by_node = {s.node: s for s in splits}

    def walk(node: int) -> Column:
        s = by_node.get(node)
        if s is None:
            return F.lit(node)
        return F.when(_coordinate(s.dimension) < F.lit(s.cut), walk(s.left)).otherwise(walk(s.right))

    return walk(1)


def _category(column: str) -> Column:
    """A category as a coordinate: a hash, so its values spread over the whole range."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(""))), F.lit(1 << LEVEL_BITS))


def _units(rows: DataFrame, total: int, shards: int, grain: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their unit, and the units with weight and coordinates.

    A unit is a group of equal texts. A group of more than 1 / (shards * grain) of all bytes is cut
    into chunks of about that size by row number; there are fewer than shards * grain such groups,
    whatever the size of the table, so this small table is broadcast. Chunks of a group have its
    coordinates and follow each other, so only a group that a cut goes through lies in several shards.
    """
    limit = max(1, total // (shards * grain))
    level = F.least(F.floor(F.log2("_least") * F.lit((1 << LEVEL_BITS) / 34.0)), F.lit((1 << LEVEL_BITS) - 1))
    groups = staged(
        rows.groupBy("_key").agg(
            F.sum("size").alias("_weight"), F.min("size").alias("_least"), F.min("source").alias("source"), F.min("lang").alias("lang")
        ).select(
            "_key", "_weight", level.cast("bigint").alias("_d_size"), _category("source").alias("_d_source"),
            _category("lang").alias("_d_lang"), F.pmod(F.xxhash64("_key"), F.lit(1 << (TIE_BITS - CHUNK_BITS))).alias("_place"),
        )
    )
    large = groups.where(F.col("_weight") > limit).withColumn("_chunks", F.ceil(F.col("_weight") / F.lit(limit)))
    chunk = F.when(F.col("_chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), F.col("_chunks")))
    rows = rows.join(F.broadcast(large.select("_key", "_chunks")), "_key", "left").withColumn("_chunk", chunk)
    weights = rows.where("_chunks is not null").groupBy("_key", "_chunk").agg(F.sum("size").alias("_weight"))
    chunks = weights.join(F.broadcast(large.drop("_weight", "_chunks")), "_key")
    whole = groups.where(F.col("_weight") <= limit).withColumn("_chunk", F.lit(0).cast("bigint"))
    units = whole.unionByName(chunks)
    tie = F.shiftleft("_place", CHUNK_BITS).bitwiseOR(F.least(F.col("_chunk"), F.lit((1 << CHUNK_BITS) - 1)))
    return rows.drop("_chunks"), staged(units.withColumn("_tie", tie).drop("_place"))


def _medians(units: DataFrame, wanted: dict[int, tuple[str, float, int]], tolerance: int) -> dict[int, int]:
    """Where to cut each node so that the wanted weight lies below the cut.

    Each round adds up weights in at most BINS bins per node and goes on in the bin that holds the
    cut, for all nodes of a level at once, until that bin weighs at most `tolerance` or is one value.
    The driver receives bins, never units.
    """
    top = 1 << (LEVEL_BITS + TIE_BITS)
    ranges = {node: (0, top, 0) for node in wanted}  # from, to, weight below
    cuts: dict[int, int] = {}
    while ranges:
        position = None
        for node, (low, high, _) in ranges.items():
            here, step = F.col("_node") == node, -(-(high - low) // BINS)
            at = f"(shiftleft({wanted[node][0]}, {TIE_BITS}) | _tie)"
            held = F.expr(f"if({at} >= {low}L and {at} < {high}L, ({at} - {low}L) div {step}L, null)")
            position = F.when(here, held) if position is None else position.when(here, held)
        bins = (
            units.withColumn("_bin", position).where("_bin is not null")
            .groupBy("_node", "_bin").agg(F.sum("_weight").alias("_weight")).collect()
        )
        for node, (low, high, below) in list(ranges.items()):
            step, target = -(-(high - low) // BINS), wanted[node][1]
            reached = below
            for row in sorted((r for r in bins if r["_node"] == node), key=lambda r: r["_bin"]):
                start, end = low + row["_bin"] * step, min(high, low + (row["_bin"] + 1) * step)
                if reached + row["_weight"] < target:
                    reached += row["_weight"]
                    continue
                if row["_weight"] <= tolerance or end - start <= 1:
                    nearer = target - reached < reached + row["_weight"] - target
                    cuts[node] = start if nearer else end
                    del ranges[node]
                else:
                    ranges[node] = (start, end, reached)
                break
            else:
                cuts[node] = high
                del ranges[node]
    return cuts


def kd_splits(units: DataFrame, shards: int, tolerance: float = 1e-4) -> list[Split]:
    """The tree over `units` with one leaf per shard; a node of n leaves is cut at n//2 parts of n."""
    splits: list[Split] = []
    leaves, pending = {1: shards}, [1]
    while pending:
        placed = units.withColumn("_node", _placed(splits)).where(F.col("_node").isin(pending))
        extents = placed.groupBy("_node").agg(
            F.sum("_weight").alias("_weight"),
            *(f(d).alias(f"{n}{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))),
        )
        wanted = {}
        for row in extents.collect():
            widest = max(DIMENSIONS, key=lambda d, r=row: r[f"max{d}"] - r[f"min{d}"])
            share = (leaves[row["_node"]] // 2) / leaves[row["_node"]]
            wanted[row["_node"]] = (widest, row["_weight"] * share, row["_weight"])
        slack = int(min((w[2] for w in wanted.values()), default=0) * tolerance)
        cuts = _medians(placed, wanted, slack)
        following = []
        for node in pending:
            left, right = 2 * node, 2 * node + 1
            leaves[left] = leaves[node] // 2
            leaves[right] = leaves[node] - leaves[left]
            if node in cuts:
                splits.append(Split(node, wanted[node][0], cuts[node], left, right))
                following += [child for child in (left, right) if leaves[child] > 1]
        pending = following
    return splits


def _leaf_numbers(splits: list[Split]) -> dict[int, int]:
    inner = {s.node for s in splits}
    ends = [n for s in splits for n in (s.left, s.right) if n not in inner] or [1]
    depth = max(n.bit_length() for n in ends)
    return {n: i for i, n in enumerate(sorted(ends, key=lambda n: n << (depth - n.bit_length())))}


def _slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are range partitioned by shard and order, so a shard is spread over many tasks. A row's slot
    is its place among the shard's rows in its partition plus the shard's rows in earlier partitions;
    that table has a row per partition and shard and is joined by Spark's own choice of strategy.
    """
    placed = rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    tagged = staged(placed.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_part", shard).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    slot = (F.col("_before") + F.col("_mid") - F.col("_first")).alias("slot")
    return tagged.join(offsets, ["_part", shard]).select(*rows.columns, slot)


def shard_documents(docs: DataFrame, shards: int = 16, grain: int = 256) -> DataFrame:
    """Put every document into one of `shards` shards whose bytes are nearly equal.

    A k-d tree is grown over the size, source and language of groups of equal texts: each node is
    cut at the weighted median of its widest dimension, found by distributed histograms. Equal texts
    stay together, unless a cut goes through a group whose bytes exceed 1 / `grain` of a shard; there
    is at most one such group per cut.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null, as growing
    the tree moves rows). A null text weighs 1 byte and counts as equal to an empty one; null ids,
    sources and languages are values of their own; repeated rows are kept and numbered one by one;
    an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = staged(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("_key"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows, units = _units(rows, total, shards, grain)
    splits = kd_splits(units, shards)
    numbers = _leaf_numbers(splits)
    leaf = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))[F.col("_leaf")]
    places = units.select("_key", "_chunk", _placed(splits).alias("_leaf"))
    placed = rows.join(places, ["_key", "_chunk"]).select(
        "doc_id", "size", "text_crc32", "_key", "_row", leaf.cast("int").alias("shard")
    )
    return _slots(placed, "shard", ["_key", "_row"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
