"""Stable, conflict-free file paths for pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, packed, unpacked
from leafwork.functions.paths import child_directory, directory, joined_path, stem
from leafwork.functions.text import slug
from leafwork.operators.hierarchy import CYCLE, FOUND, resolve_pointers
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

SHORT_ID = 4  # fixed value: characters of the id added to a name that is taken


def _settled(rows: DataFrame, occupied: DataFrame) -> DataFrame:
    """`(id, name)` for `rows(id, home, slug, priority)`: names that differ within each home. Ids are packed.

    The best-placed row (lowest priority, then id) of a home and name keeps the plain name unless
    `occupied(home, name)` has it; all others get a suffix that is alone (see `with_suffixes`).
    Candidates shrink to one per name before anything is shuffled on the name, and the verdict
    returns through the unique page id. All levels of a tree are settled at once, as the children of
    one page have a home of their own.
    """
    best = rows.groupBy("home", F.lower("slug").alias("name")).agg(
        F.min(F.struct("priority", unpacked(F.col("id")).alias("id"))).alias("best")
    )
    best = best.select("home", "name", packed(F.col("best.id")).alias("w_id"))
    winners = staged(best.join(occupied, ["home", "name"], "left_anti"))
    judged = rows.join(winners.select("w_id"), F.col("id") == F.col("w_id"), "left")
    held = occupied.unionByName(winners.select("home", "name")).select(
        F.col("home").alias("dir"), F.col("name").alias("taken_name"), F.lit(None).cast("binary").alias("taken_by")
    )
    judged = with_suffixes(
        judged.select("id", F.col("home").alias("dir"), "slug", F.col("w_id").isNotNull().alias("plain")), "id",
        lambda suffix: F.concat("slug", F.lit("-"), suffix), held, SHORT_ID, text=unpacked(F.col("id")),
    )
    return judged.select("id", F.when(F.col("plain"), F.col("slug")).otherwise(F.col("suffixed")).alias("name"))


def with_suffixes(
    rows: DataFrame, key: str, name: Callable[[Column], Column], occupied: DataFrame, short: int, *, text: Column | None = None
) -> DataFrame:
    """Add `suffixed`: the name of each row of `rows(key, dir, plain, …)` with the start of its id.

    `short` characters are used where that name is free: no other row that needs a suffix has it,
    and nothing but the row itself holds it in `occupied(dir, taken_name, taken_by)`. Otherwise the
    whole id is used, which no other row has. Rows with `plain` keep their name and take no part.
    `text` is the id as it is written where the key is packed.
    """
    text = F.col(key) if text is None else text
    brief, whole = name(F.substring(text, 1, short)), name(text)
    asked = rows.where("not plain").select(F.col(key).alias("b_id"), "dir", F.lower(brief).alias("brief"))
    counted = asked.groupBy("dir", "brief").agg(F.count("*").alias("n"), F.min("b_id").alias("b_id"))
    lone = counted.where("n = 1").drop("n")
    # a name may be held several times, which only repeats what is made distinct below
    held = occupied.select("dir", F.lower("taken_name").alias("brief"), "taken_by")
    blocked = held.withColumnRenamed("taken_by", "t_by").withColumn("t_held", F.lit(True))
    free = lone.join(blocked, ["dir", "brief"], "left").where(
        F.col("t_held").isNull() | F.col("t_by").eqNullSafe(F.col("b_id"))
    ).select("b_id").distinct()
    marked = rows.join(free.withColumn("b_free", F.lit(True)), F.col(key) == F.col("b_id"), "left").drop("b_id")
    return marked.withColumn("suffixed", F.when(F.col("b_free"), brief).otherwise(whole)).drop("b_free")


def _keys(paths: DataFrame) -> DataFrame:
    """Directory and name of each path as `(home, name)`; `/` marks homes that are directories."""
    return paths.select(_in_directory(directory(F.col("file_path"))).alias("home"), F.lower(stem(F.col("file_path"))).alias("name"))


def _in_directory(path: Column) -> Column:
    return F.concat(F.lit("/"), F.coalesce(path, F.lit("")))


def assign_paths(new: DataFrame, registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """`(id, file_path)` for every row of `new(id, parent_id, title, folder, is_root, priority)`.

    A page that has a path in `registry` keeps it for ever. A new page goes to its folder when it is a
    root or its parent is unknown, and otherwise below the path of its parent. Names of all levels are
    settled in one aggregate, as pages below a new parent can only meet each other; the names on the
    way down are then joined by pointer doubling, so a tree of depth d takes log2(d) rounds. Pages on
    or below a cycle of parents go to their folder, after all others.

    Directories of different parents can only meet where kept pages already lie below a new path, or
    pages lie outside any folder. Then the page of the upper level keeps the name, the name counts as
    occupied for the others, and all is settled again, the uppermost level of such pages at a time,
    until no path is held twice.
    """
    kept = staged(
        registry.where(blank_to_null(F.col("file_path")).isNotNull()).select(packed(F.col("id")).alias("id"), "file_path")
    )
    asked = new.select(  # ids are packed up to the result
        packed(F.col("id")).alias("id"),
        packed(F.when(~F.col("is_root"), blank_to_null(F.col("parent_id")))).alias("parent"),
        slug(F.col("title")).alias("slug"),
        "folder",
        "priority",
    )
    sorted_out = staged(asked.join(kept, "id", "left"))
    stable = _written_out(sorted_out.where("file_path is not null"))
    pending = sorted_out.where("file_path is null").drop("file_path")
    parents = kept.select(F.col("id").alias("p_id"), F.col("file_path").alias("p_path"))
    waiting_ids = pending.select(F.col("id").alias("w_id"))
    waits = F.col("p_path").isNull() & F.col("w_id").isNotNull()
    top = F.coalesce(child_directory(F.col("p_path")), F.col("folder"))
    first = staged(
        lookup(pending, parents, "parent", "p_id", floor=floor)
        .drop("p_id")
        .transform(lambda df: lookup(df, waiting_ids, "parent", "w_id", floor=floor))
        .withColumn("dir", F.when(~waits, F.coalesce(top, F.lit(""))))
        .select("id", "parent", "slug", "folder", "priority", "dir")
    )
    # not stored, as it follows from the two
    home = F.when(F.col("dir").isNull(), F.concat(F.lit("@"), unpacked(F.col("parent")))).otherwise(_in_directory(F.col("dir")))
    taken = staged(_keys(kept).distinct())
    if first.where("dir is null").isEmpty():
        named = first.join(_settled(first.withColumn("home", home), taken), "id")
        return stable.unionByName(_written_out(named.withColumn("file_path", _path(F.col("dir"), F.col("name")))))
    occupied = taken
    while True:
        names = _settled(first.withColumn("home", home), occupied).withColumnRenamed("id", "n_id")
        nodes = staged(first.join(names, F.col("id") == F.col("n_id")).drop("n_id"))
        waiting_for = F.when(F.col("dir").isNull(), F.col("parent"))
        walked = resolve_pointers(
            nodes.select("id", waiting_for.alias("next_id"), F.col("dir").alias("payload"), "name"),
            names="name", ready=True, floor=floor,
        )
        walked = staged(walked.select("id", _path(F.col("payload"), F.col("trail")).alias("file_path"), "hops", "outcome"))
        placed = walked.where(F.col("outcome") == FOUND).select(unpacked(F.col("id")).alias("id"), "file_path", "hops")
        if not _meet(placed, taken):
            break
        again = staged(_losers(nodes.withColumns({"home": home, "id": unpacked(F.col("id"))}), placed, taken).join(occupied, ["home", "name"], "left_anti"))
        if again.isEmpty():
            break
        occupied = staged(occupied.unionByName(again).distinct())
    stuck = staged(
        nodes.join(walked.where(F.col("outcome") == CYCLE).select("id"), "id", "left_semi")
        .select("id", "slug", F.col("folder").alias("dir"), _in_directory(F.col("folder")).alias("home"), "priority")
    )
    result = stable.unionByName(placed.select("id", "file_path"))
    if stuck.isEmpty():
        return result
    late = stuck.join(_settled(stuck, taken.unionByName(_keys(placed)).distinct()), "id")
    return result.unionByName(_written_out(late.withColumn("file_path", _path(F.col("dir"), F.col("name")))))


def _written_out(rows: DataFrame) -> DataFrame:
    return rows.select(unpacked(F.col("id")).alias("id"), "file_path")


def _path(folder: Column, name: Column) -> Column:
    return joined_path(folder, F.concat(name, F.lit(".md")))


def _meet(placed: DataFrame, taken: DataFrame) -> bool:
    """Whether a path may be held twice: as hashes, so that the usual answer, no, costs eight bytes a page."""
    keys = taken.select("home", "name").unionByName(_keys(placed))
    counted = keys.select(F.xxhash64("home", "name").alias("key")).groupBy("key").count()
    return not counted.where("count > 1").isEmpty()


def _losers(nodes: DataFrame, placed: DataFrame, taken: DataFrame) -> DataFrame:
    """`(home, name)` of the pages that have to give up a path others hold: the kept, then the upper ones.

    Only those of the uppermost level with such pages, as the others may move away with their parents.
    """
    order = F.struct(F.col("hops"), F.col("priority"), F.col("id"))
    ranked = placed.join(nodes.select("id", "priority", F.col("home").alias("own")), "id")
    keys = ranked.select(
        "own", "hops", order.alias("turn"), _in_directory(directory(F.col("file_path"))).alias("home"),
        F.lower(stem(F.col("file_path"))).alias("name"),
    )
    held = taken.withColumn("kept", F.lit(1)).unionByName(
        keys.select("home", "name", F.lit(0).alias("kept"), "turn"), allowMissingColumns=True
    )
    shared = held.groupBy("home", "name").agg(
        F.count("*").alias("n"), F.max("kept").alias("kept"), F.min("turn").alias("winner")
    ).where("n > 1")
    lost = keys.join(shared, ["home", "name"]).where((F.col("kept") == 1) | (F.col("turn") != F.col("winner")))
    lost = staged(lost.select("hops", F.col("own").alias("home"), "name").distinct())
    return lost.join(lost.agg(F.min("hops").alias("hops")), "hops", "left_semi").drop("hops")


def path_collisions(paths: DataFrame) -> DataFrame:
    """Paths held by several pages; a check that there are none."""
    return (
        paths.groupBy(F.lower("file_path").alias("path"))
        .agg(F.count("*").alias("pages"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("pages > 1")
    )
