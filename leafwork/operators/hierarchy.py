"""Parent-pointer forests: roots, ancestors, orphans, cycles, containing pages, tree listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, packed, unpacked
from leafwork.operators.ordering import with_running_sum
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

FOUND, DANGLING, CYCLE = "found", "dangling", "cycle"


def resolve_pointers(
    nodes: DataFrame, *, names: str | None = None, keep: tuple[str, ...] = (), ready: bool = False, floor: int = HOT_FLOOR
) -> DataFrame:
    """Follow `next_id` from every node to the first node that carries a `payload`.

    `nodes(id, next_id, payload)` has one row per id; a non-null payload ends the walk. Result:
    `(id, end_id, payload, outcome, hops)` with outcome `found`, `dangling` (the walk left the
    table, `end_id` is the last id looked for) or `cycle`. With the column `names` of `nodes` the result
    also has `trail`: the names on the way from the end down to the node, both included, joined by `/`.
    The columns `keep` of `nodes` are handed on.

    Nodes nobody points to are most of a tree, so only those somebody points to are resolved in rounds;
    then every node takes one step to what its target came to. The rounds go by pointer doubling: each
    replaces every open pointer by its target's pointer, so a chain of length d needs log2(d) rounds.
    Settled rows leave the loop; a round that settles nothing proves that only cycles are left. Pointers
    pile up on few targets, hence the skew-safe lookup. Ids may be text or packed (`ids.packed`), which
    halves what is sent and written. The nodes are staged unless they are `ready`: cheap to read several
    times. The last step is left to whoever reads the result, who stages it to read it more than once.
    """
    found = F.col("payload").isNotNull()
    start = nodes.select(
        "id",
        F.when(found, F.col("id")).otherwise(F.coalesce("next_id", "id")).alias("up"),
        "payload",
        F.when(found, F.lit(FOUND)).when(F.col("next_id").isNull(), F.lit(DANGLING)).alias("outcome"),
        F.when(found | F.col("next_id").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("hops"),
        *([] if names is None else [F.col(names).alias("trail")]),
        *keep,
    )

    def step(rows: DataFrame, table: DataFrame, count: int | None) -> DataFrame:
        """Move every open row on by its target's pointer; settled rows look nothing up."""
        seen = table.select(*[F.col(c).alias(f"t_{c}") for c in table.columns])
        keyed = rows.withColumn("_key", F.when(F.col("outcome").isNull(), F.col("up")))
        joined = lookup(keyed, seen, "_key", "t_id", rows=count, floor=floor)
        settled_before = F.col("outcome").isNotNull()
        missed = F.col("t_id").isNull()
        return joined.select(
            "id",
            F.when(settled_before, F.col("up")).otherwise(F.coalesce("t_up", "up")).alias("up"),
            F.when(settled_before, F.col("payload")).otherwise(F.col("t_payload")).alias("payload"),
            F.when(settled_before, F.col("outcome")).when(missed, F.lit(DANGLING))
            .otherwise(F.col("t_outcome")).alias("outcome"),
            (F.col("hops") + F.when(settled_before, 0).otherwise(F.coalesce("t_hops", F.lit(0)))).alias("hops"),
            *([] if names is None else [
                F.when(settled_before | missed, F.col("trail")).otherwise(F.concat_ws("/", "t_trail", "trail")).alias("trail")
            ]),
            *(c for c in keep if c in rows.columns),
        )

    start = start if ready else staged(start)
    # staged, so that few targets are broadcast and the nodes stay where they are
    aimed_at = staged(start.where("outcome is null").select(F.col("up").alias("a_id")).distinct())
    inner = staged(start.drop(*keep).join(aimed_at, F.col("id") == F.col("a_id"), "left_semi"))
    settled = inner.where("outcome is not null")
    open_rows = inner.where("outcome is null")
    remaining = open_rows.count()
    while remaining:
        stepped = staged(step(open_rows, settled.unionByName(open_rows), remaining))
        settled = settled.unionByName(stepped.where("outcome is not null"))
        open_rows = stepped.where("outcome is null")
        before, remaining = remaining, open_rows.count()
        if remaining == before:
            break
    ended = settled.unionByName(open_rows.withColumn("outcome", F.lit(CYCLE)))
    last = step(start.where("outcome is null"), ended, None)
    return start.where("outcome is not null").unionByName(last).withColumnRenamed("up", "end_id")


def _traced(registry: DataFrame, floor: int) -> DataFrame:
    """`trace_roots` with the ids packed."""
    nodes = registry.select(
        packed(F.col("id")).alias("id"),
        packed(blank_to_null(F.col("parent_id"))).alias("next_id"),
        F.when(
            F.col("is_root"), F.struct(F.coalesce("enabled", F.lit(False)).alias("enabled"))
        ).alias("payload"),
    )
    return resolve_pointers(nodes, floor=floor).select(
        "id",
        F.when(F.col("outcome") == FOUND, F.col("end_id")).alias("root_id"),
        F.col("payload.enabled").alias("root_enabled"),
        "outcome",
        "hops",
    )


def trace_roots(registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Root of every registered page: `(id, root_id, root_enabled, outcome, hops)`.

    The walk stops at the first page flagged as root, also when that page has a parent.
    """
    return _traced(registry, floor).withColumns({c: unpacked(F.col(c)) for c in ("id", "root_id")})


def with_roots(registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Registry rows with `root_id`, `root_enabled` (false without a root) and `outcome`."""
    joined = registry.withColumn("id", packed(F.col("id"))).join(_traced(registry, floor), "id")
    return joined.withColumns({
        "id": unpacked(F.col("id")), "root_id": unpacked(F.col("root_id")),
        "root_enabled": F.coalesce("root_enabled", F.lit(False)),
    })


def missing_parents(registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Pages whose parent id is set but not registered (the listing's notion of orphan)."""
    children = registry.withColumn("_parent", blank_to_null(F.col("parent_id"))).where(
        "_parent is not null"
    )
    known = registry.select(F.col("id").alias("_known"))
    return (
        lookup(children, known, "_parent", "_known", floor=floor)
        .where("_known is null")
        .drop("_parent", "_known")
    )


def with_orphan_flag(registry: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Registry rows plus `is_orphaned`."""
    keyed = registry.withColumn("_parent", blank_to_null(F.col("parent_id")))
    known = registry.select(F.col("id").alias("_known"))
    return (
        lookup(keyed, known, "_parent", "_known", floor=floor)
        .withColumn("is_orphaned", F.col("_parent").isNotNull() & F.col("_known").isNull())
        .drop("_parent", "_known")
    )


def nearest_registered(
    nodes: DataFrame, traced: DataFrame, *, default_folder: str = "default",
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Nearest registered ancestor of every workspace node, whether or not the node is registered.

    `nodes(id, parent_id)` are pages and databases with normalised ids; `traced` is the result of
    `with_roots`. Result:
    `(id, anchor_id, folder, found_root, missing_ancestors, outcome)`. `found_root` says that the
    anchor lies under an enabled root; without any registered ancestor the default folder applies.
    `dangling` means that an ancestor could not be read, `cycle` that the chain never ends.
    """
    known = traced.select(
        packed(F.col("id")).alias("r_id"), F.col("folder").alias("r_folder"), "root_enabled"
    )
    keyed = nodes.select(packed(F.col("id")).alias("id"), packed(blank_to_null(F.col("parent_id"))).alias("next_id"))
    anchored = lookup(keyed, known, "next_id", "r_id", floor=floor)
    payload = F.when(
        F.col("next_id").isNull() | F.col("r_id").isNotNull(),
        F.struct(
            F.col("r_id").alias("anchor_id"),
            F.coalesce("r_folder", F.lit(default_folder)).alias("folder"),
            F.coalesce("root_enabled", F.lit(False)).alias("found_root"),
        ),
    )
    resolved = resolve_pointers(
        anchored.select("id", "next_id", payload.alias("payload")), floor=floor
    )
    return resolved.select(
        unpacked(F.col("id")).alias("id"),
        unpacked(F.col("payload.anchor_id")).alias("anchor_id"),
        "payload.folder",
        F.coalesce("payload.found_root", F.lit(False)).alias("found_root"),
        F.col("hops").alias("missing_ancestors"),
        "outcome",
    )


def ancestor_chains(
    requested: DataFrame, nodes: DataFrame, anchors: DataFrame, *, floor: int = HOT_FLOOR
) -> DataFrame:
    """Unregistered ancestors of each requested page: `(page_id, depth, ancestor_id)`.

    Depth 1 is the parent; writing in descending depth puts the root first. `anchors` is the
    result of `nearest_registered`; pages whose chain does not end are left to the caller.
    """
    edges = nodes.select(
        packed(F.col("id")).alias("e_id"), packed(blank_to_null(F.col("parent_id"))).alias("e_parent")
    )
    ends = anchors.where(F.col("outcome") == FOUND).select(
        packed(F.col("id")).alias("a_id"), F.col("missing_ancestors").alias("left")
    )
    walk = (
        requested.select(packed(F.col("id")).alias("page_id"))
        .join(ends, F.col("page_id") == F.col("a_id"))
        .where("left > 0")
        .select("page_id", F.col("page_id").alias("at"), "left", F.lit(0).alias("depth"))
    )
    walk = staged(walk)
    levels = []
    pending = walk.count()
    while pending:
        step = staged(
            lookup(walk, edges, "at", "e_id", how="inner", rows=pending, floor=floor).select(
                "page_id",
                F.col("e_parent").alias("at"),
                (F.col("left") - 1).alias("left"),
                (F.col("depth") + 1).alias("depth"),
            )
        )
        levels.append(step.select("page_id", "depth", F.col("at").alias("ancestor_id")))
        walk = step.where("left > 0")
        pending = walk.count()
    if not levels:
        levels.append(walk.select("page_id", "depth", F.col("at").alias("ancestor_id")))
    chain = levels[0]
    for level in levels[1:]:
        chain = chain.unionByName(level)
    return chain.select(unpacked(F.col("page_id")).alias("page_id"), "depth", unpacked(F.col("ancestor_id")).alias("ancestor_id"))


def block_containers(
    blocks: DataFrame, *, hop_limit: int | None = None, floor: int = HOT_FLOOR
) -> DataFrame:
    """Page or database that contains each block: `(block_id, container_id, container_type, error)`.

    `blocks(block_id, parent_type, parent_id)`. Blocks straight under the workspace have no
    container and no error; unknown parent types, unreadable blocks and cycles carry an error
    instead, and with a `hop_limit` so do walks over more blocks than that.
    """
    kind, parent = F.col("parent_type"), F.col("parent_id")
    payload = F.when(
        F.coalesce(kind, F.lit("")) != "block_id",
        F.struct(
            packed(F.when(kind.isin("page_id", "database_id"), parent)).alias("container_id"),
            F.when(kind.isin("page_id", "database_id", "workspace"), kind).alias("container_type"),
        ),
    )
    nodes = blocks.select(
        packed(F.col("block_id")).alias("id"),
        packed(F.when(kind == "block_id", blank_to_null(parent))).alias("next_id"),
        payload.alias("payload"),
    )
    resolved = resolve_pointers(nodes, floor=floor)
    too_far = F.lit(False) if hop_limit is None else (F.col("outcome") == FOUND) & (F.col("hops") >= hop_limit)
    error = (
        F.when(F.col("outcome") == CYCLE, F.lit("max_depth"))
        .when(too_far, F.lit("max_depth"))
        .when(F.col("outcome") == DANGLING, F.lit("block_not_found"))
        .when(F.col("payload.container_type").isNull(), F.lit("unexpected_parent_type"))
    )
    return resolved.withColumn("error", error).select(
        unpacked(F.col("id")).alias("block_id"),
        unpacked(F.when(F.col("error").isNull(), F.col("payload.container_id"))).alias("container_id"),
        F.when(F.col("error").isNull(), F.col("payload.container_type")).alias("container_type"),
        "error",
    )


def _listed(registry: DataFrame, children: DataFrame, *, names: bool, floor: int) -> DataFrame:
    """Pages of the listing: `(id, parent, position, is_last, root_id, folder, depth, …)`, roots with a null parent.

    `children(parent_id, position, child_id)` are the ordered child edges. A child is shown below the
    page that lists it when both share the folder, and once: below the first page by id if several
    list it. Roots stay at the top, and pages that no root leads to are not listed. With `names` there
    is also `sort_key`, the places on the way down. Ids are packed (`ids.packed`) in the result.
    """
    pages = staged(registry.select(packed(F.col("id")).alias("id"), "folder", "is_root"))
    parents = pages.select(F.col("id").alias("p_id"), F.col("folder").alias("p_folder"))
    kids = pages.where("not is_root").select(F.col("id").alias("k_id"), F.col("folder").alias("k_folder"))
    listed = children.select(packed(F.col("parent_id")).alias("parent_id"), "position", packed(F.col("child_id")).alias("child_id"))
    # the order of the ids decides, which packed ones have not; rows lie by child when they are grouped
    first = F.min(F.struct(unpacked(F.col("parent_id")).alias("parent_id"), "position"))
    shown = (
        lookup(listed, parents, "parent_id", "p_id", how="inner", floor=floor)
        .transform(lambda df: lookup(df, kids, "child_id", "k_id", how="inner", floor=floor))
        .where("p_folder = k_folder")
        .groupBy("child_id").agg(first.alias("first"))
        .select(
            F.col("child_id").alias("id"), packed(F.col("first.parent_id")).alias("parent"), F.col("first.position").cast("bigint").alias("position")
        )
    )
    shown = staged(shown)
    last = shown.groupBy(F.col("parent").alias("l_parent")).agg(F.max("position").alias("last_position"))
    edges = lookup(shown, last, "parent", "l_parent", how="inner", floor=floor).select(
        "id", "parent", "position", (F.col("position") == F.col("last_position")).alias("is_last")
    )
    none = F.lit(None).cast("string").alias("folder")
    top = pages.where("is_root").select(
        "id", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("bigint").alias("position"), F.lit(True).alias("is_last"), "folder"
    )
    nodes = staged(edges.select("*", none).unionByName(top))
    payload = F.when(F.col("parent").isNull(), F.struct("folder")).alias("payload")
    place = F.coalesce(F.lpad(F.hex("position"), 10, "0"), F.lit("")).alias("place")
    own = ("parent", "position", "is_last")
    walked = resolve_pointers(
        nodes.select("id", F.col("parent").alias("next_id"), payload, place, *own),
        names="place" if names else None, keep=own, ready=True, floor=floor,
    )
    ended = walked.where(F.col("outcome") == FOUND).select(
        "id", *own, F.col("end_id").alias("root_id"), "payload.folder", F.col("hops").alias("depth"),
        *([F.replace("trail", F.lit("/"), F.lit("")).alias("sort_key")] if names else []),
    )
    # a page below another has one row by now; of the roots the registry may repeat rows
    roots = nodes.where("parent is null").drop("folder").join(ended.where("parent is null").drop(*own), "id")
    return ended.where("parent is not null").unionByName(roots)


def tree_listing(registry: DataFrame, children: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Depth-first listing per folder: `(folder, root_id, id, depth, sort_key, is_last)`.

    `sort_key` orders the rows of a root depth first, so printing is `order by folder, root_id,
    sort_key`. It grows with the depth; `preorder` has places instead. Which pages are listed, see
    `_listed`.
    """
    rows = _listed(registry, children, names=True, floor=floor)
    return rows.select(
        "folder", unpacked(F.col("root_id")).alias("root_id"), unpacked(F.col("id")).alias("id"), "depth", "sort_key", "is_last"
    )


def preorder(registry: DataFrame, children: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Depth-first listing by place: `(folder, root_id, id, depth, place, is_last)`, each root from place 0.

    The place of a page is the sum, over it and the pages above it but the root, of one and the pages
    below earlier siblings. Both sums go by pointer doubling, so a tree of depth d takes log2(d) rounds
    and no row carries its way up: with pointers over 2^i levels, the pages less than 2^i levels below
    a page are added to the page 2^i above it, and sums over 2^i pages to those that continue them. A
    page with very many children is one key of map-side sums and of a range-partitioned running sum.
    """
    rows = staged(_listed(registry, children, names=False, floor=floor))
    sizes = staged(rows.select("id", F.lit(1).cast("bigint").alias("size")))
    jumps: list[DataFrame] = []
    jump = staged(rows.where("parent is not null").select("id", F.col("parent").alias("up")))
    while not jump.isEmpty():
        jumps.append(jump)
        more = jump.join(sizes, "id").groupBy(F.col("up").alias("m_id")).agg(F.sum("size").alias("more"))
        sizes = staged(
            sizes.join(more, F.col("id") == F.col("m_id"), "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
        twice = jump.select(F.col("id").alias("j_id"), F.col("up").alias("j_up"))
        jump = staged(lookup(jump, twice, "up", "j_id", how="inner", floor=floor).select("id", F.col("j_up").alias("up")))
    siblings = rows.where("parent is not null").select("id", "parent", "position").join(sizes, "id")
    summed = staged(with_running_sum(siblings, [F.col("parent"), F.col("position"), F.col("id")], "size", "_run"))
    base = summed.groupBy(F.col("parent").alias("b_id")).agg(F.min("_run").alias("_base"))
    steps = lookup(summed, base, "parent", "b_id", how="inner", floor=floor).select(
        "id", (F.col("_run") - F.col("_base") + 1).alias("place")
    )
    tops = rows.where("parent is null").select("id", F.lit(0).cast("bigint").alias("place"))
    places = staged(steps.unionByName(tops))
    for jump in jumps:
        above = places.select(F.col("id").alias("a_id"), F.col("place").alias("a_place"))
        further = lookup(jump, above, "up", "a_id", how="inner", floor=floor).select(F.col("id").alias("f_id"), "a_place")
        places = staged(
            places.join(further, F.col("id") == F.col("f_id"), "left").select("id", (F.col("place") + F.coalesce("a_place", F.lit(0))).alias("place"))
        )
    return rows.join(places, "id").select(
        "folder", unpacked(F.col("root_id")).alias("root_id"), unpacked(F.col("id")).alias("id"), "depth", "place", "is_last"
    )
