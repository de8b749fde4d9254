"""Ancestors of a set of nodes, at a cost that follows the set and not the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null, packed, unpacked
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

# Pointers `(id, next_id)` of the nodes in a frame `(id)`, or of all nodes for None.
Fetch = Callable[[DataFrame | None], DataFrame]

ROUNDS = 8  # walked one edge at a time; what is deeper is reached by doubling
SHARE = 20  # seeds are few below this part of the nodes


def pointers_of(nodes: DataFrame) -> Fetch:
    """Pointers of a table `(id, parent_id)`."""
    edges = nodes.select("id", blank_to_null(F.col("parent_id")).alias("next_id"))

    def fetch(ids: DataFrame | None) -> DataFrame:
        return edges if ids is None else edges.join(ids, "id", "left_semi")

    return fetch


def ancestor_ids(
    seeds: DataFrame, fetch: Fetch, stop: DataFrame | None = None, *, rounds: int = ROUNDS, floor: int = HOT_FLOOR
) -> DataFrame:
    """`(id)`: the seeds and every node on their walks up, each once, known or not.

    A walk ends where a node has no pointer or points into `stop(id)`. Each round takes the distinct
    nodes that the last one reached, so a node is asked for once, however many walks lead through it,
    and there is no hot key. Walks of more than `rounds` steps go on by doubling: with pointers over
    2^i steps of all nodes, one union and one composition per i, until nothing new is reached.
    """
    frontier = staged(seeds.select("id").where("id is not null").distinct())
    reached = frontier
    for _ in range(rounds):
        parents = fetch(frontier).select(F.col("next_id").alias("id")).where("id is not null").distinct()
        if stop is not None:
            parents = parents.join(stop.select("id"), "id", "left_anti")
        frontier = staged(parents.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    return reached.unionByName(_doubled(frontier, fetch, stop, floor)).distinct()


def _doubled(frontier: DataFrame, fetch: Fetch, stop: DataFrame | None, floor: int) -> DataFrame:
    """All nodes above `frontier`, itself included: S grows by J(S), then J becomes J∘J.

    A round that adds nothing proves that S is complete: it is closed under J, and what lies fewer
    steps than J's above a node of S is in S already.
    """
    jumps = fetch(None).select("id", F.col("next_id").alias("up")).where("up is not null")
    if stop is not None:
        ends = stop.select(F.col("id").alias("s_id"))
        jumps = lookup(jumps, ends, "up", "s_id", floor=floor).where("s_id is null").drop("s_id")
    jumps = staged(jumps)
    found = frontier
    while True:
        step = jumps.join(found, "id", "left_semi").select(F.col("up").alias("id")).distinct()
        new = staged(step.join(found, "id", "left_anti"))
        if new.isEmpty():
            return found
        found = staged(found.unionByName(new))
        twice = jumps.select(F.col("id").alias("j_id"), F.col("up").alias("j_up"))
        jumps = staged(lookup(jumps, twice, "up", "j_id", how="inner", floor=floor).select("id", F.col("j_up").alias("up")))


def few(seeds: DataFrame, nodes: DataFrame) -> bool:
    """Whether walking up from `seeds` costs less than following all pointers of `nodes` at once.

    The results are the same. A walk takes a round per level; from a large part of the nodes it would
    reach most of the others, and doubling all of them takes fewer and no larger rounds.
    """
    return seeds.count() * SHARE < nodes.count()


def registry_walk(registry: DataFrame, seeds: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """The rows of `registry` that decide the roots of `seeds(id)`: theirs and those above, up to the first root.

    All rows where the seeds are many (see `few`).
    """
    if not few(seeds, registry):
        return registry
    up = F.when(~F.coalesce("is_root", F.lit(False)), blank_to_null(F.col("parent_id")))
    ids = ancestor_ids(seeds, pointers_of(registry.select("id", up.alias("parent_id"))), floor=floor)
    return registry.join(ids, "id", "left_semi")


def open_walk(fetch: Fetch, registry: DataFrame, seeds: DataFrame, *, floor: int = HOT_FLOOR) -> tuple[DataFrame, DataFrame, bool]:
    """What decides the nearest registered ancestors of `seeds(id)`: `(nodes, registry rows, narrow)`.

    The nodes `(id, parent_id)` are the seeds and their unregistered ancestors, the registry rows those
    of seeds and anchors and all above them. Where the seeds are many, both are all there are and
    `narrow` is false (see `few`).
    """
    everything = fetch(None).select("id", F.col("next_id").alias("parent_id"))
    if not few(seeds, everything):
        short = staged(everything.select(*(packed(F.col(c)).alias(c) for c in ("id", "parent_id"))))
        return short.select(*(unpacked(F.col(c)).alias(c) for c in ("id", "parent_id"))), registry, False
    ids = ancestor_ids(seeds, fetch, registry.select("id"), floor=floor)
    nodes = staged(fetch(ids).select("id", F.col("next_id").alias("parent_id")))
    touched = staged(seeds.select("id").unionByName(nodes.select(F.col("parent_id").alias("id"))).distinct())
    return nodes, registry_walk(registry, touched, floor=floor), True
