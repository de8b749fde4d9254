"""Walks up from a few nodes, against brute force and at a cost that follows them."""

import random

import pytest

from leafwork.operators import frontier
from leafwork.plans import maintenance

NODES = "id STRING, parent_id STRING"
REGISTRY = "id STRING, parent_id STRING, is_root BOOLEAN, enabled BOOLEAN, folder STRING, file_path STRING"


def above(edges, seeds, stop=()):
    found, todo = set(), list(seeds)
    while todo:
        at = todo.pop()
        if at not in found:
            found.add(at)
            up = edges.get(at)
            if up and up not in stop:
                todo.append(up)
    return found


def one_column(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id STRING")


@pytest.mark.parametrize("rounds", [0, 3])
def test_ancestors(spark, rounds):
    rng = random.Random(rounds)
    edges = {f"n{i}": f"n{rng.randrange(max(0, i - 6), i)}" if i and rng.random() < 0.97 else rng.choice(["", None, "lost"]) for i in range(300)}
    edges |= {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c1"}
    nodes = spark.createDataFrame(list(edges.items()), NODES)
    seeds = rng.sample(sorted(edges), 8) + ["c4", "not there", None]
    stop = rng.sample([n for n in edges if n not in seeds], 12)
    for ends in ([], stop):
        found = frontier.ancestor_ids(
            one_column(spark, seeds * 2), frontier.pointers_of(nodes), one_column(spark, ends) if ends else None, rounds=rounds, floor=1)
        got = [r["id"] for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == above(edges, [s for s in seeds if s], ends)
    none = frontier.ancestor_ids(one_column(spark, ["a"]).where("false"), frontier.pointers_of(nodes))
    assert none.isEmpty()


def test_a_node_is_asked_for_once(spark):
    """However many pages hang on it, a parent is looked up once, and nothing beside the walk is."""
    nodes = spark.createDataFrame([(f"p{i}", "hot") for i in range(200)] + [("hot", "top"), ("top", "")] + [(f"x{i}", "y") for i in range(200)], NODES)
    asked = []
    fetch = frontier.pointers_of(nodes)

    def counting(ids):
        asked.extend(sorted(r["id"] for r in ids.collect()))
        return fetch(ids)

    frontier.ancestor_ids(one_column(spark, [f"p{i}" for i in range(200)]), counting)
    assert sorted(asked) == sorted([f"p{i}" for i in range(200)] + ["hot", "top"])


def test_chain_is_written_once(spark):
    """A chain of 2,000 unregistered pages asked for at three places: a row per page."""
    nodes = spark.range(2000).selectExpr("concat('n', id) as id", "if(id = 0, 'root', concat('n', id - 1)) as parent_id")
    registry = spark.createDataFrame([("root", "", True, True, "tech", "tech/root.md")], REGISTRY)
    fetch = frontier.pointers_of(nodes)
    got = maintenance.write_set(fetch, registry, one_column(spark, ["n1999", "n1500", "n3", "gone"])).collect()
    assert sorted((r["write_order"], r["id"], r["folder"]) for r in got) == [(i, f"n{i}", "tech") for i in range(2000)]


def test_few_seeds_leave_the_rest_alone(spark, monkeypatch):
    """Ten pages of a large workspace: what is resolved are they and their ancestors, with the same result."""
    rows = [("r", "", True, True, "f", "")] + [(f"a{i}", "r" if i < 50 else f"a{i - 50}", False, False, "f", "") for i in range(2000)]
    registry = spark.createDataFrame(rows, REGISTRY)
    nodes = spark.createDataFrame([(f"n{i}", f"a{i}" if i < 400 else f"n{i - 200}") for i in range(1000)], NODES)
    asked = one_column(spark, [f"n{i}" for i in range(990, 1000)])
    near, above, narrow = frontier.open_walk(frontier.pointers_of(nodes), registry, asked)
    # n990 hangs on n790, n590, n390 and so on a390, below which are a340, a290, … and the root
    assert narrow and near.count() == 40 and above.count() == 81
    plan = maintenance.write_set(frontier.pointers_of(nodes), registry, asked)
    small = sorted(map(tuple, plan.select("id", "folder", "write_order").collect()))
    monkeypatch.setattr(frontier, "SHARE", 0)
    assert frontier.open_walk(frontier.pointers_of(nodes), registry, asked)[2]
    monkeypatch.setattr(frontier, "SHARE", 10**9)
    assert not frontier.open_walk(frontier.pointers_of(nodes), registry, asked)[2]
    again = maintenance.write_set(frontier.pointers_of(nodes), registry, asked)
    assert sorted(map(tuple, again.select("id", "folder", "write_order").collect())) == small and len(small) == 40


def test_registry_walk_stops_at_the_root(spark, monkeypatch):
    monkeypatch.setattr(frontier, "SHARE", 0)
    rows = [("r", "higher", True, True, "f", ""), ("higher", "", True, True, "f", ""), ("a", "r", False, False, "f", ""),
            ("b", "a", False, False, "f", ""), ("c", "r", False, False, "f", "")]
    got = frontier.registry_walk(spark.createDataFrame(rows, REGISTRY), one_column(spark, ["b", "new"])).collect()
    assert {r["id"] for r in got} == {"b", "a", "r"}
