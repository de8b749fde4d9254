"""Hierarchies against brute force over random forests with cycles and missing parents."""

import random

from leafwork.operators import hierarchy, paths
from leafwork.plans import maintenance
from leafwork.session import staged

REGISTRY = "id STRING, parent_id STRING, is_root BOOLEAN, enabled BOOLEAN, folder STRING, file_path STRING"


def forest(seed, size=300, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        kind = rng.random()
        parent = "n0" if hot and kind < 0.4 else f"n{rng.randrange(max(i, 1))}" if kind < 0.85 else f"n{rng.randrange(size)}"
        if kind > 0.95:
            parent = rng.choice(["", None, f"lost{i}"])
        if i % 50 in (7, 8, 9):  # cycles of three
            parent = f"n{i - 2 if i % 50 == 9 else i + 1}"
        rows.append((f"n{i}", parent, rng.random() < 0.05, rng.random() < 0.5, f"f{i % 3}", f"f/{i}.md"))
    return rows


def walk(rows):
    table = {r[0]: r for r in rows}
    result = {}
    for start in table:
        seen, at = set(), start
        while True:
            if at in seen:
                result[start] = (None, None, "cycle")
                break
            seen.add(at)
            row = table.get(at)
            if row is None:
                result[start] = (None, None, "dangling")
                break
            if row[2]:
                result[start] = (at, row[3], "found")
                break
            if not row[1]:
                result[start] = (None, None, "dangling")
                break
            at = row[1]
    return result


def test_roots_match_brute_force(spark):
    for seed, hot, floor in ((1, False, 10**6), (2, True, 20)):
        rows = forest(seed, hot=hot)
        found = hierarchy.trace_roots(spark.createDataFrame(rows, REGISTRY), floor=floor).collect()
        got = {r["id"]: (r["root_id"], r["root_enabled"], r["outcome"]) for r in found}
        assert len(found) == len(rows) and got == walk(rows)
        assert {"found", "dangling", "cycle"} <= {v[2] for v in got.values()}


def test_long_chain(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else "", i == 0, True, "f", "") for i in range(500)]
    got = hierarchy.trace_roots(spark.createDataFrame(rows, REGISTRY)).collect()
    assert {r["root_id"] for r in got} == {"n0"}
    assert sorted(r["hops"] for r in got) == list(range(500))


def test_block_hop_limit(spark):
    rows = [(f"b{i}", "page_id" if i == 0 else "block_id", "page" if i == 0 else f"b{i - 1}") for i in range(60)]
    rows += [("c1", "block_id", "c2"), ("c2", "block_id", "c1"), ("w", "workspace", ""), ("t", "team", "x"), ("m", "block_id", "nowhere")]
    frame = spark.createDataFrame(rows, "block_id STRING, parent_type STRING, parent_id STRING")
    free = {r["block_id"]: r["container_id"] for r in hierarchy.block_containers(frame).collect()}
    assert free["b59"] == "page"
    got = {r["block_id"]: (r["container_id"], r["error"]) for r in hierarchy.block_containers(frame, hop_limit=50).collect()}
    assert got["b49"] == ("page", None) and got["b50"] == (None, "max_depth")
    assert got["c1"][1] == "max_depth" and got["w"] == (None, None)
    assert got["t"][1] == "unexpected_parent_type" and got["m"][1] == "block_not_found"


def test_ancestor_chain_is_written_root_first(spark):
    registry = spark.createDataFrame([("root", "", True, True, "tech", "tech/root.md")], REGISTRY)
    nodes = spark.createDataFrame(
        [("a", "root"), ("b", "a"), ("c", "b"), ("top", ""), ("x", "top"), ("y", "unknown"), ("p", "q"), ("q", "p")],
        "id STRING, parent_id STRING")
    asked = spark.createDataFrame([("c",), ("x",), ("y",), ("p",)], "id STRING")
    for floor in (10**6, 1):
        plan = maintenance.get_plan(nodes, registry, asked, floor=floor).collect()
        got = sorted((r["page_id"], r["write_order"], r["id"], r["folder"]) for r in plan)
        assert got == [("c", 0, "a", "tech"), ("c", 1, "b", "tech"), ("c", 2, "c", "tech"),
                       ("x", 0, "top", "default"), ("x", 1, "x", "default")]


def test_orphans_follow_the_manifest(spark):
    rows = [("r", "", True, True, "f", "f/r.md"), ("s", "", True, True, "f", "f/s.md"), ("a", "r", False, False, "f", "f/a.md"),
            ("b", "s", False, False, "f", ""), ("c", "gone", False, False, "f", None), ("d", "e", False, False, "f", "x"),
            ("e", "d", False, False, "f", "y")]
    listed = spark.createDataFrame([("r",)], "page_id STRING")
    orphans = staged(maintenance.orphaned_pages(spark.createDataFrame(rows, REGISTRY), listed))
    assert {r["id"] for r in orphans.collect()} == {"s", "b", "c"}
    counts = {r["metric"]: r["value"] for r in maintenance.cleanup_counters(orphans).collect()}
    assert counts == {"orphaned_pages": 3, "deleted_registries": 3, "deleted_files": 1}
    dry = {r["metric"]: r["value"] for r in maintenance.cleanup_counters(orphans, dry_run=True).collect()}
    assert dry == {"orphaned_pages": 3, "deleted_registries": 0, "deleted_files": 0}


NEW = "id STRING, parent_id STRING, title STRING, folder STRING, is_root BOOLEAN, priority BIGINT"


def assigned(spark, new, kept, **kwargs):
    frame = paths.assign_paths(
        spark.createDataFrame(new, NEW), spark.createDataFrame(kept, "id STRING, file_path STRING"), **kwargs)
    rows = frame.collect()
    assert len(rows) == len(new)
    return {r["id"]: r["file_path"] for r in rows}


def test_paths(spark):
    kept = [("k1", "tech/wiki.md"), ("k2", "tech/wiki/setup.md"), ("nopath", None)]
    new = [
        ("aaaa1", "k1", "Setup", "tech", False, 5), ("bbbb1", "k1", "Guide", "tech", False, 2),
        ("cccc1", "k1", "guide!", "tech", False, 1), ("dddd1", "cccc1", "Deep", "tech", False, 0),
        ("eeee1", "dddd1", "Deeper", "tech", False, 0), ("ffff1", "lost", "Stray", "tech", False, 0),
        ("gggg1", "", "Wiki", "tech", True, 0), ("k2", "k1", "Renamed", "tech", False, 0),
        ("hhhh1", "iiii1", "Loop", "tech", False, 0), ("iiii1", "hhhh1", "Loop", "tech", False, 0),
        ("jjjj1", "k1", "Root anyway", "docs", True, 0),
    ]
    want = {
        "aaaa1": "tech/wiki/setup-aaaa.md", "bbbb1": "tech/wiki/guide-bbbb.md", "cccc1": "tech/wiki/guide.md",
        "dddd1": "tech/wiki/guide/deep.md", "eeee1": "tech/wiki/guide/deep/deeper.md", "ffff1": "tech/stray.md",
        "gggg1": "tech/wiki-gggg.md", "k2": "tech/wiki/setup.md", "hhhh1": "tech/loop.md", "iiii1": "tech/loop-iiii.md",
        "jjjj1": "docs/root-anyway.md",
    }
    assert assigned(spark, new, kept) == want
    random.Random(1).shuffle(new)
    assert assigned(spark, new, kept, floor=1) == want


def test_paths_are_stable(spark):
    rng = random.Random(4)
    new = [(f"{i:04x}page", f"{rng.randrange(60):04x}page" if i > 5 else "", f"Title {i % 4}", "f", i <= 5, i % 3) for i in range(60)]
    first = assigned(spark, new, [("none", None)])
    again = assigned(spark, new, list(first.items()))
    assert again == first


def test_tree_listing(spark):
    rows = [("r", "", True, True, "f", ""), ("a", "r", False, False, "f", ""), ("b", "r", False, False, "f", ""),
            ("c", "a", False, False, "f", ""), ("o", "a", False, False, "g", "")]
    edges = [("r", 1, "b"), ("r", 0, "a"), ("a", 0, "c"), ("a", 1, "o"), ("c", 0, "r"), ("a", 2, "unknown")]
    tree = hierarchy.tree_listing(
        spark.createDataFrame(rows, REGISTRY), spark.createDataFrame(edges, "parent_id STRING, position BIGINT, child_id STRING"))
    got = [(r["id"], r["depth"], r["is_last"]) for r in tree.orderBy("folder", "root_id", "sort_key").collect()]
    assert got == [("r", 0, True), ("a", 1, False), ("c", 2, True), ("b", 1, True)]


def depth_first(rows, edges):
    """Plain listing: a page once, below the first page by id that lists it in its folder."""
    table = {r[0]: r for r in rows}
    first = {}
    for parent, position, child in sorted(edges):
        if parent in table and child in table and not table[child][2] and table[parent][4] == table[child][4]:
            first.setdefault(child, (parent, position))
    kids = {}
    for child, (parent, position) in first.items():
        kids.setdefault(parent, []).append((position, child))
    out = {}
    for root in (r for r in rows if r[2]):
        todo, place = [(root[0], 0, True)], 0
        while todo:
            at, depth, last = todo.pop()
            out[at] = (root[4], root[0], depth, place, last)
            place += 1
            below = sorted(kids.get(at, []))
            todo += [(child, depth + 1, position == below[-1][0]) for position, child in reversed(below)]
    return out


def test_preorder(spark):
    for seed, floor in ((1, 10**6), (2, 5)):
        rng = random.Random(seed)
        rows = [(f"n{i}", "", i < 4, True, "f0" if i < 4 or rng.random() < 0.9 else "f1", "") for i in range(250)]
        edges, places = [], {}
        for i in range(4, 250):
            parent = "n1" if rng.random() < 0.3 else f"n{rng.randrange(i)}"
            if i % 40 == 7:
                parent = f"n{min(249, i + 3)}"  # not below a root, or late
            edges.append((parent, places.setdefault(parent, 0), f"n{i}"))
            places[parent] += rng.randrange(1, 3)
        edges += [("n9", 99, "n3"), ("n8", 99, "n30"), ("n5", 98, "lost"), ("lost", 0, "n6")]
        found = hierarchy.preorder(
            spark.createDataFrame(rows, REGISTRY), spark.createDataFrame(edges, "parent_id STRING, position BIGINT, child_id STRING"), floor=floor)
        got = {r["id"]: (r["folder"], r["root_id"], r["depth"], r["place"], r["is_last"]) for r in found.collect()}
        assert got == depth_first(rows, edges) and len(got) > 60


def test_preorder_of_a_star_and_a_chain(spark):
    n = 20_000
    star = spark.range(n).selectExpr("'n0' as parent_id", "id as position", "concat('n', id + 1) as child_id")
    chain = spark.range(n).selectExpr("concat('n', id) as parent_id", "0L as position", "concat('n', id + 1) as child_id")
    registry = spark.range(n + 1).selectExpr(
        "concat('n', id) as id", "'' as parent_id", "id = 0 as is_root", "true as enabled", "'f' as folder", "'' as file_path")
    for edges, depth in ((star, 1), (chain, n)):
        places = hierarchy.preorder(registry, edges)
        row = places.selectExpr("count(*)", "count_if(place = cast(substring(id, 2) as bigint))", "max(depth)").first()
        assert tuple(row) == (n + 1, n + 1, depth)


def plain_paths(new, kept):
    """Paths level by level, as a page can only be placed below a parent that has been."""
    clean = lambda t: "".join(c if c.isalnum() else "-" for c in t.lower()).strip("-")
    path = {i: p for i, p in kept if p}
    key = lambda p: (p.rpartition("/")[0], p.rpartition("/")[2].removesuffix(".md").lower())
    taken = {key(p) for p in path.values()}
    todo = [r for r in new if r[0] not in path]
    result = {r[0]: path[r[0]] for r in new if r[0] in path}
    while todo:
        pending = {r[0] for r in todo}
        ready = [r for r in todo if r[4] or not r[1] or r[1] in path or r[1] not in pending] or todo
        rows = []
        for i, parent, title, folder, root, priority in ready:
            below = not root and parent in path and len(ready) < len(todo) + 1 and (parent in path)
            rows.append((path[parent].removesuffix(".md") if below else folder, clean(title), priority, i))
        names, best = {}, {}
        for at, name, priority, i in sorted(rows, key=lambda r: r[2:]):
            if (at, name) not in taken:
                best.setdefault((at, name), i)
        held = taken | set(best)
        loose = [(at, name, i) for at, name, _, i in rows if best.get((at, name)) != i]
        for at, name, i in loose:
            brief = f"{name}-{i[:4]}"
            alone = sum((a, f"{m}-{j[:4]}") == (at, brief) for a, m, j in loose) == 1
            names[i] = brief if alone and (at, brief) not in held else f"{name}-{i}"
        for at, name, _, i in rows:
            result[i] = path[i] = f"{at}/{names.get(i, name)}.md"
            taken.add(key(path[i]))
        done = {r[0] for r in ready}
        todo = [r for r in todo if r[0] not in done]
    return result


def test_paths_of_many_levels(spark):
    for seed in range(3):
        rng = random.Random(seed)
        ids = [f"{rng.randrange(16**4) if i % 3 else 7:04x}{i:03d}" for i in range(160)]
        new = [(ids[i], ids[rng.randrange(max(0, i - 4), i)] if i > 6 else ("k1", "", "lost")[i % 3], f"T {rng.randrange(3)}", "f", i < 3, rng.randrange(2)) for i in range(160)]
        # kept pages below paths that new pages get, down to the third level
        kept = [("k1", "f/wiki.md"), ("k2", "f/t-0/t-1.md"), ("k3", "f/t-1/t-0/t-2.md"), ("k4", "f/t-0/t-2-0007.md"), ("k5", "f/wiki/t-1/t-0.md")]
        assert assigned(spark, new, kept) == plain_paths(new, kept)


def test_paths_of_a_long_chain(spark):
    new = [(f"{i:04d}", f"{i - 1:04d}" if i else "", "A", "f", False, 0) for i in range(1000)]
    got = assigned(spark, new, [("none", None)])
    assert all(got[f"{i:04d}"] == "f" + "/a" * (i + 1) + ".md" for i in range(1000))


def test_paths_outside_any_folder(spark):
    """A page at the top has the directory that is another page's folder."""
    new = [("aaaa1", "", "X", "", False, 0), ("bbbb1", "aaaa1", "Same", "", False, 0), ("cccc1", "", "Same", "x", False, 0), ("dddd1", "bbbb1", "Low", "", False, 0)]
    assert assigned(spark, new, [("none", None)]) == {
        "aaaa1": "x.md", "cccc1": "x/same.md", "bbbb1": "x/same-bbbb.md", "dddd1": "x/same-bbbb/low.md"}


def test_resolved_nodes_are_staged_once_and_hand_columns_on(spark, monkeypatch):
    rows = [("top", None, 1, "t"), ("a", "top", None, "x"), ("b", "a", None, "y"), ("c", "b", None, "z"), ("lost", "gone", None, "w")]
    nodes = spark.createDataFrame(rows, "id string, next_id string, payload int, mark string")
    counts = []
    monkeypatch.setattr(hierarchy, "staged", lambda df: counts.append(df.count()) or staged(df))
    found = hierarchy.resolve_pointers(nodes, keep=("mark",)).collect()
    assert sorted((r["id"], r["end_id"], r["outcome"], r["hops"], r["mark"]) for r in found) == [
        ("a", "top", "found", 1, "x"), ("b", "top", "found", 2, "y"), ("c", "top", "found", 3, "z"),
        ("lost", "gone", "dangling", 1, "w"), ("top", "top", "found", 0, "t"),
    ]
    assert counts.count(5) == 1  # all nodes are written once, what is pointed to again
    counts.clear()
    assert hierarchy.resolve_pointers(nodes, ready=True).count() == 5
    assert 5 not in counts


def test_names_are_not_judged_twice_where_no_paths_meet(spark, monkeypatch):
    monkeypatch.setattr(paths, "_losers", lambda *_: 1 / 0)
    new = spark.createDataFrame(
        [("a", "kept", "T", "f", False, 1), ("b", "a", "T", "f", False, 1), ("c", "a", "T", "f", False, 2), ("x", "y", "T", "f", False, 1),
         ("y", "x", "T", "f", False, 1)], "id string, parent_id string, title string, folder string, is_root boolean, priority bigint"
    )
    known = spark.createDataFrame([("kept", "f/kept.md")], "id string, file_path string")
    got = {r["id"]: r["file_path"] for r in paths.assign_paths(new, known).collect()}
    assert got == {"a": "f/kept/t.md", "b": "f/kept/t/t.md", "c": "f/kept/t/t-c.md", "x": "f/t.md", "y": "f/t-y.md"}


def test_anchors_of_a_plan_hold_no_wide_columns(spark):
    registry = spark.createDataFrame([("r", "", True, True, "f", "f/r.md")], REGISTRY)
    items = spark.createDataFrame([("p", "r"), ("q", "p")], "id string, parent_id string")
    fetch = maintenance.pointers_of(items)
    _, traced, anchors = maintenance._anchored(fetch, registry, items.where("id = 'q'").select("id"), "default", 500_000)
    assert "file_path" not in traced.columns and "anchor_id" not in anchors.columns
    plan = maintenance.get_plan(items, registry, items.where("id = 'q'").select("id"))
    assert sorted((r["write_order"], r["id"], r["folder"]) for r in plan.collect()) == [(0, "p", "f"), (1, "q", "f")]
