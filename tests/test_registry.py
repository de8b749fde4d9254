"""The record index on disk, legacy layouts, reindexing, diffs and attachments."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.operators import attachments, diff, registry, reindex
from leafwork.operators.paths import assign_paths
from leafwork.sources import documents, index

T0 = datetime(2024, 1, 15, 10, 30)
ID = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
DASHED = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"


def record(id_, **fields):
    row = dict(id=id_, type="page", folder="tech", file_path=f"tech/{id_}.md", title="T", last_edited=T0, last_synced=T0,
               is_root=False, enabled=False, parent_id="", children=None, content_hash=None)
    row.update(fields)
    return tuple(row.values())


def records(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.REGISTRY)


def ids_frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id STRING")


def lines(folder):
    return {p.parent.name: p.read_text() for p in folder.glob("shard=*/part-*")}


def test_canonical_line(spark):
    row = records(spark, record("ab1", title='a <b> & "c" ', children=["x"], enabled=True, is_root=True, parent_id="p",
                                content_hash="h", last_edited=datetime(2024, 1, 15, 10, 30, 0, 120000)))
    line = registry.index_lines(row).first()["line"]
    assert line == (
        '{"children":["x"],"content_hash":"h","enabled":true,"file_path":"tech/ab1.md","folder":"tech","id":"ab1",'
        '"is_root":true,"last_edited":"2024-01-15T10:30:00.12Z","last_synced":"2024-01-15T10:30:00Z","parent_id":"p",'
        '"title":"a \\u003cb\\u003e \\u0026 \\"c\\"\\u2028","type":"page"}')
    fields = list(json.loads(line))
    assert fields == sorted(fields)
    bare = json.loads(registry.index_lines(records(spark, record("ab1"))).first()["line"])
    assert not {"children", "content_hash", "enabled", "parent_id"} & set(bare)


def test_index_rewrites_only_touched_shards(spark, tmp_path):
    path = str(tmp_path / "index")
    none = ids_frame(spark)
    first = records(spark, record("aa2"), record("aa1"), record("bb1"), record("cc1"))
    assert index.write_index(first, none, path) == ["aa", "bb", "cc"]
    assert [json.loads(x)["id"] for x in lines(tmp_path / "index")["shard=aa"].splitlines()] == ["aa1", "aa2"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").glob("shard=bb/part-*")}
    changed = index.write_index(records(spark, record("aa1", title="new")), ids_frame(spark, "cc1"), path)
    assert changed == ["aa", "cc"]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "index").glob("shard=bb/part-*")}
    assert not (tmp_path / "index" / "shard=cc").exists()
    got = {r["id"]: (r["title"], r["last_edited"]) for r in index.read_index(spark, path).collect()}
    assert got == {"aa1": ("new", T0), "aa2": ("T", T0), "bb1": ("T", T0)}
    assert [r["id"] for r in index.point_lookup(spark, path, ["bb1", "zz"]).collect()] == ["bb1"]
    plan = index.read_index(spark, path, ["bb"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters:")[1].split("]")[0]
    # writing the same records again leaves the same text
    same = lines(tmp_path / "index")
    index.write_index(index.read_index(spark, path), none, path)
    assert lines(tmp_path / "index") == same


def test_manifest_is_written_once(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert index.write_manifest(spark, path) and not index.write_manifest(spark, path)


def write_legacy(folder):
    folder.mkdir()
    page = dict(type="page", folder="tech", title="x", file_path="tech/x.md")
    contents = {
        f"{ID}.json": {**page, "id": ID, "title": "bare"},
        f"page-{DASHED}.json": {**page, "id": DASHED, "title": "dashed", "parent_id": DASHED},
        f"page-{ID}.json": {**page, "id": DASHED, "title": "normal"},
        "page-broken.json": {"title": "no id"},
        "file-abc123.json": {"id": "abc123", "file_path": "a.png", "source_url": "https://s3/a.png?X-Amz-Signature=1"},
        "user-u1.json": {"id": "u1", "name": "U"},
        "manifest.json": {"schema_version": 1},
        "other.json": {"id": "zzz"},
    }
    for name, content in contents.items():
        (folder / name).write_text(json.dumps(content, indent=2))


def test_legacy_layouts(spark, tmp_path):
    write_legacy(tmp_path / "ids")
    legacy = index.read_legacy(spark, str(tmp_path / "ids"))
    pages = registry.absorbed(legacy, "page", ["id", "title", "parent_id"]).collect()
    assert [(r["id"], r["title"]) for r in pages] == [(ID, "normal")]
    files = registry.absorbed(legacy, "file", ["id", "source_url"]).collect()
    assert [(r["id"], r["source_url"]) for r in files] == [("abc123", "https://s3/a.png")]
    assert registry.absorbed(legacy, "user", ["id", "name"]).count() == 1
    counts = {r["kind"]: (r["files"], r["records"]) for r in registry.compaction_counters(legacy).collect()}
    assert counts == {"page": (3, 1), "file": (1, 1), "user": (1, 1)}
    stored = records(spark, record(ID, title="stored"), record("ff1"))
    listed = registry.listed_registry(stored, legacy, ids_frame(spark))
    assert {r["id"]: r["title"] for r in listed.collect()} == {ID: "stored", "ff1": "T"}
    alone = registry.listed_registry(records(spark, record("ff1")), legacy, ids_frame(spark))
    assert {r["id"]: r["title"] for r in alone.collect()} == {ID: "dashed", "ff1": "T"}
    gone = registry.listed_registry(records(spark, record("ff1")), legacy, ids_frame(spark, ID))
    assert [r["id"] for r in gone.collect()] == ["ff1"]
    merged = registry.compact(stored, legacy, "page")
    assert {r["id"]: r["title"] for r in merged.collect()} == {ID: "normal", "ff1": "T"}


def test_overlay(spark):
    stored = records(spark, record("a", title="s"), record("b", title="s"), record("c", title="s"))
    after = registry.overlay(stored, records(spark, record("b", title="p"), record("d", title="p")), ids_frame(spark, "c", "d"))
    assert {r["id"]: r["title"] for r in after.collect()} == {"a": "s", "b": "p"}


HEAD = f"---\nnotion_id: {DASHED}\ntitle: \"x\"\nnotion_type: page\nnotion_folder: tech\n"


def parse(spark, *files):
    rows = reindex.parse_documents(spark.createDataFrame(list(files), "path STRING, value STRING")).collect()
    return {r["path"]: r for r in rows}


def test_parse_documents(spark):
    got = parse(
        spark,
        ("a.md", HEAD + "last_edited: 2024-01-02T03:04:05+01:00\nlast_edited: garbage\nis_root: true\nfile_path: tech/a.md\n"
                        f"file_path:\nproperties:\n  notion_folder: inner\n  nokey\nnotion_parent_id: {DASHED}\n---\n\n  ##  Deep Title \ntext"),
        ("b/c.md", HEAD + "---\nno heading\n# later"),
        ("d.md", "no header\n\n"), ("e.md", "---\nopen\nnever closed"), ("f.md", "---\n---"), ("g.md", "---\n---\n"),
        ("h.md", HEAD + "---"), ("i.md", "---\r\nnotion_id: x\r\n---\r\n"), ("j.md", HEAD + "---\n\n \t\n　#Wide　\n"),
    )
    a = got["a.md"]
    assert (a["id"], a["folder"], a["file_path"], a["title"], a["is_root"], a["parent_id"]) == (ID, "inner", "tech/a.md", "Deep Title", True, ID)
    assert a["last_edited"] == datetime(2024, 1, 2, 2, 4, 5) and a["reject"] is None
    assert (got["b/c.md"]["title"], got["b/c.md"]["file_path"], got["b/c.md"]["last_edited"]) == ("c", "b/c.md", None)
    assert [got[k]["reject"] for k in ("d.md", "e.md", "f.md", "g.md", "h.md", "i.md")] == [
        "no_header", "header_not_closed", "no_header", "no_id", None, "no_header"]
    assert got["j.md"]["title"] == "Wide"


def test_latest_and_duplicates(spark):
    def doc(id_, edited, path=""):
        field = f"file_path: {path}\n" if path else ""
        return f"---\nnotion_id: {id_}\nlast_edited: {edited}\n{field}---\nx"

    parsed = reindex.parse_documents(spark.createDataFrame(
        [("a.md", doc("1", "2024-01-01T00:00:00Z")), ("b.md", doc("1", "2024-01-02T00:00:00Z")), ("c.md", doc("1", "2024-01-02T00:00:00Z")),
         ("d.md", doc("2", "bad")), ("e.md", doc("2", "bad")), ("f.md", doc("3", "2024-01-01T00:00:00Z")),
         ("g.md", doc("4", "2024-01-01T00:00:00Z", "elsewhere.md")), ("h.md", doc("4", "2023-01-01T00:00:00Z"))],
        "path STRING, value STRING"))
    assert {r["id"]: r["file_path"] for r in reindex.latest_records(parsed).collect()} == {
        "1": "b.md", "2": "d.md", "3": "f.md", "4": "elsewhere.md"}
    assert {r["path"] for r in reindex.duplicate_files(parsed).collect()} == {"a.md", "c.md", "e.md", "g.md", "h.md"}


def test_corpus_and_export(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("tech/a.md", "tech/.hidden/b.md", ".state/c.md", "tech/d.txt", "x y/é+.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    found = {r["path"]: r["value"] for r in documents.read_corpus(spark, str(root)).collect()}
    assert found == {"tech/a.md": "tech/a.md", "x y/é+.md": "x y/é+.md"}
    out = tmp_path / "out"
    rows = [("p", "a/b.md", 0, "one\r\n"), ("p", "a/b.md", 1, "two"), ("q", "c.md", 0, "é")]
    documents.write_documents(spark.createDataFrame(rows, "page_id STRING, file_path STRING, part_no BIGINT, content STRING"), str(out))
    assert {str(p.relative_to(out)): p.read_bytes().decode() for p in out.rglob("*.md")} == {
        "a/b.md": "one\r\n", "a/b.part1.md": "two", "c.md": "é"}


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    state = documents.read_state(spark, path)
    assert state.first()["version"] == 3 and state.first()["last_pull_time"] is None
    documents.write_state(state.withColumn("folders", F.array(F.lit("tech"))), path)
    again = documents.read_state(spark, path)
    documents.write_state(again.withColumn("last_pull_time", F.lit(T0)), path)
    row = documents.read_state(spark, path).first()
    assert row["folders"] == ["tech"] and row["last_pull_time"] == T0


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path STRING, content_hash STRING")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), (".notion-sync/queue/1.json", "9")], "path STRING, content_hash STRING")
    got = {r["path"]: (r["change"], r["is_queue"]) for r in diff.diff_documents(old, new).collect()}
    assert got == {"a": ("deleted", False), "b": ("unchanged", False), "c": ("modified", False),
                   ".notion-sync/queue/1.json": ("new", True)}
    assert {c for c, _ in {r["path"]: (r["change"], 0) for r in diff.diff_documents(old, old).collect()}.values()} == {"unchanged"}


def hosted(file_id, name, sig="1"):
    return f"https://b.s3.eu.amazonaws.com/ws/{file_id}/{name}?sig={sig}"


def test_attachments(spark):
    links = [
        ("p1", "tech/a.md", 0, hosted("f1", "Shot.PNG")), ("p1", "tech/a.md", 1, hosted("f2", "shot.png")),
        ("p2", "tech/b.md", 0, hosted("f1", "Shot.PNG", "2")), ("p1", "tech/a.md", 2, "https://example.com/x.png"),
        ("p1", "tech/a.md", 3, hosted("f3", "big.bin")), ("p1", "tech/a.md", 4, hosted("f4", "old.png")),
        ("p1", "tech/a.md", 5, hosted("f5", "taken.png")), ("p1", "tech/a.md", 6, hosted("f6", "mine.png")),
    ]
    frame = spark.createDataFrame(links, "page_id STRING, page_path STRING, position INT, url STRING")
    files = spark.createDataFrame([("f4", "docs/old/files/old.png")], "id STRING, file_path STRING")
    manifests = spark.createDataFrame(
        [("tech/a/files/taken.png.meta.json", "zz"), ("tech/a/files/mine.png.meta.json", "f6")], "path STRING, file_id STRING")
    sizes = spark.createDataFrame([("f3", 512 * 1024 + 1), ("f1", 512 * 1024), ("f4", 10**9)], "file_id STRING, size BIGINT")
    linked = attachments.attachment_links(frame)
    placed = attachments.with_sizes(attachments.place_files(linked, files, manifests), sizes)
    got = {r["file_id"]: (r["file_path"], r["is_new"], r["too_large"]) for r in placed.collect()}
    assert got == {
        "f1": ("tech/a/files/shot.png", True, False), "f2": ("tech/a/files/shot-f2.png", True, False),
        "f3": ("tech/a/files/big.bin", True, True), "f4": ("docs/old/files/old.png", False, False),
        "f5": ("tech/a/files/taken-f5.png", True, False), "f6": ("tech/a/files/mine.png", False, False)}
    for floor in (10**6, 1):
        shown = {(r["page_id"], r["position"]): r["shown"] for r in attachments.resolve_links(linked, placed, floor=floor).collect()}
        assert shown[("p1", 0)] == "a/files/shot.png" and shown[("p2", 0)] == "a/files/shot.png"
        assert shown[("p1", 2)] == "https://example.com/x.png" and shown[("p1", 3)] == hosted("f3", "big.bin")
        assert shown[("p1", 4)] == "../docs/old/files/old.png"
    stored, sidecars = attachments.file_records(placed, F.lit(T0))
    assert {r["id"]: r["source_url"] for r in stored.collect()} == {
        i: hosted(i, n).split("?")[0] for i, n in (("f1", "Shot.PNG"), ("f2", "shot.png"), ("f5", "taken.png"))}
    assert "tech/a/files/shot.png.meta.json" in {r["path"] for r in sidecars.collect()}


def test_second_attachment_run_reads_the_first(spark):
    same = [("aaaa1", "x.png"), ("aaaa2", "x.png"), ("aaaa3", "x.png"), ("bbbb1", "x.png"), ("cccc1", "held.png")]
    links = [("p1", "tech/a.md", i, hosted(f, n)) for i, (f, n) in enumerate(same)]
    frame = spark.createDataFrame(links, "page_id STRING, page_path STRING, position INT, url STRING")
    linked = attachments.attachment_links(frame)
    # a registered file without a sidecar occupies its path too
    files = spark.createDataFrame([("zz", "tech/a/files/held.png")], "id STRING, file_path STRING")
    nothing = spark.createDataFrame([], "path STRING, file_id STRING")
    sizes = spark.createDataFrame([], "file_id STRING, size BIGINT")
    first = attachments.with_sizes(attachments.place_files(linked, files, nothing), sizes)
    paths = {r["file_id"]: r["file_path"] for r in first.collect()}
    assert paths == {
        "aaaa1": "tech/a/files/x.png", "aaaa2": "tech/a/files/x-aaaa2.png", "aaaa3": "tech/a/files/x-aaaa3.png",
        "bbbb1": "tech/a/files/x-bbbb.png", "cccc1": "tech/a/files/held-cccc.png"}
    _, sidecars = attachments.file_records(first, F.lit(T0))
    again = attachments.place_files(linked, files, sidecars).collect()
    assert {r["file_id"]: r["file_path"] for r in again} == paths and not any(r["is_new"] for r in again)


def test_suffixes_are_alone(spark):
    schema = "id STRING, parent_id STRING, title STRING, folder STRING, is_root BOOLEAN, priority BIGINT"
    same = [f"abcd{i:04d}" for i in range(5)] + ["ffff0000"]
    new = spark.createDataFrame([(i, "", "Same title", "docs", True, n) for n, i in enumerate(same)], schema)
    taken = spark.createDataFrame([("old", "docs/same-title-ffff.md")], "id STRING, file_path STRING")
    got = {r["id"]: r["file_path"] for r in assign_paths(new, taken).collect()}
    assert got["abcd0000"] == "docs/same-title.md"
    assert all(got[i] == f"docs/same-title-{i}.md" for i in same[1:])
    free = {r["id"]: r["file_path"] for r in assign_paths(new.where("id in ('abcd0000', 'ffff0000')"), taken.where("false")).collect()}
    assert free == {"abcd0000": "docs/same-title.md", "ffff0000": "docs/same-title-ffff.md"}


def test_child_edges(spark, tmp_path):
    path = str(tmp_path / "children")
    edges = spark.createDataFrame([("aa1", 0, "x"), ("aa1", 1, "y"), ("bb1", 0, "z")], schemas.CHILDREN)
    assert index.write_children(edges, ids_frame(spark, "aa1", "bb1"), path) == ["aa", "bb"]
    assert index.write_children(edges.where("false"), ids_frame(spark, "bb1"), path) == ["bb"]
    assert index.write_children(spark.createDataFrame([("aa2", 0, "w")], schemas.CHILDREN), ids_frame(spark, "aa2"), path) == ["aa"]
    kept = {(r["parent_id"], r["position"], r["child_id"]) for r in index.read_children(spark, path).collect()}
    assert kept == {("aa1", 0, "x"), ("aa1", 1, "y"), ("aa2", 0, "w")}
