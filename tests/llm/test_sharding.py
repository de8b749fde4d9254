"""Shards: nearly equal bytes, gapless slots, equal texts together."""

import zlib
from collections import defaultdict

import pytest

from leafwork.llm import sharding

from .conftest import collected


def shards_of(docs, **options):
    rows = collected(sharding.shard_documents(docs, **options))
    by_shard = defaultdict(list)
    for row in rows:
        by_shard[row["shard"]].append(row)
    for shard in by_shard.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    return rows, by_shard


def test_sizes_are_nearly_equal(ready):
    docs = ready.range(6000).selectExpr(
        "id as doc_id", "repeat('ab ', cast(1 + pmod(xxhash64(id), 90) as int)) || id as text",
        "concat('s', if(id % 3 = 0, 0, id % 11)) as source", "if(id % 5 = 0, null, 'en') as lang",
    )
    for shards in (16, 5, 1):
        _, by_shard = shards_of(docs, shards=shards)
        sizes = [sum(r["size"] for r in s) for s in by_shard.values()]
        assert len(sizes) == shards and max(sizes) <= 1.03 * min(sizes)


def test_groups_of_copies(ready):
    docs = ready.range(3000).selectExpr(
        "id as doc_id", "case when id < 1000 then 'the hot text' else concat('text ', cast(id / 4 as int)) end as text", "'s' as source", "'en' as lang"
    )
    rows, by_shard = shards_of(docs, grain=16)
    text = {r["doc_id"]: r["text"] for r in collected(docs)}
    places = defaultdict(set)
    for row in rows:
        places[text[row["doc_id"]]].add(row["shard"])
    assert all(len(p) == 1 for t, p in places.items() if t != "the hot text")
    assert len(places["the hot text"]) > 2
    sizes = [sum(r["size"] for r in s) for s in by_shard.values()]
    assert max(sizes) <= 1.2 * min(sizes)


def test_odd_rows(odd):
    rows, _ = shards_of(odd)
    wanted = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in collected(odd))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == wanted
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


@pytest.mark.parametrize("copies", [1, 400])
def test_one_row_many_times(ready, copies):
    docs = ready.range(copies).selectExpr("1L as doc_id", "'same' as text", "'s' as source", "'en' as lang")
    rows, by_shard = shards_of(docs, grain=4)
    assert len(rows) == copies and (copies == 1 or len(by_shard) == 16)


def test_empty(nothing):
    assert sharding.shard_documents(nothing).count() == 0
