"""Encoding, decoding and packing against the tokenizer library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwork.llm import bpe, packing
from leafwork.llm.queries import tokenizer_path

from .conftest import collected

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [5, 16, 64])
def test_tree_is_exact(library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "WINDOW", 2)
    coder, r = bpe.codec(PATH), random.Random(leaf)
    pieces = ["a", "th", "ing", " ", "  ", "\n", "é", "漢", "'s", "'", "1", "23", "!", "$$", "<|endoftext|>", "\U0001f600"]
    for _ in range(400):
        some = r.choice([pieces, pieces[:3], ["th", "e", "r", "1"], [" ", "\n", "a"]])
        text = "".join(r.choice(some) for _ in range(r.randint(0, 200)))
        whole = ids_of(library, text)
        assert coder.encode(text).tolist() == whole
        at = r.randint(0, len(text))
        assert coder.join_all([(t, coder.encode(t)) for t in (text[:at], text[at:])]).tolist() == whole
        assert coder.decode(coder.encode(text)) == library.decode(whole, skip_special_tokens=False)


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_documents_encode_and_decode(odd, library, block):
    encoded = bpe.encode_documents(odd, PATH, ("doc_id", "n_chars", "score"), block=block)
    decoded = bpe.decode_documents(encoded, PATH, ("doc_id", "ids"))
    found = sorted((str(r["doc_id"]), bytes(r["ids"] or b""), r["text"]) for r in collected(decoded))
    wanted = sorted(
        (str(r["doc_id"]), np.array(ids_of(library, r["text"]), "<u4").tobytes(), r["text"] or "") for r in collected(odd)
    )
    assert found == wanted


def test_empty_table(nothing):
    assert bpe.encode_documents(nothing, PATH).count() == 0
    assert packing.pack_documents(nothing, PATH).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 5.0, "c": 0.0}])
def test_packing_holds_every_token_once(odd, library, weights):
    rows = collected(packing.pack_documents(odd, PATH, size=64, window_sequences=4, weights=weights))
    texts = defaultdict(list)
    for row in collected(odd):
        texts[row["doc_id"]].append(np.array([*ids_of(library, row["text"]), 0], "<u4"))
    places, pieces = [], defaultdict(int)
    for row in rows:
        options = [t for t in texts[row["doc_id"]] if len(t) == row["doc_tokens"]]
        part = {zlib.crc32(t[row["start"] : row["start"] + row["length"]].tobytes()) for t in options}
        assert row["ids_crc32"] in part
        assert row["offset"] + row["length"] <= 64
        places += [row["sequence_id"] * 64 + row["offset"] + k for k in range(row["length"])]
        pieces[row["doc_id"]] += row["length"]
    assert sorted(places) == list(range(sum(len(t) for ts in texts.values() for t in ts)))
    assert all(pieces[d] == sum(map(len, ts)) for d, ts in texts.items())


def test_windows_keep_the_proportions():
    totals, r = {0: 100_000, 1: 30_000, 2: 7}, random.Random(2)
    phases = packing.plan_phases(totals, None, 1000)
    ranges = []
    for queue, n in totals.items():
        at = 0
        while at < n:
            size = min(n - at, r.randint(1, 900))
            ranges.append((queue, at, size))
            at += size
    queue, start, length = (np.array(x) for x in zip(*ranges, strict=True))
    row, _, n, at = packing.place(phases, queue, start, length, 250)
    share = np.zeros((3, -(-sum(totals.values()) // 1000)))
    for q, k, a in zip(queue[row], n, at, strict=True):
        for token in range(a, a + k):
            share[q, token // 1000] += 1
    assert abs(share[0, :-1] - 1000 * 100_000 / 130_007).max() <= 10  # windows are a little shorter than 1000
    assert share.sum(axis=1).tolist() == [100_000, 30_000, 7]


def test_weights_and_dry_queues():
    phases = packing.plan_phases({0: 1000, 1: 1000, 2: 50}, {0: 3.0, 1: 1.0}, 100)
    assert [p.amount.tolist() for p in phases] == [[1000, 333, 0], [0, 667, 0], [0, 0, 50]]


def test_many_sources_share_queues(ready, library):
    docs = ready.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.col("id").cast("string").alias("source"))
    rows = collected(packing.pack_documents(docs, PATH, size=16, window_sequences=2, max_queues=8))
    assert {r["queue"] for r in rows} <= set(range(8))
    places = sorted(r["sequence_id"] * 16 + r["offset"] + k for r in rows for k in range(r["length"]))
    assert places == list(range(sum(len(ids_of(library, f"word {i}")) + 1 for i in range(200))))


@pytest.mark.parametrize("named", [{"3": 3.0, "7": 1.0}, {None: 3.0, "7": 1.0}])
def test_many_sources_keep_their_weights(ready, named):
    first = next(iter(named))
    texts = [(s, f"word {i}") for s in [str(k) for k in range(20)] + [None] for i in range(30)]
    docs = ready.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = collected(packing.pack_documents(docs, PATH, size=16, window_sequences=2, max_queues=8, weights=named))
    given, others = defaultdict(int), []
    for x in rows:
        source, at = texts[x["doc_id"]][0], x["sequence_id"] * 16 + x["offset"]
        if at < 32:
            given[source] += x["length"]
        if source not in named:
            others.append(at)
    total = {s: sum(x["length"] for x in rows if texts[x["doc_id"]][0] == s) for s in named}
    assert set(given) == set(named) and abs(given[first] - 24) <= 1
    assert min(others) == sum(total.values())


def test_digest_query(ready, library, tmp_path):
    from leafwork.llm.queries import QUERIES

    ready.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in collected(QUERIES["op9_bpe_tree"](ready, str(tmp_path)))}
    ids = np.array(ids_of(library, "some text"), "<u4").tobytes()
    assert rows[1]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and rows[1]["n_tokens"] * 4 == len(ids)
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
