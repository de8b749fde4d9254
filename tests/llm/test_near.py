"""Near-duplicate vectors and documents, against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from leafwork.llm import common, jaccard, neighbours

from .conftest import collected


def reach(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_components(ready):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(70)]
    found = {r["node"]: r["component"] for r in collected(common.components(ready.createDataFrame([*edges, (None, 5), (5, 5)], "a bigint, b bigint")))}
    wanted = reach(301, edges)
    assert found == {i: wanted[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


def test_vectors(ready):
    r = np.random.default_rng(3)
    dim = 24
    x = r.normal(size=(700, dim))
    for k in range(150):  # around the bound, and a hot group
        noise = r.normal(size=dim) * np.linalg.norm(x[k]) / np.sqrt(dim) * r.uniform(0.1, 0.7)
        x[300 + k] = x[k] + noise
    x[500:640] = x[0] + r.normal(size=(140, dim)) * 0.05
    x[650:660] = x[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [None, [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [None], [float("inf")] + [0.0] * (dim - 1), [1.0], []]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(5, x[5].tolist(), 0), (None, x[6].tolist(), 0)]
    frame = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")
    found = collected(neighbours.link_vectors(frame, exact=True))
    good = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = reach(len(good), np.argwhere(near))
    members = {k: min((good[i][0] for i in range(len(good)) if root[i] == k and good[i][0] is not None), default=None) for k in set(root)}
    wanted = [(good[i][0], int(near[i].sum()), members[root[i]]) for i in range(len(good))]
    wanted += [(i, 0, i) for i, v, _ in rows if i is not None and i >= 1000]
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=key) == sorted(wanted, key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    rough = {r["vec_id"]: r["n_links"] for r in collected(neighbours.link_vectors(frame))}
    links = {i: n for i, n, _ in wanted}
    assert sum(rough.values()) >= 0.99 * sum(links.values())
    assert all(rough[i] <= n for i, n in links.items())
    assert neighbours.link_vectors(frame.where("false")).count() == 0
    assert {r["n_links"] for r in collected(neighbours.link_vectors(frame.where("vec_id >= 1000")))} <= {0}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_sets(texts, words):
    out = []
    for text in texts:
        found = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}
        out.append(grams or ({tuple(found)} if found else set()))
    return out


def plain_components(rows, measure):
    sets = plain_sets([t for _, t in rows], measure.words)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= measure.percent * len(sets[i] | sets[j])
    ]
    root = reach(len(rows), links)
    least = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    return sorted((str(i), len(s), str(least[k])) for (i, _), s, k in zip(rows, sets, root, strict=True))


def near_texts(r, words, n, edits):
    base = [r.choice(words) + str(r.randint(0, 40)) for _ in range(n)]
    out = []
    for _ in range(edits):
        copy = list(base)
        for _ in range(r.randint(0, max(1, n // 18))):
            copy[r.randint(0, n - 1)] = "edit" + str(r.randint(0, 9))
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("measure", [jaccard.Measure(), jaccard.Measure(5, 80)])
def test_documents(ready, monkeypatch, measure, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "GROUP", 2000)
    r = random.Random(hot)
    words = ["mar", "sol", "luz", "pan", "Rio"]
    shared = " ".join(r.choice(words) + str(i) for i in range(60))  # a passage of many documents
    texts = [t for n in (3, 4, 5, 12, 30, 80, 81, 200) for t in near_texts(r, words, n, 12)]
    texts += near_texts(r, words, 60, 60)
    texts += [shared + " " + " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(r.randint(1, 60))) for _ in range(50)]
    texts += ["", None, " \n", "one", "ONE", "one", "two words"] + ["same text again and again"] * 20
    rows = list(enumerate(texts)) + [(None, texts[40]), (7, texts[7]), (7, "another text of the same id")]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in collected(jaccard.link_documents(docs, measure)))
    assert found == plain_components(rows, measure)


def test_odd_documents(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in collected(odd)]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in collected(jaccard.link_documents(odd)))
    assert found == plain_components(rows, jaccard.Measure())
    kept = jaccard.keep_one(odd)
    assert kept.schema == odd.schema
    ids = [r["doc_id"] for r in collected(kept)]
    assert ids.count(7) == 1 and {20, 21, 22} & set(ids) == {20} and {1, 2, 4, 5} <= set(ids)
    assert jaccard.link_documents(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_keep_one_judges_rows_not_ids(ready):
    r = random.Random(21)
    text = lambda: [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    near = lambda words: " ".join([*words[:-1], "changed"])
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [
        (1, " ".join(a)), (None, near(a)),  # a near copy without an id
        (None, " ".join(b)), (None, " ".join(c)),  # unique, without an id
        (3, " ".join(d)), (5, near(d)),  # 5 is a near copy of 3 and the smallest id of the next group
        (5, " ".join(e)), (8, " ".join(e)), (9, near(e)), (None, " ".join(f)), (None, near(f)),  # a group without any id
    ]
    kept = collected(jaccard.keep_one(ready.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    found = [(x["doc_id"], x["text"]) for x in kept]
    group = {(None, " ".join(f)), (None, near(f))}
    assert len([x for x in found if x in group]) == 1
    wanted = {(1, " ".join(a)), (None, " ".join(b)), (None, " ".join(c)), (3, " ".join(d)), (5, " ".join(e))}
    assert len(found) == 6 and set(found) - group == wanted


def test_short_near_copies_are_cut_by_documents(ready, monkeypatch):
    monkeypatch.setattr(jaccard, "DOCUMENTS", 40, raising=False)
    sizes, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda items, *a: sizes.append(items.groupBy("cluster").count().agg({"count": "max"}).first()[0]) or links(items, *a))
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:-1], f"last{i}"])) for i in range(300)]
    rows += [(300 + i, " ".join([*base[:6], *(f"x{k}" for k in range(i % 5)), *base[6 + i % 7 :]])) for i in range(60)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in collected(jaccard.link_documents(docs)))
    assert found == plain_components(rows, jaccard.Measure())
    assert 2 < max(sizes) <= 120


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_made_to_collide():
    """A Thue-Morse word and its complement have equal sums under any base modulo a power of two."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    one, two = common.Buffer([f"{word} {other}"]).hashes().tolist()
    assert one != two
    a, b = jaccard.gram_sets([f"{word} x y z", f"{other} x y z"], 4)
    assert a.tolist() != b.tolist()
    for n in (1, 7, 300, 70_000):  # equal words have equal hashes wherever they are
        r = random.Random(n)
        text = "".join(r.choice("abc") for _ in range(n))
        found = common.Buffer(["pad " * 3 + text, text + " tail"])
        hashed = found.hashes()
        assert hashed[3] == hashed[4] and len(set(hashed.tolist())) == 3


def test_powers():
    for n in (1, 2, 5, 1000):
        assert common.powers(12345, 2**31 - 1, n).tolist() == [pow(12345, i, 2**31 - 1) for i in range(n)]


def test_many_rows_without_an_id(ready):
    """Null and shared ids: each text is found by its set, so the work grows with the rows."""
    n = 20_000
    docs = ready.range(n).selectExpr(
        "if(id % 2 = 0, null, 5L) as doc_id",
        "concat_ws(' ', transform(sequence(0, 19), i -> concat('w', cast(pmod(xxhash64(id div 2, i), 1000000) as string))), "
        "if(id % 2 = 0, 'even', 'odd')) as text",
    )
    rows = jaccard.link_documents(docs, jaccard.Measure(4, 85)).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"], r["count"]) for r in rows) == [
        ("5", "5", 18, n // 2), ("None", "5", 18, n // 2)]
