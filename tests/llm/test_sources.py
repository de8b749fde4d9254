"""Source mixing and source audit, against plain versions and SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from leafwork.llm import divergence, mixing

from .conftest import collected


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def mixed(docs, **options):
    rows = collected(mixing.mix_sources(docs, **options))
    by_source = defaultdict(list)
    for row in rows:
        by_source[row["source"]].append(row)
    return rows, by_source


def check_mix(docs, room=0.5, **options):
    rows, by_source = mixed(docs, **options)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = collected(docs)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], words(r["text"])) for r in given)
    targets = plain_targets({s: sum(r["size"] for r in part) for s, part in by_source.items()}) if rows else {}
    for source, part in by_source.items():
        assert all(r["target"] == pytest.approx(targets[source]) and r["source_size"] == sum(x["size"] for x in part) for r in part)
        ratio = targets[source] / max(1, part[0]["source_size"])
        assert all(r["taken"] == r["copies"] * r["size"] and ratio - 1 < r["copies"] < ratio + 1 or not r["size"] for r in part)
        assert abs(sum(r["taken"] for r in part) - targets[source]) <= room * max(r["size"] for r in part) + 1e-6
    return rows


def test_mix(corpus):
    first = check_mix(corpus)
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(first, key=key) == sorted(mixed(corpus.repartition(7))[0], key=key)


def test_mix_odd_rows(odd, nothing):
    check_mix(odd)
    assert mixed(nothing)[0] == []


def test_mix_hot_source_and_copies(ready):
    docs = ready.range(5000).selectExpr(
        "if(id < 300, 1L, id) as doc_id", "repeat('w ', cast(if(id < 300, 7, 1 + pmod(xxhash64(id), 200)) as int)) as text",
        "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source",
    )
    check_mix(docs)


def test_mix_keeps_expectations(ready):
    """Over many seeds every document is taken as often as its source's ratio says."""
    docs = ready.createDataFrame([(i, "w " * (3 + 5 * (i % 4)), "ab"[i % 2]) for i in range(40)], "doc_id int, text string, source string")
    taken, runs = Counter(), 3
    for seed in range(runs):
        rows, _ = mixed(docs, seed=seed, tries=1)
        taken.update({r["doc_id"]: r["copies"] for r in rows})
    ratio = {r["doc_id"]: r["target"] / r["source_size"] for r in rows}
    for part in range(2):
        ids = [i for i in ratio if i % 2 == part]
        mean = sum(taken[i] for i in ids) / len(ids) / runs
        assert mean == pytest.approx(ratio[part], abs=0.05)
        assert ratio[part] % 1 == 0 or len({taken[i] for i in ids}) > 1


@pytest.mark.parametrize("sql, run", [
    (mixing.mixing_sql(), lambda d: mixing.mix_sources(d).select("doc_id", "size", "source_size", "target", "taken")),
    (divergence.AUDIT_SQL, divergence.audit_sources),
])
def test_sql_twins(ready, corpus, sql, run):
    extra = ready.createDataFrame([(900, None, None, None, 0, 0), (901, "Grün GRÜN \U00010400 a-b", "es", None, 0, 0), (902, "", "xx", "q", 0, 0)], corpus.schema)
    docs = corpus.unionByName(extra)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype(object).where(lambda f: f.notna(), None))
    key = lambda row: tuple(map(str, row))
    wanted = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(wanted, key=key) == sorted(map(tuple, run(docs).select(names).collect()), key=key)


def plain_audit(rows, least, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        group = (r["lang"] or "", r["source"] or "")
        groups.add(group)
        n[group].update(terms)
        docs[group[0]].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t in docs[lang] if docs[lang][t] >= least]
        own = [g for g in groups if g[0] == lang]

        def share(count, kept=kept):
            under = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // under for t in kept}

        p, q = share(n[lang, source]), share(sum((n[g] for g in own), Counter()))
        pairs = [(-sum(abs(p[t] - o[t]) for t in kept), g[1]) for g in own if g[1] != source for o in [share(n[g])]]
        terms = [(q[t] - p[t], t) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < top}
    return out


def audited(docs, **options):
    rows = [tuple(r) for r in divergence.audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit(corpus):
    assert audited(corpus) == plain_audit(collected(corpus), 30, 50)
    assert audited(corpus, least_docs=3, top=4) == plain_audit(collected(corpus), 3, 4)


def test_audit_odd_rows(odd, nothing):
    assert audited(odd) == plain_audit(collected(odd), 30, 50)
    assert audited(odd, least_docs=1) == plain_audit(collected(odd), 1, 50)
    assert audited(nothing) == set()


def test_audit_many_sources(ready):
    """Sources beyond one block and terms beyond one shard."""
    docs = ready.range(600).selectExpr(
        "id as doc_id", "concat_ws(' ', transform(sequence(0, 9), i -> concat('t', char(97 + pmod(xxhash64(id, i), 26)), char(97 + pmod(xxhash64(i, id), 3))))) as text",
        "'l' as lang", "if(id % 3 = 0, 'hot', concat('s', id % 17)) as source",
    )
    assert audited(docs, least_docs=5, block=4, shard_cells=64) == plain_audit(collected(docs), 5, 50)
