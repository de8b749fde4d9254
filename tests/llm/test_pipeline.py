"""The pipeline's stages and its whole, against what each has to keep."""

import corpus_pipeline
from leafwork.session import staged

from .conftest import collected
from .test_near import plain_sets


def test_stages(ready, corpus, tmp_path):
    folder = str(tmp_path)
    docs = corpus.drop("toxic")
    junk = [(900, "same words " * 60, "no", "s0", 0), (901, "too short", "es", "s1", 0), (902, None, None, None, None), (None, "", "no", "s0", 0)]
    mail = docs.where("doc_id = 9").selectExpr("903L as doc_id", "concat(array_join(reverse(split(text, ' ')), ' '), ' write to some.one@mail.example for more') as text", "lang", "source", "n_chars")
    docs = docs.unionByName(ready.createDataFrame(junk, docs.schema)).unionByName(mail)
    docs.write.parquet(f"{folder}/documents.parquet")
    corpus.select("doc_id", "toxic").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    step = ready.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = staged(stage(ready, step, folder))
        assert step.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in collected(step)}
    toxic = {r["doc_id"] for r in collected(corpus.where("toxic = 1 and doc_id < 400"))}
    everything = {r["doc_id"] for r in collected(docs)}
    assert set(kept["toxicity"]) == everything - toxic
    assert set(kept["quality rules"]) == set(kept["toxicity"]) - {900, 901, 902, None}
    texts = {i: r["text"] for i, r in kept["quality rules"].items()}
    names = sorted(texts)
    sets = dict(zip(names, plain_sets([texts[i] for i in names], 5), strict=True))
    gone = set(names) - set(kept["n-gram Jaccard join"])
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert gone and all(any(near(i, j) for j in names if j < i) for i in gone)
    left = sorted(kept["n-gram Jaccard join"])
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert "[EMAIL]" in kept["PII"][903]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["PII"].values())
    packed = collected(corpus_pipeline.STAGES[-1][1](ready, step, folder))
    assert {r["doc_id"] for r in packed} == set(kept["PII"])
    assert sorted(packed, key=str) == sorted(collected(corpus_pipeline.run(ready, folder)), key=str)


def test_empty_tables(ready, nothing, tmp_path):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ready.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(ready, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
