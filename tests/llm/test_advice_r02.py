"""Cases of the second round's advice: caps that must not change results."""

import numpy as np

from tessera.llm import ann, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_keeps_its_verdicts_on_a_small_sample(spark, monkeypatch):
    """With as many clean as toxic documents sampled the shares are still those of all documents."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    whole = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MOST_EACH", 40)
    few = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    clean = [i for i in few if toxic.get(i) == 0]
    assert abs(np.mean([few[i].score for i in clean]) - np.mean([whole[i].score for i in clean])) < 0.02
    assert np.mean([few[i].predicted for i in clean]) < 0.01
    assert np.mean([few[i].predicted == whole[i].predicted for i in few]) > 0.99


def test_neighbours_come_in_rounds(spark, monkeypatch):
    """Rounds of few queries find the same neighbours, and no row of the index is copied for them."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 300")
    whole = sorted(map(tuple, ann.nearest(rows, k=3, cells=2).collect()))
    monkeypatch.setattr(ann, "ASKED", 20 * 64)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 7)
    assert sorted(map(tuple, ann.nearest(rows, k=3, cells=2).collect())) == whole
    v = {r.vec_id: np.array(r.embedding, float) for r in rows.select("vec_id", "embedding").collect()}
    for q in list(v)[:20]:
        near = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q)[:3]
        assert [i for _, i in near] == [r[2] for r in whole if r[0] == q]


def test_classifier_trusts_all_trusted_documents(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "MOST_TRUSTED", 30, raising=False)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in labels.filter("quality = 1").collect()}
    got = quality_classifier.classify(docs, labels)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["trusted", "log_perplexity", "lower", "upper", "kept"]
    assert {r.doc_id for r in got.filter("trusted").collect()} == want
