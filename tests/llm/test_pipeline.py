"""The pipeline against a brute-force version of its stages."""

import hashlib
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, quality_rules, queries
from tests.llm.test_operators import DOCS, brute_components, brute_fingerprint, edge_rows
from tests.llm.test_parts import brute_cover

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(table, keep_text=False).filter("kept").collect()}  # tested by itself
    rows = sorted((r.doc_id, r.text, r.source) for r in table.collect() if r.doc_id in kept)
    groups = brute_components([brute_fingerprint(t) for _, t, _ in rows])
    first = {}
    for k, g in enumerate(groups):
        first.setdefault(g, k)
    rows = [rows[k] for k in sorted(first.values())]
    assert 0 < len(rows) < len(kept) < table.count()
    cover = brute_cover([t.encode() for _, t, _ in rows], 200)
    texts = [bytes(np.frombuffer(t.encode(), np.uint8)[~c]).decode("utf-8", "ignore") for (_, t, _), c in zip(rows, cover)]
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    names = sorted({s for _, _, s in rows})
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    target, open_ = {}, set(names)
    while True:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not over:
            break
        target.update({s: 2.0 * total[s] for s in over})
        open_ -= over
    target.update({s: weight[s] * level for s in open_})
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for (i, _, s), text in zip(rows, texts):
        rate = target[s] / total[s] if total[s] else 0
        draw = int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
        ids = t.encode(text, add_special_tokens=False).ids
        one = (i, s, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [one] * (int(rate) + (draw < rate - int(rate)))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_hold_odd_rows(spark):
    for rows in (edge_rows(), []):
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", kept int, row string")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * len(rows)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == corpus_pipeline.COLUMNS
                assert out.schema.simpleString() == docs.select(*corpus_pipeline.COLUMNS).schema.simpleString()
