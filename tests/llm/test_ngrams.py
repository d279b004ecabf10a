"""N-grams of true characters against a plain Kneser-Ney model; findings F5, F6, F7 of round 3."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngrams, quality_classifier, quality_rules

ORDER = ngrams.ORDER


def grams_of(text):
    padded = ngrams.EDGE + text
    return [padded[k:k + ORDER] for k in range(len(text))]


def plain_model(learned, seen):
    """Logarithm of the probability of the n-grams of ``seen`` after ``learned`` (lists of texts)."""
    tables = {ORDER: Counter(g for t in learned for g in grams_of(t))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    symbols = {g[-1] for t in seen for g in grams_of(t)}

    def d(n):
        c = [0] + [sum(v == k for v in tables[n].values()) for k in (1, 2, 3, 4)]
        out = [0, .5, .5, .5]
        if c[1] and c[2]:
            y = c[1] / (c[1] + 2 * c[2])
            for k in (1, 2, 3):
                if c[k] and c[k + 1]:
                    out[k] = min(max(k - (k + 1) * y * c[k + 1] / c[k], .01), k - .01)
        return out
    ds = {n: d(n) for n in tables}

    def p(g):
        n = len(g)
        if not n:
            return 1 / len(symbols)
        same = [v for k, v in tables[n].items() if k[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        v = tables[n].get(g, 0)
        return (v - ds[n][min(v, 3)]) / sum(same) + sum(ds[n][min(x, 3)] for x in same) / sum(same) * p(g[1:])
    return lambda g: math.log(p(g))


def some_texts(seed, n=30):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcXY 12é漢字😀.", k=rng.randint(0, 40))) for _ in range(n)]


def perplexities(of, texts):
    return [None if not t else -sum(map(of, grams_of(t))) / len(t) for t in texts]


@pytest.mark.parametrize("most", [1 << 22, 60])
def test_perplexity_equals_plain_kneser_ney_however_few_n_grams_are_placed(spark, monkeypatch, most):
    monkeypatch.setattr(ngrams, "PLACED", most)
    monkeypatch.setattr(ngrams, "HELD", 50)
    texts = some_texts(1) + ["", "abcXY abcXY", "abcXY abcXY"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(0, None, None)], "doc_id long, text string, lang string").repartition(3)
    want = dict(enumerate(perplexities(plain_model([*texts, ""], texts), texts)))
    got = [r for r in quality_rules.judge(docs).collect()]
    assert len(got) == len(texts) + 1 and {r.text for r in got if r.text} == {t for t in texts if t}
    for r in got:
        if r.text:
            assert math.isclose(r.log_perplexity, want[r.doc_id], rel_tol=1e-5)
        else:
            assert r.log_perplexity is None and not r.kept
    trusted = list(range(0, len(texts), 3))
    labels = spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")
    of = plain_model([texts[i] for i in trusted], texts)
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.log_perplexity is not None:
            assert math.isclose(r.log_perplexity, perplexities(of, [texts[r.doc_id]])[0], rel_tol=1e-5)


def test_n_grams_are_true_characters(spark):
    texts = ["ab1 Z漢字é", "ab2 Y文学ü", "", "ab1 Z漢字é"]
    keys, at, code, bounds = ngrams.keys_of(texts)
    assert (np.diff(bounds) == [len(t) for t in texts]).all()
    grams = [g for t in texts for g in grams_of(t)]
    assert len(set(zip(keys.tolist(), grams))) == len(set(grams)) == len(set(keys.tolist()))
    assert ["".join(map(chr, code[a:a + ORDER])) for a in at] == grams
    got = ngrams.count_grams(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")).collect()
    assert {r.gram: r.n for r in got} == Counter(grams) and len(got) == len(set(grams))


def test_capitals_digits_and_scripts_are_told_apart(spark):
    """Texts that the 64 classes of characters took for equal: other digits, capitals and letters."""
    usual = "In 1918 Ada met Bob 漢字 at Rome, and 1918 was kind to Ada. " * 8
    odd = usual.translate(str.maketrans("1980ABIR漢字", "2765XQZW" + "".join(chr(ord(c) + 23) for c in "漢字")))
    docs = spark.createDataFrame([(i, usual + " " + "abcd"[i % 4], "en") for i in range(40)] + [(99, odd + " a", "en")],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, keep_text=False).collect()}
    assert got[99].log_perplexity > max(r.log_perplexity for i, r in got.items() if i != 99) + 0.02
    scored = quality_classifier.classify(docs, docs.filter("doc_id < 40").select("doc_id", F.lit(1).alias("quality")))
    got = {r.doc_id: r for r in scored.collect()}
    assert got[99].log_perplexity > max(r.log_perplexity for i, r in got.items() if i != 99) + 0.02 and not got[99].kept
