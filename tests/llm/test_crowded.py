"""Windows of crowded anchors against brute force; the pipeline's first stage and true characters (round 3)."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tests.llm.test_parts import brute_cover


def near_copies(n, seed=8):
    """Texts around one passage: each changes some of its letters, repeats itself, or has a copy; others have none of it."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdé ", k=k))
    passage = letters(700)
    rows = []
    for i in range(n):
        text = list(passage)
        for at in rng.sample(range(len(text)), rng.randrange(4)):
            text[at] = rng.choice("xyz")
        rows.append((i, letters(rng.randrange(300)) + "".join(text) + letters(rng.randrange(300))))
    rows += [(n, "ab" * 300 + passage + "ab" * 300), (n + 1, rows[0][1]), (n + 2, rows[1][1] + "!"), (n + 3, letters(900)), (n + 4, None), (n + 5, "")]
    return [*rows, rows[2]]  # a repeated row


@pytest.mark.parametrize("most", [0, 5, 40])
def test_crowded_windows_equal_brute_force_in_runs(spark, monkeypatch, most):
    """Crowded windows are found without a row for each of them: no join by bucket, and a segment
    gives its runs of repeated windows, not a span for each window."""
    rows = near_copies(80)
    texts = [(t or "").encode() for _, t in rows]
    made, true = [], suffix_dedup.crowded_spans

    def watched(*args):
        spans = true(*args)
        made.append([(r["row"], r["from"], r["to"]) for r in spans.collect()])
        return spans

    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "crowded_spans", watched)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, len(t), int(c.sum()), bytes(np.frombuffer(t, np.uint8)[~c])) for (i, _), t, c in zip(rows, texts, brute_cover(texts, 200))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)
    assert 0 < len(made[0]) < 80 * 20 < sum(b - a - 199 for _, a, b in made[0])


def test_no_crowd_has_windows_alone_only(spark, monkeypatch):
    """Anchors that are crowded by texts without one repeated window give nothing."""
    rng = random.Random(3)
    gram = "the same thirty-two bytes of all "
    rows = [(i, "".join(rng.choices("abcdefgh", k=190)) + gram + "".join(rng.choices("abcdefgh", k=190))) for i in range(30)]
    monkeypatch.setattr(suffix_dedup, "MOST", 0)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0] * 30


def test_pipelines_quality_stage_tells_characters_apart(spark):
    """A text that the 64 classes of characters took for like the others: other digits, capitals and letters."""
    rng = random.Random(4)
    words = ["In", "1918", "Ada", "met", "Bob", "漢字", "at", "Rome", "and", "1980", "was", "kind", "to", "her"]
    usual = [" ".join(rng.choices(words, k=120)) for _ in range(60)]
    odd = usual[0].translate(str.maketrans("1980ABIR漢字", "2765XQZW" + "".join(chr(ord(c) + 23) for c in "漢字")))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*usual, odd])]
    kept = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id for r in kept.collect()} == set(range(60))
