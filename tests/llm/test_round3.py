"""Phrase collocations, line dedup and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_in_middle, line_dedup, phrases
from tests.llm.test_operators import documents, edge, edge_rows

DOCS = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- phrases

def brute_phrases(rows, most=2000, least=30, longest=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] >= share * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def invented(n=400, seed=5):
    """Texts over a small vocabulary with planted phrases, so that all lengths have candidates."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "N\0l"]
    planted = ["new York City", "as well as the", "in spite of", "São Paulo"]
    rows = []
    for i in range(n):
        words = [rng.choice(planted) if rng.random() < 0.15 else vocabulary[min(int(rng.expovariate(0.08)), 62)] for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("most,first", [(2000, 2), (7, 2), (3, 1)])
def test_phrases_equal_brute_force(spark, monkeypatch, most, first):
    """With few wanted, several waves are needed, and the frontier leaves phrases unexpanded."""
    monkeypatch.setattr(phrases, "FIRST_WAVE", first)
    monkeypatch.setattr(phrases, "NEXT_WAVE", 3)
    monkeypatch.setattr(phrases, "STEP", 7)
    rows = invented()
    got = mined(spark.createDataFrame(rows, DOCS), most=most, least=4)
    want = brute_phrases([(lang, t) for _, t, lang in rows], most=most, least=4)
    assert got == want
    assert {len(p.split()) for _, _, p, *_ in brute_phrases([(lang, t) for _, t, lang in rows], least=4)} == {2, 3, 4}


def test_phrases_longer_than_four_words(spark):
    rows = invented(200, 8)
    got = mined(spark.createDataFrame(rows, DOCS), least=3, longest=6, share=90, most=40)
    assert got == brute_phrases([(lang, t) for _, t, lang in rows], least=3, longest=6, share=90, most=40)


def test_phrases_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 300)
    rows = invented(60, 3)
    rows.append((99, " ".join(t for _, t, _ in rows), "en"))
    rows.append((100, "one piece " * 500, "en"))
    got = sorted((r.lang, r.w1, r.c) for r in phrases.passed(spark.createDataFrame(rows, DOCS).select("lang", "text").fillna("und"), 1, 0, None, False)
                 .groupBy("lang", "w1").sum("c").withColumnRenamed("sum(c)", "c").collect())
    monkeypatch.undo()
    want = sorted((r.lang, r.w1, r.c) for r in phrases.passed(spark.createDataFrame(rows, DOCS).select("lang", "text").fillna("und"), 1, 0, None, False)
                  .groupBy("lang", "w1").sum("c").withColumnRenamed("sum(c)", "c").collect())
    assert got == want
    parts = list(phrases.chunks(__import__("pyarrow").array([t for _, t, _ in rows])))
    assert b"".join(d for _, _, d in parts).count(b" ") == sum(t.count(" ") for _, t, _ in rows)
    monkeypatch.setattr(phrases, "BATCH", 300)
    assert mined(spark.createDataFrame(rows, DOCS), least=5) == brute_phrases([(lang, t) for _, t, lang in rows], least=5)


def test_phrases_start_again_when_two_words_share_a_hash(spark, monkeypatch):
    """Words that meet under the first seed are told apart by the next one."""
    true, seeds = phrases.word_counts, []

    def poor(docs, seed):
        seeds.append(seed)
        counts = true(docs, seed)
        return counts.withColumn("w1", counts.w1 % 20) if seed == 0 else counts

    monkeypatch.setattr(phrases, "word_counts", poor)
    rows = invented(150, 4)
    assert mined(spark.createDataFrame(rows, DOCS), least=4) == brute_phrases([(lang, t) for _, t, lang in rows], least=4)
    assert seeds == [0, 1]


def test_phrases_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(9 * 10 ** 17, 9 * 10 ** 17, 9 * 10 ** 17 + 1)], "a long, l long, r long")
    assert row.select(phrases.ratio("a", "l", "r").alias("s")).first().s == 2_000_000 * 9 * 10 ** 17 // (18 * 10 ** 17 + 1)


def test_phrases_edges(spark):
    assert mined(spark.createDataFrame([], DOCS)) == []
    assert mined(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \t.,;\n", "de"), (4, "word", "en")], DOCS)) == []
    rows = [(lang, t) for _, t, lang, *_ in edge_rows()]
    assert mined(edge(spark)) == brute_phrases(rows)
    assert [r[2] for r in mined(edge(spark))[:3]] == [r[2] for r in brute_phrases(rows)[:3]] != []
    same = [(7, "alpha Beta gamma. alpha beta", None)] * 40
    assert mined(spark.createDataFrame(same, DOCS)) == brute_phrases([(None, t) for _, t, _ in same])


# ---------------------------------------------------------------- lines

def brute_lines(rows, least_chars=20, least_docs=3):
    blank = " \t\n\v\f\r"
    held = defaultdict(set)

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))

    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    last = {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def deduped(df, **options):
    return sorted(map(tuple, line_dedup.drop_repeated_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def test_lines_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert deduped(documents(spark)) == brute_lines(rows)
    got = deduped(documents(spark), least_chars=5, least_docs=2)
    assert got == brute_lines(rows, 5, 2) and sum(r[2] for r in got) > 100


def test_lines_of_a_third_of_the_documents(spark):
    """A hot line goes by the broadcast way, rare ones by the shuffle; results are the same."""
    rng = random.Random(1)
    hot, rare = "this line is in a third of all documents", [f"a rare line number {k} that few hold" for k in range(1500)]
    rows = [(i, "\n".join(([f"  {hot.upper()}\t"] if i % 3 == 0 else []) + [rng.choice(rare) for _ in range(3)] + [f"own line {i} of the document"])) for i in range(900)]
    assert deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute_lines(rows)


def test_lines_edges(spark):
    line = "exactly twenty chars"
    assert len(line) == 20
    rows = [(1, f"{line}\n{line.upper()}\r\nx"), (2, f"\t{line}\v\n\n"), (None, line), (None, line + "\nother"), (5, None), (6, ""), (7, "\n"), (2, f"\t{line}\v\n\n"),
            (8, "é" * 19), (9, "é" * 19 + "\né"), (10, "é" * 19), (11, "é" * 20), (12, "É" * 20), (13, "é" * 20), (14, "é" * 20), (15, " " + line),
            (16, "long " * 100_000 + "\n" + line)]
    df = spark.createDataFrame([(*r, 1, 2, "k", "p") for r in rows], "doc_id long, text string, n_lines int, key int, kept string, position string")
    got = deduped(df)
    assert got == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(df).columns == ["doc_id", "text", "key", "position", "n_lines", "n_dropped", "kept"]
    assert [r for r in got if r[0] == 11] == [(11, 1, 1, "")] and [r for r in got if r[0] == 12] == [(12, 1, 0, "É" * 20)]
    assert deduped(spark.createDataFrame([], "doc_id long, text string")) == []


# ---------------------------------------------------------------- fill in the middle

def brute_fim(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force_and_restores(spark):
    every = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256", "restored_sha256")
    done = fill_in_middle.transform(documents(spark), returns=every)
    for r in done.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert "".join((r.text if p.buffer == 0 else "<P><S><M>")[p.start:p.start + p.length] for p in r.pieces) == r.output
    assert {r.form for r in done.select("form").collect()} == {"plain", "psm", "spm"}
    back = fill_in_middle.restore(done.select("doc_id", "form", "output"))
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted((r.doc_id, r.text or "") for r in documents(spark).collect())


def test_fim_edges(spark):
    rows = [*edge_rows(), (20, "a<P>b", "en", "a", 1), (21, "<S", "en", "a", 1), (22, "<", "en", "a", 1), (23, "P>", "en", "a", 1), (24, "\U0001f600é́<P", "en", "a", 1),
            (25, "y" * 3_000_000 + " 1", "en", "a", 1)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, form string, output string")
    done = fill_in_middle.transform(df)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect()), key=repr)
    assert got == sorted(((i, *brute_fim(i, t)) for i, t, *_ in rows), key=repr)
    back = fill_in_middle.restore(done.drop("text"))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert fill_in_middle.transform(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 <>PSM\né", max_size=30), st.lists(st.integers(0, 2 ** 32 - 1), min_size=4, max_size=4))
def test_fim_round_trip(text, h):
    form = fill_in_middle.form_of(text, h)
    n, parts = fill_in_middle.cut(text, h)
    assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and fill_in_middle.spell(parts, text) == text
    output = fill_in_middle.spell(fill_in_middle.arrange(parts, form), text)
    assert fill_in_middle.spell(fill_in_middle.inverse(output, form), output) == text


def test_piece_table_splits_anywhere():
    pieces = fill_in_middle.split([(0, 0, 4), (1, 3, 3), (0, 4, 5)], 5)
    assert pieces == [(0, 0, 4), (1, 3, 1), (1, 4, 2), (0, 4, 5)]
    assert np.array_equal(fill_in_middle.token_starts("ab1 c@[`{Z"), [0, 2, 3, 4, 5, 6, 7, 8, 9])
