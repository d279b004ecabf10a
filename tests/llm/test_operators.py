"""The operators on Spark against brute force over whole small tables, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import ann, html_extraction, quality_classifier, quality_rules, queries, simhash, suffix_dedup, toxicity
from tests.llm.test_parts import brute_cover

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edge_rows():
    long = "lorem ipsum dolor " * 20_000
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, long, "en", "a", 9),
            (5, "x" * 70_000, None, "b", 1), (None, "null key", "de", "b", 1), (6, " \t\n", "de", "c", 1), (7, "\0 nul   é", "fr", "c", 1)]


def edge(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row long, rows long, fingerprint long, kept string, `from` int, score string, spans int, v int, id int"
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4, "s", 5, 6, 7) for r in edge_rows()], names)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(prints)
    got = {r.doc_id: r for r in queries.QUERIES["op2_simhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[groups[k]] = min(least.get(groups[k], i), i)
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{prints[k]:016x}"
        assert got[i].component_id == least[groups[k]]
    assert len(set(groups)) < len(rows)


def test_simhash_cuts_crowded_tries(spark, monkeypatch):
    """A small bound must change nothing but the number of tries."""
    monkeypatch.setattr(simhash, "MOST", 3)
    want = {tuple(r) for r in simhash.near_duplicates(documents(spark)).select("doc_id", "component_id").collect()}
    monkeypatch.undo()
    assert want == {tuple(r) for r in simhash.near_duplicates(documents(spark)).select("doc_id", "component_id").collect()}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(edge(spark)).collect()
    assert len(got) == len(edge_rows())
    zero = {r.doc_id: r for r in got}
    assert zero[1].fingerprint == "0" * 16 and zero[1].component_id == zero[2].component_id == zero[6].component_id == 1
    assert simhash.near_duplicates(edge(spark).limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(edge(spark)).collect() if r.doc_id in (1, 2, 3, 6)) == [1, 3]  # of equal rows one stays


def test_suffix_equals_brute_force(spark):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in documents(spark).collect())
    cover = brute_cover([t for _, t in rows], 200)
    got = {r.doc_id: r for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert len(got) == len(rows)
    some = 0
    for (i, t), c in zip(rows, cover):
        rest = bytes(np.frombuffer(t, np.uint8)[~c])
        runs = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(t), int(c.sum()), runs)
        assert got[i].kept_sha256 == hashlib.sha256(rest).hexdigest()
        some += 0 < c.sum() < len(t)
    assert some


def test_suffix_deals_crowded_anchors_again(spark, monkeypatch):
    want = {tuple(r) for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    monkeypatch.setattr(suffix_dedup, "MOST", 2)
    assert want == {tuple(r) for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()}


def test_suffix_edges(spark):
    got = suffix_dedup.remove_repeats(edge(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert (by[1].n_bytes, by[1].n_removed, by[1].n_spans, bytes(by[1].kept)) == (0, 0, 0, b"")
    assert by[4].n_removed == by[4].n_bytes and by[5].n_removed == 70_000 and by[3].n_removed == 0
    twice = spark.createDataFrame([(1, "ab c" * 60), (1, "ab c" * 60), (2, "zz")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(twice).collect()) == [(1, 240), (1, 240), (2, 0)]
    assert suffix_dedup.remove_repeats(edge(spark).limit(0)).count() == 0


def test_quality_rules(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op3_quality_rules"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id])
        lines = [x for x in texts[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        assert r.n_repeat_words == len(inside)
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    good = [r for r in got if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    docs = edge(spark)
    for keep in (True, False):
        rows = quality_rules.judge(docs, keep_text=keep).collect()
        assert len(rows) == len(edge_rows()) and not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 6))
        assert quality_rules.judge(docs.limit(0), keep_text=keep).count() == 0


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_classifier"](spark, sf).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[i].kept for i, q in marks.items() if q == 1]
    assert sum(good) >= 0.99 * len(good)
    rows = quality_classifier.classify(edge(spark), labels).collect()
    assert len(rows) == len(edge_rows()) and not any(r.kept for r in rows if r.doc_id in (1, 2))
    assert quality_classifier.classify(edge(spark).limit(0), labels).count() == 0
    assert all(r.kept for r in quality_classifier.classify(edge(spark), labels.limit(0)).collect() if r.doc_id in (3, 4))


def test_joined_probabilities_equal_the_model(spark):
    """The sharded joins give what the sorted arrays give."""
    from tessera.llm.symbols import count_keys
    docs = documents(spark)
    counts = count_keys(docs).cache()
    model = quality_rules.fit(docs)
    got = quality_classifier.log_probabilities(counts, counts).toArrow()
    assert np.allclose(model.table()[got["key"].to_numpy()], got["p"].to_numpy(), atol=1e-3)


def test_nearest_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(list)
    for r in sorted(queries.QUERIES["op6_one_bit_codes"](spark, sf).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[k]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:10]
        found = got[ids[k]]
        assert len(found) == 10
        for i, s in found:
            assert abs(s - d[ids == i][0]) < 1e-12
        hits += len({ids[j] for j in order} & {i for i, _ in found})
        total += 10
    assert hits >= 0.9 * total


def test_nearest_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (100, [1.0, 0.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    from pyspark.sql import functions as F
    got = sorted(tuple(r) for r in ann.nearest(df, is_query=F.col("id") % 100 == 0).collect())
    assert [(q, k, i) for q, k, i, _ in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, sf).collect()}
    held = [i for i in labels if got[i].held_out]
    right = sum(got[i].predicted == labels[i] for i in held)
    caught = [got[i].predicted for i in held if labels[i] == 1]
    alarms = [got[i].predicted for i in held if labels[i] == 0]
    print(len(held), right / len(held), np.mean(caught), np.mean(alarms))
    assert right >= 0.97 * len(held) and np.mean(caught) > 0.9 and np.mean(alarms) < 0.01
    rows = toxicity.score(edge(spark), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(edge(spark).limit(0), spark.read.parquet(f"{sf}/labels.parquet").limit(0)).count() == 0


def test_html(spark):
    def page(k, extra=""):
        return f"<html><body><div><p>Always here</p><p>Menu of site</p></div><div><h1>Title {k}</h1><p>Body {k} text{extra}</p><p>More {k}</p></div></body></html>"

    rows = [(k, "http://a.example/x", page(k)) for k in range(6)] + [(10, "http://b.example/", page(1)), (11, None, None), (11, None, None), (12, "", ""),
            (13, "HTTP://u@A.example:80/", page(99, " word" * 50_000)), (0, "http://a.example/x", page(0))]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html_extraction.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].text == "Title 3 Body 3 text More 3" and by[3].n_chars == len(by[3].text)
    assert by[10].text == "Always here Menu of site Title 1 Body 1 text More 1"
    assert by[11].text == by[12].text == "" and by[13].text.endswith("word More 99")
    assert html_extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_html_pages_keep_their_articles(spark, sf):
    got = queries.QUERIES["op10_html_extraction"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html
    for r in got:
        source = pages[r.page_id]
        if "<article>" in source:
            inner = source[source.index("<article>") + 9:source.index("</article>")]
            inner = html.unescape(re.sub(r"</?(?:b|i|em|a|span)>", "", re.sub(r"<(?!/?(?:b|i|em|a|span)>)[^>]*>", " ", inner)))
            assert r.text == " ".join(inner.split())
