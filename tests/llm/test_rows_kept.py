"""Near-duplicates by row, the sieve, the learning data of the classifiers, articles inside marked wrappers."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import common, html_extraction, simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text):
    return (i, text, "en", "a", len(text or ""))


def test_equal_rows_leave_one_and_shared_ids_are_judged_apart(spark):
    long = " ".join(f"word{k} of the text" for k in range(100))
    other = " ".join(f"another{k} thing entirely" for k in range(100))
    third = " ".join(f"something{k} else again here" for k in range(100))
    rows = [row(1, long), row(1, long), row(1, long), row(5, other), row(5, long), row(1, third), row(None, other), row(None, "alone here now")]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(((r.doc_id or -1, r.text) for r in kept.collect())) == sorted([(1, long), (5, other), (1, third), (-1, "alone here now")])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_rows_keep_their_text_through_near_dedup_and_suffix_dedup(spark):
    """The copies of a row go before the suffix stage, which would remove the bytes of both."""
    long = " ".join(f"word{k} of the text" for k in range(60))
    rows = spark.createDataFrame([row(1, long), row(1, long), row(2, "short text"), row(2, "short text"), row(3, None), row(4, "")], DOCS)
    near = corpus_pipeline.near_duplicates(spark, rows, "")
    done = corpus_pipeline.repeated_passages(spark, common.written(near, "test-near"), "")
    assert sorted((r.doc_id, r.text) for r in done.collect() if r.text) == [(1, long), (2, "short text")]
    assert done.columns == corpus_pipeline.COLUMNS


def test_sieve_keeps_every_key_and_few_strangers(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("n"), "id").alias("name"))
    keys = rows.filter("id % 50 = 7")
    got = {r.id for r in common.sieve(rows, keys, ["id", "name"]).collect()}
    assert {r.id for r in keys.collect()} <= got and len(got) < 1_000
    assert common.sieve(rows, keys.limit(0), ["id", "name"]).count() == 0


def test_sieve_of_bounded_size_lets_all_keys_through(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 1 << 10)
    rows = spark.range(5_000)
    assert {r.id for r in rows.filter("id % 3 = 0").collect()} <= {r.id for r in common.sieve(rows, rows.filter("id % 3 = 0"), ["id"]).collect()}


def test_a_shared_line_does_not_make_copies(spark):
    """Documents that share their smallest shingle but little else are all learned from; copies once."""
    line = "all of these share this one boilerplate line about terms"
    texts = [line + " " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [texts[0]] * 5)] + [(99, None)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    learned = toxicity.learnable(docs, labels, "doc_id", "text", "toxic", F.lit(False))
    assert sorted(r.text for r in learned.collect()) == sorted([*texts, ""])


def test_tokens_stand_where_the_pattern_finds_them():
    texts = ["One two.Three\n", "", "ÀÉ _x9 İstanbul! ﬁ", "\U0001f600 ok​?no", "...", "a" * 50]
    tokens, start, end, first, begin = toxicity.located(texts)
    words = [w.decode("utf-32-le") for w in tokens.to_pylist()]
    assert words == [w for t in texts for w in toxicity.tokens_of(t)]
    for k, text in enumerate(texts):
        stop = first[k + 1] if k + 1 < len(texts) else len(words)
        spans = [(int(s - begin[k]) - 1, int(e - begin[k]) - 1) for s, e in zip(start[first[k] + 1:stop - 1], end[first[k] + 1:stop - 1])]
        assert spans == [m.span() for m in toxicity.TOKENS.finditer(toxicity.lowered(text))]


def extracted(page):
    return " ".join(t for _, t in html_extraction.blocks_of(html_extraction.roots(html_extraction.parse(page)), {}))


def test_articles_inside_marked_wrappers_stay():
    article = "<article><p>Real <b>text</b> here.</p><section class='related-work'>And work.</section></article>"
    for wrapper in ("layout has-sidebar", "elementor-widget container", "post comments-open", "page no-sidebar", "social-science",
                    "promo-free main-wrap", "sidebar", "widget-area"):
        page = f"<body><nav>menu</nav><div class='{wrapper}'>{article}</div><div class='cookie-notice'>no</div><div class=site-footer>no</div></body>"
        assert extracted(page) == "Real text here. And work.", wrapper
    assert extracted("<body><article class='post comments-open'><p>Body</p><div class='comment-list'><article class=comment>x</article></div></article></body>") == "Body"
    assert extracted("<body><div class=comments><article>reader</article></div><p>Page</p></body>") == "Page"
    assert extracted("<body><div id=main-header>head</div><div class=share-buttons>s</div><p>a<ul><li>one<li>two</ul><table><tr><td>c<td>d</table></body>") == "a one two c d"


def test_deep_pages_keep_their_text(spark):
    deep = "<body>" + "<div>" * 3000 + "<article><p>deep</p></article>" + "</div>" * 3000 + "</body>"
    assert extracted(deep) == "deep"
    pages = spark.createDataFrame([(i, "http://h/x", deep.replace("deep", f"deep {i}")) for i in range(6)], "page_id int, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_extraction.extract(pages).collect()) == [(i, f"deep {i}") for i in range(6)]


def test_crowded_anchors_are_counted_by_windows(spark, monkeypatch):
    """A passage with other surroundings in each of 300 documents: no task sorts its variants, and what
    is removed stays the same."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = letters(600)
    rows = [(i, letters(rng.randrange(0, 400)) + passage + letters(rng.randrange(0, 400))) for i in range(300)] + [(900, letters(500)), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).select(*columns).collect()))
    sizes, true = [], suffix_dedup.sorted_spans

    def watched(dealt, tasks):
        sizes.extend(r["count"] for r in dealt.groupBy("anchor").count().collect())
        return true(dealt, tasks)

    monkeypatch.setattr(suffix_dedup, "sorted_spans", watched)
    monkeypatch.setattr(suffix_dedup, "MOST", 20)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).select(*columns).collect()))
    assert got == want and max(sizes, default=0) <= 20
    assert all(600 <= r[2] < 640 for r in got if r[0] < 300)
