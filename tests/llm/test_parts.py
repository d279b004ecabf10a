"""The operators' parts against brute force, without Spark."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import ann, html_extraction as hx, quality_rules as qr, simhash, suffix_dedup as sd, symbols, toxicity as tx


def test_trie_join_finds_every_group():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(200)]
    values = set(base)
    for b in base[:80]:
        for _ in range(rng.randint(1, 12)):
            v = b
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    i, j = simhash.join_tries(values, np.zeros(len(values), int), np.zeros(len(values), int), 3)
    assert all(bin(int(values[a] ^ values[b])).count("1") <= 3 for a, b in zip(i, j))

    def groups(links):
        parent = list(range(len(values)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(values))]

    brute = [(a, b) for a in range(len(values)) for b in range(a) if bin(int(values[a] ^ values[b])).count("1") <= 3]
    assert groups(zip(i.tolist(), j.tolist())) == groups(brute)
    assert len(i) < len(values)


def brute_cover(texts, length):
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]].append((k, p))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                cover[k][p:p + length] = True
    return cover


def test_refine_equals_brute_force():
    rng = random.Random(2)
    parts = [bytes(rng.choices(b"ab", k=300)) for _ in range(4)]
    texts = [b"".join(rng.choices(parts, k=3)) + bytes(rng.choices(b"abc", k=50)) for _ in range(5)] + [b"a" * 500, b"x" * 100, b""]
    data = b"".join(texts)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    found = set(sd.refine(data, ends).tolist())
    counts = Counter(data[p:p + 200] for p in range(len(data)) if ends[p] - p >= 200)
    assert found == {p for p in range(len(data)) if ends[p] - p >= 200 and counts[data[p:p + 200]] > 1}


def test_segments_tile_the_windows():
    rng = random.Random(3)
    texts = [b"", bytes(rng.choices(b"abcdef ", k=900)), b"short", bytes(rng.choices(b"xyz ", k=200)), b"", b"q" * 700]
    which, start, windows, anchor, content, inner = sd.segments_of(texts)
    assert inner[which == 5].all() and not inner[which == 1].any()
    places = [(k, s + i) for k, s, w in zip(which.tolist(), start.tolist(), windows.tolist()) for i in range(w)]
    assert sorted(places) == [(k, p) for k, t in enumerate(texts) for p in range(len(t) - 199)]
    assert len(places) == len(set(places))
    piece = texts[1]
    ids = list(zip(*(x.tolist() for x in sd.bucket_ids(piece + piece[100:500]))))
    whole = piece + piece[100:500]
    assert len(ids) == len(whole) - 199
    assert len(set(ids)) == len({whole[k:k + 200] for k in range(len(ids))})  # equal strings share buckets, others don't
    assert all(ids[100 + k] == ids[900 + k] for k in range(201))


def test_model_equals_plain_kneser_ney():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc d.", k=rng.randint(0, 60))) for _ in range(40)] + ["", "Zeta", "b\0c"]
    keys, bounds = symbols.keys_of(texts)
    assert (np.diff(bounds) == [len(t) for t in texts]).all()
    counts = Counter(keys.tolist())
    model = qr.Model(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))
    table = model.table()

    tables = {4: counts}
    for n in (3, 2, 1):
        tables[n] = Counter(k & (64 ** n - 1) for k in tables[n + 1])

    def p(key, n):
        if n == 0:
            return 1 / 64
        c = tables[n]
        cc = [sum(v == k for v in c.values()) for k in range(5)]
        d = [0, .5, .5, .5]
        if cc[1] and cc[2]:
            y = cc[1] / (cc[1] + 2 * cc[2])
            for k in (1, 2, 3):
                if cc[k] and cc[k + 1]:
                    d[k] = min(max(k - (k + 1) * y * cc[k + 1] / cc[k], .01), k - .01)
        key &= 64 ** n - 1
        same = [v for k, v in c.items() if k >> 6 == key >> 6]
        if not same:
            return p(key, n - 1)
        v = c.get(key, 0)
        return (v - d[min(v, 3)]) / sum(same) + sum(d[min(x, 3)] for x in same) / sum(same) * p(key, n - 1)

    for key in [*list(counts)[:60], *(rng.randrange(64 ** 4) for _ in range(40))]:
        assert math.isclose(table[key], math.log(p(key, 4)), rel_tol=1e-3, abs_tol=1e-3)
    one = np.exp(table[:64].astype(float)).sum()
    assert abs(one - 1) < 1e-3


def test_base_counts():
    text = "a b c a b c\nx|y\n\n  \nx|y\nd"
    n, chars, symbols_, dup, again, failed = qr.base_counts(text)
    assert (n, chars, symbols_, dup, again, failed) == (9, 13, 2, 1, 6, True)
    rng = random.Random(5)
    for _ in range(200):
        words = rng.choices("abc", k=rng.randint(0, 30))
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        assert qr.base_counts(" ".join(words))[4] == len(inside)
    assert qr.base_counts("")[:5] == (0, 0, 0, 0, 0)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(6)
    odds = np.r_[0.0, rng.uniform(0.1, 3, 4), 0.0, rng.uniform(0.1, 3, 3), 0.0]
    step = np.array([-1.0, 0.3, 0.7])
    w = {(0, 0): 1.0, (0, 1): math.exp(-1.0), (1, 0): math.exp(.3), (1, 1): math.exp(.7)}
    total, marks = 0.0, np.zeros(len(odds))
    for state in range(1 << len(odds)):
        y = [(state >> k) & 1 for k in range(len(odds))]
        weight = np.prod([odds[k] if y[k] else 1.0 for k in range(len(odds))]) * np.prod([w[a, b] for a, b in zip(y, y[1:])])
        total += weight
        marks += weight * np.array(y)
    assert np.allclose(tx.marginals(odds, step), marks / total)


def test_gradient_is_the_slope():
    import pickle
    rng = np.random.default_rng(8)
    features = rng.integers(0, 20, (5, 7)).astype(np.int32)
    ids = np.array([-1, 0, 1, 2, -1, 3, 4, 0, -1], np.int32)
    tags = np.array([0, 1, 0, 0, 0, 1, 1, 0, 0], bool)

    def likelihood(field):
        score = np.where(ids >= 0, field.weight[features].sum(1)[ids] + field.bias, -np.inf)
        odds = np.exp(score)
        w = {(0, 0): 0.0, (0, 1): field.step[0], (1, 0): field.step[1], (1, 1): field.step[2]}
        r, _ = tx.forward_backward(np.where(ids >= 0, odds, 0.0), field.step)
        a, z = 1.0, 0.0
        a01, a10, a11 = np.exp(field.step)
        for k in range(1, len(ids)):
            z += math.log(1 + a10 * r[k - 1])
        good = sum(score[k] for k in range(len(ids)) if tags[k]) + sum(w[int(x), int(y)] for x, y in zip(tags, tags[1:]))
        return good - z

    field = tx.Field()
    field.weight[:20] = rng.normal(size=20)
    g, s, _ = tx.gradient(pickle.dumps((features, ids, tags)), field)
    for k in range(3):
        up, down = tx.Field(), tx.Field()
        for f, e in ((up, 1e-5), (down, -1e-5)):
            f.weight, f.step = field.weight.copy(), field.step.copy()
            f.step[k] += e
        assert math.isclose(s[k], (likelihood(up) - likelihood(down)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)
    for k in range(20):
        up, down = tx.Field(), tx.Field()
        for f, e in ((up, 1e-5), (down, -1e-5)):
            f.weight, f.step = field.weight.copy(), field.step.copy()
            f.weight[k] += e
        assert math.isclose(g[k], (likelihood(up) - likelihood(down)) / 2e-5, rel_tol=1e-4, abs_tol=1e-6)


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(9)
    v, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    centre, turn = v.mean(0), ann.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = ann.estimates(q, centre, turn, *ann.encode(v, centre, turn))
    exact = ((q[:, None] - v[None]) ** 2).sum(2)
    assert (np.abs(guess - exact) <= error).mean() > 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
<article id=a><h1>Big &amp; small</h1><p>One <b>bo</b>ld<p>Two&nbsp;three<script>var x="</p>";</script><ul><li>x<li>y</ul>
<aside>side</aside><form><input>name</form><div class="comments"><p>first!</p></div></article>
<footer>&copy; me</footer></body></html>"""


def test_article_text():
    text = " ".join(t for _, t in hx.blocks_of(hx.roots(hx.parse(PAGE)), {}))
    assert text == "Big & small One bold Two three x y"
    marked = PAGE.replace('class="cookie-notice"', 'id="cookieNotice"').replace('class="comments"', 'class="readerComments"')
    assert " ".join(t for _, t in hx.blocks_of(hx.roots(hx.parse(marked)), {})) == text
    quoted = """<body><a title="a > b" data-x='>'>x</a> y <br/>z<p title="open</body>"""
    assert " ".join(t for _, t in hx.blocks_of(hx.roots(hx.parse(quoted)), {})).startswith("x y z")
    for odd in ("", "plain", "<p>a<p>b", "<div" * 50, "<!-- x", "<script>x", "</p>", "<a href='>'>q</a>", "<div>" * 3000 + "deep"):
        hx.blocks_of(hx.roots(hx.parse(odd)), {})
    assert " ".join(t for _, t in hx.blocks_of(hx.roots(hx.parse("<div>" * 3000 + "deep")), {})) == "deep"


def test_tree_matching():
    a, b = hx.shape(hx.parse("<div><p>1</p><p>2</p><ul><li>x</li></ul></div>")), hx.shape(hx.parse("<div><h2>0</h2><p>1</p><ul><li>y</li><li>z</li></ul></div>"))
    size, _ = hx.match(a, b)
    assert size == 5  # root, div, p, ul, li
    at = hx.numbers(a, hx.unpacked(hx.packed(b)))
    assert len(at) == 6  # both p elements stand at the repeated one
