"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Every page's DOM tree is aligned with the host's reference
page by simple tree matching (the largest order-preserving match of equally labelled nodes,
children by dynamic programming; runs of equal leaf siblings count as one repeated node). Over
all of a host's distinct pages, Spark counts how often a block of text stands at a matched node:
a block that ``CONSTANT`` of them share is template, what varies in the slots is content. Of
the content, the parts that are menus, headers, footers, sidebars, notices, adverts, forms or
reader comments by their element or role are left out, and where the page marks an article, the
article is taken.

The reference of a host is a partial aggregation (the page with the smallest hash), counts are
partial aggregations too, and both go back to the pages by a join that splits hot hosts."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import join_by_key, slices, texts_of, with_arrays, with_fields, written

#: Share of a host's distinct pages that makes a block template, and the pages that need it at least.
CONSTANT, LEAST = 0.9, 4
#: Nodes nested deeper than this are not aligned with the reference (their text is read like any
#: other and never template), as the alignment recurses.
DEPTH = 150

# Element names of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
HIDDEN = frozenset("""head script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video
nav aside footer form button select datalist input dialog menu""".split())
CLOSES_P = BLOCK - frozenset("br body head html option optgroup caption td th tr tbody thead tfoot li dd dt".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "optgroup": ("optgroup", "option"), "tbody": ("tbody", "thead", "tr", "td", "th"),
          "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl div section article main select button form td th aside nav header footer".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of parts that are none of the article: a class or id that is one of them, begins with one
#: and goes on with words of ``PLACES`` (sidebar-left, comment-list), or ends with one of
#: ``OWN_NAMES`` (cookie-notice, site-footer) and does not begin with a word of ``ABOUT`` (has-sidebar).
OWN_NAMES = frozenset("""ad ads advert adverts advertisement advertising sidebar menu nav navbar navigation breadcrumb breadcrumbs
footer cookie cookies notice notices popup modal newsletter comments masthead topbar topnav sidenav adbox adslot adsense adbanner
pagination""".split())
OFF_NAMES = OWN_NAMES | frozenset("""sponsor sponsored promo promotion banner consent gdpr alert overlay subscribe
subscription signup login comment respond responses replies discussion disqus social share sharing related recommended
search pager toolbar widget notification notifications announcement""".split())
PLACES = OFF_NAMES | frozenset("""area bar block box boxes button buttons card cards center column container content form frame group holder icons
inner item items left link links list main outer panel posts primary right rail row secondary section sections slot slots stories
thread title top bottom unit wrap wrapper widgets""".split())
ABOUT = frozenset("has no with without is not open closed hide show toggle".split())
TOP_NAMES = frozenset(("header", "head"))
READERS = frozenset("comment comments reply replies respond responses discussion".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'<>]+)""")


WORDS = re.compile(r"([a-z0-9])([A-Z])")  # cookieNotice is cookie-notice


def named(token: str, own: frozenset, any_: frozenset) -> bool:
    """Whether a class or id (small letters) says that an element is such a part."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    if not words:
        return False
    if words[0] in any_ and all(w in PLACES for w in words[1:]):
        return True
    return words[-1] in own and ABOUT.isdisjoint(words[:-1])


@lru_cache(10_000)
def parts_of(marks: str) -> tuple[bool, ...]:
    """Whether classes and ids mark a part that is none of the article, readers' comments, a header."""
    return tuple(any(named(t, own, any_) for t in marks.split()) for own, any_ in ((OWN_NAMES, OFF_NAMES), (READERS, READERS), (TOP_NAMES, TOP_NAMES)))


class Node:
    __slots__ = ("tag", "marked", "top", "readers", "role", "off", "kids", "label")

    def __init__(self, tag: str, attributes: str):
        found = {}
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                found.setdefault((m[1] or m[5]).lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        marks = (found.get("class", "") + " " + found.get("id", "")).strip()
        marks = WORDS.sub(r"\1-\2", marks).lower()
        self.tag = tag
        self.marked, self.readers, self.top = parts_of(marks)
        self.role = found.get("role", "").lower()
        self.off = "hidden" in found or found.get("aria-hidden", "").lower() == "true" \
            or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.label = tag + "." + re.sub(r"\d+", "0", ".".join(sorted(marks.split()))) if marks else tag
        self.kids: list = []


def parse(page: str) -> Node:
    """The DOM tree: kids are nodes and strings (character references decoded). Missing end tags
    are implied, stray ones ignored; the contents of scripts and the like are no text."""
    root = Node("#root", "")
    stack, at, n = [root], 0, len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))  # no tag begins behind it
    while at < n:
        m = TOKEN.search(page, at) if at <= last else None
        if not m:
            stack[-1].kids.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            close(stack, ("p",))
        if tag in CLOSES:
            close(stack, CLOSES[tag])
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(node)
    return root


def close(stack: list[Node], tags: tuple[str, ...]) -> None:
    """Imply the end tags of open elements ``tags`` up to the nearest scope."""
    k = len(stack) - 1
    while k > 0 and (stack[k].tag in tags or stack[k].tag not in SCOPES):
        if stack[k].tag in tags:
            del stack[k:]
        k -= 1


class Shape:
    """A node of the tree to align: its label, kids and the tree's nodes it stands for."""
    __slots__ = ("label", "kids", "nodes", "number", "weight")

    def __init__(self, label: str, kids: list, nodes: list[Node]):
        self.label, self.kids, self.nodes, self.number = label, kids, nodes, -1
        self.weight = 1 + sum(k.weight for k in kids)


def shape(node: Node, depth: int = 0) -> Shape:
    kids: list[Shape] = []
    for kid in node.kids if depth < DEPTH else ():
        if isinstance(kid, Node):
            s = shape(kid, depth + 1)
            if not s.kids and kids and not kids[-1].kids and kids[-1].label == s.label:
                kids[-1].nodes += s.nodes  # a repeated node
            else:
                kids.append(s)
    return Shape(node.label, kids, [node])


def packed(s: Shape) -> list:
    return [s.label, [packed(k) for k in s.kids]]


def unpacked(p: list) -> Shape:
    """The reference's tree with its nodes numbered."""
    def build(p: list) -> Shape:
        return Shape(p[0], [build(k) for k in p[1]], [])

    root = build(p)
    queue, number = [root], 0
    while queue:
        s = queue.pop()
        s.number, number = number, number + 1
        queue += s.kids
    return root


def match(a: Shape, b: Shape) -> tuple[int, list]:
    """Simple tree matching: the size of the largest match of the trees (0 if their labels
    differ) and its pairs below the roots, nested."""
    if a.label != b.label:
        return 0, []
    x, y = a.kids, b.kids
    head = 0
    while head < len(x) and head < len(y) and x[head].label == y[head].label and x[head].label.partition(".")[0] in ("head", "script", "style"):
        head += 1  # nothing to choose there
    x, y = x[head:], y[head:]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    sizes = {}
    for i, p in enumerate(x, 1):
        row, above = best[i], best[i - 1]
        for j, q in enumerate(y, 1):
            if p.label == q.label:
                size = sizes[i, j] = match(p, q) if p.kids and q.kids else (1, [])
                row[j] = max(above[j], row[j - 1], above[j - 1] + size[0])
            else:
                row[j] = max(above[j], row[j - 1])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((x[i - 1], y[j - 1], sizes[i, j][1]))
            i, j = i - 1, j - 1
    return best[-1][-1] + 1, pairs


def numbers(page: Shape, reference: Shape) -> dict[int, int]:
    """Number of the reference's node that each matched node of the page stands at."""
    out = {id(n): reference.number for n in page.nodes} if page.label == reference.label else {}
    queue = list(match(page, reference)[1])
    while queue:
        a, b, below = queue.pop()
        out.update((id(n), b.number) for n in a.nodes)
        queue += below
    return out


def left_out(node: Node, inside: bool) -> bool:
    """Whether an element is none of the article by its kind, role or names."""
    return shut(node) or by_name(node, inside)


def shut(node: Node) -> bool:
    """Left out by kind or role: nothing below is looked at."""
    return node.off or node.tag in HIDDEN or node.role in OFF_ROLES


def by_name(node: Node, inside: bool) -> bool:
    """Left out by class or id, or as a page's header."""
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and node.readers
    return node.marked or (not inside and (node.tag == "header" or node.top))


def roots(root: Node) -> list[Node]:
    """Where the content is looked for: the outermost articles that stay, else the main element,
    else articles and main elements below parts whose names (not those of readers' comments) leave
    them out, else the body, else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "below article": [], "below main": [], "body": []}
    queue = [(root, False, "")]
    while queue:
        node, inside, below = queue.pop()
        if node.tag != "#root" and shut(node) and node.tag != "body":
            continue
        kind = "article" if node.tag == "article" else "main" if node.tag == "main" or node.role == "main" else node.tag
        if kind == "article" and not node.readers:
            found[below + kind].append(node)
            continue
        if kind in ("main", "body"):
            found[below + kind if kind == "main" else kind].append(node)
            inside = inside or kind == "main"
        if node.tag != "#root" and by_name(node, inside):
            if node.readers:
                continue
            below = "below "
        queue += [(k, inside, below) for k in reversed(node.kids) if isinstance(k, Node)]
    return found["article"] or found["main"][:1] or found["below article"] or found["below main"][:1] or found["body"][:1] or [root]


def blocks_of(tops: list[Node], at: dict[int, int], every: bool = False) -> list[tuple[int, str]]:
    """(number of the node, text) of the blocks in page order, white space made one space. With
    ``every``, those of left-out parts too."""
    out: list[tuple[int, str]] = []
    for top in tops:
        inside = top.tag in ("article", "main") or top.role == "main"
        line: list[str] = []
        queue: list = [(top, -1)]
        while queue:
            item, number = queue.pop()
            if isinstance(item, str):
                line.append(item)
                continue
            if item is None or item.tag in BLOCK:  # a block begins or ends here
                if text := " ".join("".join(line).split()):
                    out.append((number, text))
                line = []
            if item is None or (item is not top and (left_out(item, inside) if not every else item.tag in RAW or item.tag == "head")):
                continue
            own = at.get(id(item), -1)
            if item.tag in BLOCK:
                queue.append((None, own))
            queue += [(k, own if item.tag in BLOCK else number) for k in reversed(item.kids)]
        if text := " ".join("".join(line).split()):
            out.append((-1, text))
    return out


def key_of(number: int, text: str) -> int:
    """A signed 64-bit hash of a block at a node."""
    return xxhash.xxh3_64_intdigest(f"{number}:{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def aligned(page: str, reference: str) -> tuple[Node, dict[int, int]]:
    tree = parse(page)
    return tree, numbers(shape(tree), unpacked(json.loads(reference)))


def host_of(url: str):
    """Host of a URL column: no user, no port, small letters; empty where there is none."""
    place = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", ""))


def references(pages: DataFrame, host: str, page: str) -> DataFrame:
    """__host, __rows, __reference (the packed tree of the page with the smallest hash)."""
    picked = pages.select(F.col(host), F.col(page).alias("page"), F.xxhash64(page).alias("h")).groupBy(host) \
        .agg(F.count("*").alias("__rows"), F.min_by("page", "h").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page"):
            trees = [json.dumps(packed(shape(parse(t)))) for t in texts_of(batch, "page")]
            yield with_arrays(batch, {"__reference": pa.array(trees, pa.string())})

    schema = with_fields(picked.schema, [T.StructField("__reference", T.StringType())])
    return written(picked.mapInArrow(run, schema).drop("page"), "html-references")


def templates(referred: DataFrame, host: str, page: str) -> DataFrame:
    """host, __template: hashes of the blocks that ``CONSTANT`` of a host's distinct pages share
    at a matched node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            rows = []
            for name, text, reference in zip(batch.column(host).to_pylist(), texts_of(batch, page), batch.column("__reference").to_pylist()):
                tree, at = aligned(text, reference)
                blocks = {key_of(n, t) for n, t in blocks_of([tree], at, every=True) if n >= 0}
                whole = xxhash.xxh3_64_intdigest(repr(sorted(blocks)).encode()) - (1 << 63)
                rows += [(name, whole, b) for b in blocks] + [(name, whole, None)]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                             names=["host", "page", "block"])

    counted = referred.select(host, page, "__reference").mapInArrow(run, "host string, page long, block long") \
        .distinct().groupBy("host", "block").agg(F.count("*").alias("pages"))
    counted = written(counted, "html-blocks")
    pages = counted.filter("block is null").select("host", F.col("pages").alias("all"))
    constant = counted.filter("block is not null").join(pages, "host").filter(
        (F.col("all") >= LEAST) & (F.col("pages") >= CONSTANT * F.col("all")))
    return constant.groupBy(F.col("host").alias(host)).agg(F.collect_list("block").alias("__template"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without its source, with ``out``: the main text (empty if there is none) and
    n_chars, its code points.

    Null and empty pages give the empty text; pages without a host are taken for one host;
    repeated pages count once for the template and give the same text each; a host with fewer
    than ``LEAST`` distinct pages has no template, only the elements' kinds decide there; an
    empty table stays empty; columns named like a result are replaced."""
    drop = [c for c in (out, "n_chars") if c != page and c != url]
    pages = pages.drop(*drop).withColumn("__host", host_of(url))
    known = references(pages, "__host", page)
    referred = join_by_key(pages.select("__host", page), known, "__host", "__rows")
    found = known.join(templates(referred, "__host", page), "__host", "left")
    ready = join_by_key(pages, written(found, "html-templates"), "__host", "__rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            texts = []
            for text, reference, template in zip(texts_of(batch, page), batch.column("__reference").to_pylist(),
                                                 batch.column("__template").to_pylist()):
                constant = frozenset(template or ())
                tree, at = aligned(text, reference) if constant else (parse(text), {})
                texts.append(" ".join(t for n, t in blocks_of(roots(tree), at) if not constant or n < 0 or key_of(n, t) not in constant))
            yield with_arrays(batch, {"__text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    fields = [T.StructField("__text", T.StringType()), T.StructField("n_chars", T.LongType())]
    done = ready.mapInArrow(run, with_fields(ready.schema, fields))
    return done.drop(page, "__host", "__reference", "__template").withColumnRenamed("__text", out)
