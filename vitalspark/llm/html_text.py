"""Main text of web pages by boosted trees over DOM nodes.

A page becomes its element tree. Every element gets features: depth, own and
subtree text, link and tag density, punctuation, place and size among its
siblings, the tag's kind, and hashed tokens of class, id and role of itself and
of its ancestors. Gradient-boosted trees give each element a probability of
being part of the article. Decoding goes over the tree: a dropped element takes
its whole subtree with it, so the best set of kept elements (by log-likelihood,
text weighing more) never holds a kept element in a dropped one. Scripts,
styles and other elements that cannot hold article text are not read, if their
own end tag ends them; the head ends where HTML ends it, and a form is read when
it holds headings, paragraphs or an article.

The trees are trained in one task on at most ``SAMPLE_PAGES`` pages (by hash of
the id), with labels from the semantic containers that those pages use; the same
pages with these containers renamed to plain ones with usual class names teach
layouts without them. Pages without such containers teach nothing. Without any
that do, elements are kept unless their tag or names mark them as furniture or
most of their text is in links (``prior``). All pages are extracted whole.

Defined cases: null and empty pages, and pages without markup that is an
article, give the text of what is kept, or the empty text; broken markup is
closed where its parent ends; repeated rows give repeated rows; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, likely_least, table

SAMPLE_PAGES, TREES, DEPTH, RATE, BINS, TOKENS = 300, 30, 3, 0.3, 16, 64
# Element kinds of HTML.
UNREAD = {"script", "style", "head", "title", "noscript", "template", "form", "button", "select", "option", "textarea",
          "iframe", "svg", "canvas", "object", "input", "dialog"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
#: What a head may hold; anything else ends it. Raw text has no elements in it.
IN_HEAD = {"title", "script", "style", "meta", "link", "base", "noscript", "template"}
RAW = {"head", "title", "script", "style", "textarea", "iframe"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s",
          "samp", "small", "span", "strong", "sub", "sup", "u", "var", "tt", "big", "time", "data", "label"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
ONE_HOT = ["p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "table", "td",
           "blockquote", "pre", "figure", "heading"]
FURNITURE = {"nav", "footer", "aside"}
NOT_ARTICLE = {"ad", "ads", "advert", "banner", "sidebar", "menu", "nav", "footer", "header", "comments", "comment", "cookie",
               "notice", "related", "share", "social", "promo", "widget", "breadcrumb", "newsletter", "popup"}
RENAMED = [
    [("nav", "div", "menu"), ("footer", "div", "footer"), ("article", "div", "content"), ("aside", "div", "sidebar")],
    [("nav", "div", "nav breadcrumb"), ("footer", "div", "related share"), ("article", "main", ""), ("aside", "div", "promo widget")],
    [("nav", "header", "header banner"), ("footer", "section", "comments comment"), ("article", "section", "post entry"), ("aside", "div", "cookie notice")],
    [("nav", "aside", "sidebar newsletter"), ("footer", "div", "advert ads social"), ("article", "div", "article body text"), ("aside", "div", "popup")],
]
SPLIT = re.compile(r"[^a-z]+")


class Tree(HTMLParser):
    """Elements in page order: tag, parent, depth, tokens; and pieces of text
    (element, text), None where a block begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.tokens = ["#root"], [-1], [0], [()]
        self.stack, self.pieces, self.ended = [0], [], set()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in ("option", "button", "select"):
            self._repeated(tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((self.stack[-1], " "))
            return
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option", *HEADING) or tag not in INLINE:
            self._imply(tag)
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.depth.append(self.depth[self.stack[-1]] + 1)
        self.tokens.append(tuple(t for t in SPLIT.split(values) if t))
        self.stack.append(len(self.tag) - 1)

    def _leave_head(self):
        """Only a head's own elements and blanks are in it."""
        top = self.tag[self.stack[-1]]
        if top == "head":
            self._close(len(self.stack) - 1)

    def _repeated(self, tag):
        """One button, option or select ends an open one."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[at]] == tag:
                self._close(at)
                return

    def _imply(self, tag):
        """A block closes an open paragraph, an item its sibling."""
        for at in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[at]]
            if open_ == "p" or (open_ == tag and tag in ("li", "td", "tr", "dt", "dd", "option")):
                self._close(at)
                return
            if open_ not in INLINE:
                return

    def _close(self, at):
        del self.stack[at:]

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[at]] == tag:
                self.ended.add(self.stack[at])
                self._close(at)
                return

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        self.pieces.append((self.stack[-1], data))

    def read(self):
        """Leave out the text of unread elements."""
        n = len(self.tag)
        article, cut = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            own = self.tag[i] in ("p", "article", "main") or self.tag[i] in HEADING
            article[self.parent[i]] |= article[i] or own
        for i in range(1, n):
            tag = self.tag[i]
            own = tag in UNREAD and (tag in RAW or (i in self.ended and not (tag == "form" and article[i])))
            cut[i] = cut[self.parent[i]] or own
        self.pieces = [(node, text) for node, text in self.pieces if not cut[node]]


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.read()
    return tree


@lru_cache(maxsize=65_536)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKENS


def features(tree: Tree) -> np.ndarray:
    n = len(tree.tag)
    own, links, marks, below = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    children, place = np.zeros(n), np.zeros(n)
    linked = [False] * n
    for i in range(1, n):
        p = tree.parent[i]
        linked[i] = linked[p] or tree.tag[i] == "a"
        place[i] = children[p]
        children[p] += 1
    for node, text in tree.pieces:
        size = len(text.strip())
        own[node] += size
        marks[node] += sum(map(text.count, ".,;?!"))
        if linked[node]:
            links[node] += size
    whole = own.copy()
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        whole[p] += whole[i]
        links[p] += links[i]
        marks[p] += marks[i]
        below[p] += below[i]
    up = np.maximum(tree.parent, 0)
    out = np.zeros((n, 10 + len(ONE_HOT) + 2 * TOKENS))
    out[:, 0] = np.minimum(tree.depth, 30)
    out[:, 1], out[:, 2] = np.log1p(own), np.log1p(whole)
    out[:, 3], out[:, 4] = links / np.maximum(whole, 1), below / np.maximum(whole, 1)
    out[:, 5], out[:, 6] = marks / np.maximum(whole, 1), np.log1p(children)
    out[:, 7], out[:, 8] = np.log1p(children[up]), whole / np.maximum(whole[up], 1)
    out[:, 9] = place / np.maximum(children[up], 1)
    kinds = {t: 10 + i for i, t in enumerate(ONE_HOT)}
    mine, above = [0] * n, [0] * n  # sets of hashed tokens, as bits
    for i in range(1, n):
        tag = "heading" if tree.tag[i] in HEADING else tree.tag[i]
        if tag in kinds:
            out[i, kinds[tag]] = 1
        p = tree.parent[i]
        above[i] = mine[p] | above[p]
        for t in tree.tokens[i]:
            mine[i] |= 1 << bucket(t)
        if tag in ("nav", "footer", "aside", "article", "main", "header"):
            mine[i] |= 1 << bucket(f"<{tag}>")
    bits = np.asarray([mine, above], "<u8").T.copy().view(np.uint8)
    out[:, 10 + len(ONE_HOT) :] = np.unpackbits(bits, axis=1, bitorder="little")
    return out


def labels(tree: Tree) -> list[int]:
    """1 in the article, 0 in what the page itself marks as furniture or leaves
    outside the article; -1 for the containers around it, and everywhere in a
    page that marks no article."""
    n = len(tree.tag)
    if not {"article", "main"} & set(tree.tag):
        return [-1] * n
    out, holds = [0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i] or tree.tag[i] in ("article", "main")
    for i in range(1, n):
        tag, p = tree.tag[i], tree.parent[i]
        if tag in FURNITURE or NOT_ARTICLE & set(tree.tokens[i]):
            out[i] = 0
        elif tag in ("article", "main"):
            out[i] = 1
        else:
            out[i] = -1 if holds[i] else out[p] if out[p] == 1 else 0
    out[0] = -1
    return out


def renamed(html: str, plan: list[tuple[str, str, str]]) -> str:
    for old, new, name in plan:
        html = re.sub(rf"<{old}\b", f'<{new} class="{name}"', html)
        html = html.replace(f"</{old}>", f"</{new}>")
    return html


def grow(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree as nested lists [feature, cut, left, right] or a leaf."""
    total_g, total_h = gradient.sum(), hessian.sum()
    best, choice = 1e-3, None
    if depth and len(x) >= 20:
        for f, cuts in enumerate(edges):
            for cut in cuts:
                left = x[:, f] <= cut
                g, h = gradient[left].sum(), hessian[left].sum()
                if 1 <= h <= total_h - 1:
                    gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    if gain > best:
                        best, choice = gain, (f, float(cut), left)
    if choice is None:
        return float(RATE * total_g / (total_h + 1))
    f, cut, left = choice
    return [f, cut, *(grow(x[s], edges, gradient[s], hessian[s], depth - 1) for s in (left, ~left))]


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = apply_tree(tree[2], x[left]), apply_tree(tree[3], x[~left])
    return out


def boost(x: np.ndarray, y: np.ndarray) -> list:
    varied = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()]
    edges = [np.zeros(0)] * x.shape[1]
    for f in varied:
        edges[f] = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1]))
        edges[f] = edges[f][edges[f] < x[:, f].max()]
    margin, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(x, edges, y - p, p * (1 - p), DEPTH))
        margin += apply_tree(trees[-1], x)
    return trees


def prior(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Margins without trees: against furniture and elements of links."""
    out = np.where(x[:, 3] > 0.5, -2.0, 1.0)
    for i, tag in enumerate(tree.tag):
        if tag in FURNITURE or NOT_ARTICLE & set(tree.tokens[i]):
            out[i] = -6.0
        elif tag in ("#root", "html", "body"):
            out[i] = 1.0
        elif tag in INLINE:
            out[i] = 0.0
    for i in range(1, len(out)):  # all below furniture is furniture
        if out[tree.parent[i]] == -6.0:
            out[i] = -6.0
    return out


def margins(pages: list[Tree], trees: list) -> list[np.ndarray]:
    """Log-odds of every element; the trees see the elements of all pages at once."""
    made = [features(page) for page in pages]
    if not trees:
        return [prior(page, x) for page, x in zip(pages, made)]
    x = np.concatenate(made)
    margin = np.clip(sum((apply_tree(t, x) for t in trees), np.zeros(len(x))), -6, 6)
    return np.split(margin, np.cumsum([len(m) for m in made])[:-1])


def extract_all(htmls: list[str], trees: list) -> list[str]:
    pages = [parse(html) for html in htmls]
    return [decode(page, margin) for page, margin in zip(pages, margins(pages, trees))] if pages else []


def extract(html: str, trees: list) -> str:
    return extract_all([html], trees)[0]


def decode(tree: Tree, margin: np.ndarray) -> str:
    """Kept elements by the best consistent decoding, then their text."""
    n = len(tree.tag)
    gain = np.zeros(n)  # log-odds of keeping rather than dropping, by own text
    for node, text in tree.pieces:
        gain[node] += len(text.strip())
    gain = margin * (0.2 + np.log1p(gain))
    loose = {"#root", "html", "body"} | INLINE
    best = gain.copy()
    for i in range(n):
        if tree.tag[i] in loose:
            best[i] = 0.0
    for i in range(n - 1, 0, -1):
        best[tree.parent[i]] += max(best[i], 0.0) if tree.tag[i] not in INLINE else best[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[tree.parent[i]] and (tree.tag[i] in loose or best[i] > 0)
    kept = [k and not (tree.tag[i] in ("#root", "html", "body") and margin[i] <= 0) for i, k in enumerate(kept)]
    blocks, last = [], None
    block_of = list(range(n))
    for i in range(1, n):
        if tree.tag[i] in INLINE:
            block_of[i] = block_of[tree.parent[i]]
    for node, text in tree.pieces:
        if kept[node]:
            if block_of[node] != last:
                blocks.append([])
                last = block_of[node]
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> list:
    rows = pages.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.coalesce(html, F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                marked = parse(text)
                known = np.asarray(labels(marked))
                # layouts by turns; the label comes from the page as it is
                for form in (text, renamed(text, RENAMED[k % len(RENAMED)])):
                    made = features(parse(form))
                    if len(made) == len(known):
                        use = np.flatnonzero(known >= 0)
                        use = use[np.linspace(0, len(use) - 1, min(len(use), 24)).astype(int)] if len(use) else use
                        xs.append(made[use])
                        ys.append(known[use])
        x, y = (np.concatenate(xs), np.concatenate(ys).astype(float)) if xs else (np.zeros((0, 1)), np.zeros(0))
        trees = boost(x, y) if len(x) and 0 < y.sum() < len(y) else []
        yield pa.RecordBatch.from_pydict({"trees": pa.array([json.dumps(trees)])})

    few = likely_least(rows, "h", SAMPLE_PAGES, pages.count())
    found = few.orderBy("h").limit(SAMPLE_PAGES).coalesce(1).mapInArrow(run, "trees string").collect()
    return json.loads(found[0][0]) if found else []


def extract_pages(pages: DataFrame, trees: list, key: str = "page_id", html: str = "html") -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(chunks(b, 64) for b in batches):
            texts = extract_all(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}
            )

    rows = pages.select(F.col(f"`{key}`"), "url", F.coalesce(html, F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars long")


def pages_query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))
