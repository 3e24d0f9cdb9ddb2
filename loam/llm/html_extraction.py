"""The main text of web pages, by boosted trees over the nodes of their block structure.

Every element that makes a block, and every run of text in one, has features: its tag, words
of its class, id and role, those of its ancestors, text and link density of its subtree,
depth, and how it stands among its siblings. Boosted trees give its log-odds of holding
main text. Decoding takes the most likely labelling in which nothing is kept under an
element that isn't, by one pass up and one down the tree.

The trees learn from pages that a seeded generator writes, with known labels, at the time
of use: a few seconds, and the same trees every time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting, page_maker
from .dom import Node, blocks
from .shared import pick
from .words import frugal

TAGS = "#text p h1 h2 h3 h4 h5 h6 div section article main body nav header footer aside form fieldset button label ul ol li dl dt dd table tr td th blockquote pre figure figcaption details summary address".split()
#: Words in class, id and role, by what they tell.
TELLING = {
    "menu": "nav menu navbar navigation navigate breadcrumb breadcrumbs crumb crumbs pagination pager tabs toc skip menubar toolbar topbar".split(),
    "head": "header head masthead banner top logo brand branding hero".split(),
    "foot": "footer foot bottom colophon copyright legal imprint".split(),
    "side": "sidebar side aside rail widget widgets panel secondary complementary".split(),
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted dfp adsense banner outbrain taboola commercial".split(),
    "notice": "cookie cookies consent gdpr notice notification alert warning popup modal overlay dialog paywall announcement message disclaimer newsletter subscribe subscription".split(),
    "form": "form login signin signup search register contact field input subscribe".split(),
    "comment": "comment comments reply replies respond disqus discussion feedback thread responses reader".split(),
    "share": "share sharing social follow tweet facebook like buttons".split(),
    "related": "related recommended recommendations more popular trending also next previous teaser teasers latest tags tag".split(),
    "byline": "byline meta author date published time dateline info".split(),
    "main": "article content main post entry story text body page blog news prose markdown".split(),
}
TELLS = {word: [i for i, words in enumerate(TELLING.values()) if word in words] for words in TELLING.values() for word in words}
UNDER = "nav header footer aside form article main ul table figure".split()
PLACE = {t: i for i, t in enumerate(TAGS)}
ABOVE = {t: i for i, t in enumerate(UNDER)}
NUMBERS = 18
WIDTH = len(TAGS) + 1 + 2 * len(TELLING) + len(UNDER) + NUMBERS


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node but the page itself."""
    n = len(nodes)
    k, t = len(TAGS) + 1, len(TELLING)
    words, chars, linked, stops, runs, paragraphs, below = (np.zeros(n) for _ in range(7))
    out = np.zeros((n, WIDTH), np.float32)
    for i, x in enumerate(nodes):
        own = out[i]
        own[PLACE.get(x.tag, k - 1)] = 1
        for name in x.names:
            for j in TELLS.get(name, ()):
                own[k + j] = 1
        if x.parent >= 0:
            up = out[x.parent]
            own[k + t : k + 2 * t + len(UNDER)] = up[k + t : k + 2 * t + len(UNDER)]
            own[k + t : k + 2 * t] += up[k : k + t]
            if (j := ABOVE.get(nodes[x.parent].tag)) is not None:
                own[k + 2 * t + j] = 1
        if x.text:
            words[i] = x.text.count(" ") + 1
            chars[i], linked[i], runs[i] = len(x.text), x.linked, 1
            stops[i] = x.text.count(".") + x.text.count(",") + x.text.count("。") + x.text.count("?") + x.text.count("!")
        paragraphs[i] = x.tag == "p"
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        for a in (words, chars, linked, stops, runs, paragraphs):
            a[up] += a[i]
        below[up] += below[i] + 1
    place, beside, beside_words, beside_linked = (np.zeros(n) for _ in range(4))
    for i, x in enumerate(nodes):
        m = len(x.children)
        if m:
            place[x.children] = np.arange(m) / m
            beside[x.children] = m
            beside_words[x.children] = words[i] / m
            beside_linked[x.children] = linked[i] / max(chars[i], 1)
    parent = np.array([max(x.parent, 0) for x in nodes])
    total = max(words[0], 1)
    seen = np.cumsum(np.where([x.tag == "#text" for x in nodes], words, 0)) / total
    numbers = (
        np.log1p(words), linked / np.maximum(chars, 1), stops / np.maximum(words, 1), [x.depth for x in nodes], place, beside, np.log1p(beside_words), beside_linked, words / total,
        words / np.maximum(runs, 1), np.log1p(below), words / (below + 1), np.log1p(paragraphs), np.log1p(paragraphs[parent]), words / np.maximum(words[parent], 1), chars / np.maximum(words, 1), seen, np.log1p(words[parent]),
    )
    out[:, -NUMBERS:] = np.stack([np.asarray(x, np.float32) for x in numbers], 1)
    return out[1:]


@lru_cache(maxsize=2)
def trained(pages: int = 300, seed: int = 5) -> boosting.Boosted:
    """Trees fitted to ``pages`` pages of the generator."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = page_maker.page(rng)
        nodes = blocks(page)
        xs.append(features(nodes))
        ys.append(page_maker.labels(nodes)[1:])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], margin: np.ndarray) -> list[str]:
    """Kept texts in page order. margin: log-odds of all nodes but the page."""
    n = len(nodes)
    # of each node's subtree: what the best labelling with the node kept gains over dropping all of it
    gain = [0.0, *margin.tolist()]
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = [True] * n
    out = []
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
        if kept[i] and nodes[i].text:
            out.append(nodes[i].text)
    return out


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            a = 0
            pages = batch.column(0)
            while a < len(pages):
                trees, size, b = [], 0, a
                while b < len(pages) and size < 1 << 20:  # a bounded number of nodes at a time
                    page = pages[b].as_py() or ""
                    trees.append(blocks(page))
                    size += len(page)
                    b += 1
                rows = [features(x) for x in trees]
                margin = m.margin(np.concatenate(rows)) if rows else np.zeros(0)
                cuts = np.cumsum([0, *map(len, rows)])
                texts = [" ".join(decode(x, margin[i:j])) for x, i, j in zip(trees, cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )
                a = b

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text and n_chars, its code points.

    Blocks of the article are joined by one space; white space inside a block is one space,
    and character references are decoded. Null and empty pages, and pages without main
    text, have an empty text. Ids and urls are passed on as they are, repeated or null.
    Very long pages are parsed whole. An empty table gives an empty result. Other columns
    are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())
    table = pick(pages, html=html, page_id=page_id, url=url)
    kind = table.schema["page_id"].dataType.simpleString()
    return table.mapInArrow(frugal(_extract(model)), f"page_id {kind}, url string, text string, n_chars long")
