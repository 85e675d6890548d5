"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a variable: main text or not. Its own potential is a linear function of its tag, the words in
its id, class and role (which speak otherwise below an article than elsewhere), and the amount of text and links in and
below it; an element that stands in a line of text, as a link does, has none, so it goes by what is around it. An element
and its parent share a potential for each pair of states, by the kind of the child. Messages pass from the leaves to the root and back (sum-product), so
every element gets its exact marginal; all pages of a batch pass theirs together, level by level. The weights maximise
the likelihood of labelled pages, with the same messages for the expectations. Text whose element's marginal is one
half or more is kept. Where no text reaches that, what has at least half of the highest marginal of a text is kept, if
that one is LIKELY or more; of a page without tags all is.

Defined results: a null, empty or textless page has an empty text; broken markup gives some tree; an attribute that is
repeated counts each time; scripts, styles, titles and form fields never count as text; a quote that nothing closes drops no text, and what follows a script or style without an
end is its content; rows with equal or null ids and repeated rows are extracted each by itself, equal ones equally; a page of
any length is read whole, in memory of some 30 bytes for each of its own and 300 for an element; further columns are kept,
but for one named ``text``, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .dom import BLOCK, Page, read

PAGES_AT_ONCE = 256
#: Tags with a feature of their own, and parts of names with what they speak of.
TAGS = "html head body p h1 h2 h3 li ul ol a nav header footer aside form button select label main article section div span table tr td blockquote pre figure figcaption img br b dl dialog".split()
NAMES = {
    "advert": ["ad", "ads", "adslot", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "doubleclick", "outbrain"],
    "menu": ["nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "toolbar"],
    "footer": ["footer", "foot", "copyright", "legal", "contentinfo", "colophon", "credits"],
    "side": ["sidebar", "side", "related", "widget", "aside", "complementary", "recommended", "recommendations", "popular", "trending", "more", "teaser"],
    "comment": ["comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus", "respond", "reactions", "review", "reviews"],
    "notice": ["cookie", "cookies", "notice", "consent", "gdpr", "newsletter", "subscribe", "subscription", "popup", "modal", "alert", "paywall", "signup", "overlay", "dialog"],
    "share": ["share", "sharing", "social", "follow", "like", "buttons"],
    "header": ["masthead", "header", "banner", "top", "topbar", "logo", "branding"],
    "form": ["search", "login", "form", "signin", "register"],
    "main": ["article", "content", "main", "post", "entry", "story", "body", "text", "page", "articlebody", "prose"],
}
_OF_NAME = {w: k for k, words in enumerate(NAMES.values()) for w in words}
_MAIN = list(NAMES).index("main")
_OF_TAG = {t: k for k, t in enumerate(TAGS)}
LENGTHS = (1, 25, 80, 200, 600)
LINKS = (0.01, 0.3, 0.7)
N_FEATURES = len(TAGS) + 1 + 2 * len(NAMES) + 2 * (len(LENGTHS) + 1) + len(LINKS) + 1 + 2
#: Kinds of a child for the potentials it shares with its parent.
KINDS = 3
STEPS = 120
#: A page without a text of one half has one from this marginal on.
LIKELY = 0.1


@dataclass
class Forest:
    """The elements of some pages as one forest: features (columns per element), parents, kinds, depths."""

    features: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    depth: np.ndarray


def forest(pages: list[Page]) -> Forest:
    """Elements of all pages, page after page; parents come before their children."""
    tags, names, parent, depth, own, links, dots = [], [], [], [], [], [], []
    for page in pages:
        base = len(tags)
        depths: list[int] = []
        in_link: list[bool] = []
        for t, p in zip(page.tag, page.parent, strict=True):
            depths.append(0 if p < 0 else depths[p] + 1)
            in_link.append(t == "a" or (p >= 0 and in_link[p]))
        tags += page.tag
        names += page.attributes
        parent += [p if p < 0 else p + base for p in page.parent]
        depth += depths
        chars, stops = [0] * len(page.tag), [0] * len(page.tag)
        for e, t in page.runs:
            if t != "\n":
                chars[e] += len(t.strip())
                stops[e] += t.count(". ") + t.rstrip().endswith((".", "!", "?"))
        own += chars
        links += [c if a else 0 for c, a in zip(chars, in_link, strict=True)]
        dots += stops
    n = len(tags)
    parent_of, depth_of = np.array(parent, np.int64), np.array(depth, np.int64)
    own_of, below, linked = np.array(own, np.float64), np.array(own, np.float64), np.array(links, np.float64)
    for d in range(int(depth_of.max(initial=0)), 0, -1):
        rows = np.flatnonzero(depth_of == d)
        np.add.at(below, parent_of[rows], below[rows])
        np.add.at(linked, parent_of[rows], linked[rows])
    x = np.zeros((n, N_FEATURES), np.float64)
    rows = np.arange(n)
    x[rows, [_OF_TAG.get(t, len(TAGS)) for t in tags]] = 1
    at = len(TAGS) + 1
    inside: list[bool] = []  # below an article, by tag or name
    for i, (name, tag, above) in enumerate(zip(names, tags, parent, strict=True)):
        kinds = {_OF_NAME[w] for w in name.replace("-", " ").replace("_", " ").split() if w in _OF_NAME} if name else set()
        within = above >= 0 and inside[above]
        for k in kinds:
            x[i, at + k + (len(NAMES) if within else 0)] = 1
        inside.append(within or tag in ("article", "main") or _MAIN in kinds)
    at += 2 * len(NAMES)
    for count in (own_of, below):
        x[rows, at + np.searchsorted(LENGTHS, count, "right")] = 1
        at += len(LENGTHS) + 1
    x[rows, at + np.searchsorted(LINKS, linked / np.maximum(below, 1), "right")] = 1
    at += len(LINKS) + 1
    x[rows, at] = np.minimum(np.array(dots), 5) / 5
    x[rows, at + 1] = 1
    inline = np.array([t not in BLOCK for t in tags], np.int64)
    # a line's elements have their own potential only where no line is around them
    in_line = (inline == 1) & (parent_of >= 0) & (np.array(tags)[np.maximum(parent_of, 0)] != "body") & (parent_of > 0)
    x[in_line, : N_FEATURES - 1] = 0
    named = x[:, len(TAGS) + 1 : len(TAGS) + 1 + 2 * len(NAMES)].any(axis=1) | np.isin(np.array(tags), ["article", "main", "nav", "header", "footer", "aside", "form", "section"])
    return Forest(x, parent_of, np.where(inline == 1, 0, np.where(named, 2, 1)), depth_of)


@dataclass
class Model:
    """Weights of the state "main", and log potentials [kind of child, parent's state, child's state]."""

    weight: np.ndarray
    pair: np.ndarray


def marginals(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """P(main) of each element, and P(parent's state, own state) (zeros for roots), by messages up and down."""
    n = len(f.parent)
    node = np.zeros((n, 2))
    node[:, 1] = f.features @ m.weight
    up = node.copy()  # own potential and all messages from below
    message = np.zeros((n, 2))  # to the parent
    levels = [np.flatnonzero(f.depth == d) for d in range(int(f.depth.max(initial=0)) + 1)]
    for rows in reversed(levels[1:]):
        to = np.logaddexp.reduce(up[rows][:, None, :] + m.pair[f.kind[rows]], axis=2)
        message[rows] = to - to.max(axis=1, keepdims=True)
        np.add.at(up, f.parent[rows], message[rows])
    belief = up.copy()
    both = np.zeros((n, 2, 2))
    for rows in levels[1:]:
        outside = belief[f.parent[rows]] - message[rows]
        joint = outside[:, :, None] + m.pair[f.kind[rows]] + up[rows][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        both[rows] = joint
        belief[rows] = np.log(np.maximum(joint.sum(axis=1), 1e-300))
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
    return p[:, 1] / p.sum(axis=1) if n else np.zeros(0), both


def fit(pages: list[str]) -> Model:
    """Weights of highest penalised likelihood of labelled pages (see :mod:`labelled_pages`), by gradient steps."""
    trees = [read(p) for p in pages]
    state: list[int] = []
    for t in trees:
        base = len(state)
        for name, parent in zip(t.attributes, t.parent, strict=True):
            state.append(1 if "data-main=1" in name else 0 if "data-main=0" in name or parent < 0 else state[base + parent])
    f, y = forest(trees), np.array(state)
    child = np.flatnonzero(f.parent >= 0)
    seen_pairs = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pairs, (f.kind[child], y[f.parent[child]], y[child]), 1)
    seen = f.features.T @ y
    m = Model(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    size_w, size_p = np.full(N_FEATURES, 1e-6), np.full((KINDS, 2, 2), 1e-6)
    for _ in range(STEPS):
        p, both = marginals(f, m)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[child], both[child])
        g_w, g_p = seen - f.features.T @ p - 0.5 * m.weight, seen_pairs - expected - 0.5 * m.pair
        size_w += g_w * g_w
        size_p += g_p * g_p
        m.weight += 0.6 * g_w / np.sqrt(size_w)
        m.pair += 0.6 * g_p / np.sqrt(size_p)
    return m


def main_texts(pages: list[str], m: Model) -> list[str]:
    """The kept text of each page, white space as single blanks."""
    trees = [read(p) for p in pages]
    f = forest(trees)
    p, _ = marginals(f, m)
    out, base = [], 0
    for t in trees:
        of = p[base : base + len(t.tag)]
        most = max((of[e] for e, x in t.runs if x.strip()), default=0.0)
        least = 0.5 if most >= 0.5 else 0.0 if len(t.tag) == 1 else max(most / 2, LIKELY)
        out.append(" ".join("".join([" " if x == "\n" else x for e, x in t.runs if of[e] >= least or x == "\n"]).split()))
        base += len(t.tag)
    return out


def extract(pages: DataFrame, m: Model, *, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, and the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(m)
    keep = [f for f in pages.schema if f.name not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(start, PAGES_AT_ONCE)
                texts = main_texts(some.column(html).fill_null("").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in keep), pa.array(texts, pa.string())], [*(f.name for f in keep), out])

    return pages.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` string"]))
