"""Main text of pages by hand, of layouts that no given page has."""

from __future__ import annotations

import re

import pytest

from identity_spark.llm import labelled_pages, main_text

P = "A sentence of the article that goes on for a while, with words enough. And another one follows it here."
LINKS = '<p>See <a href="/a">the first report</a> and <a href="/b">the other one</a>.</p>'


def site(body):
    return f'<html><head><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>{body}<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>'


PAGES = {
    "links in a paragraph": (site(f'<div class="wrap"><article>(<p>{P}</p>{LINKS}<p>{P}</p>)</article></div>')),
    "links in all paragraphs": site("<article>(" + "".join(f'<p>{P} <a href="/x">link one</a> and <a href="/y">link two</a> end.</p>' for _ in range(8)) + ")</article>"),
    "a short list of sources": site(f'<div id="content">(<p>{P}</p>{LINKS})</div>'),
    "a part that is named more": site(f'<article>(<h1>Title here</h1><p>{P}</p><div class="more"><p>{P}</p></div><p>{P}</p>)</article>'),
    "a review": site(f'<div class="review">(<h1>A title</h1><p>{P}</p><p>{P}</p>)</div>'),
    "a bare body": f"<html><body>(<p>{P}</p><p>{P}</p>)</body></html>",
    "no body at all": f"(<p>{P}</p><p>{P}</p>)",
    "no tag at all": f"({P})",
    "what is shown without scripts": site(f"<article>(<p>{P}</p><noscript><p>{P}</p></noscript>)</article>"),
    "a menu, an advert and comments": site(f'<div class="ad">Buy now.</div><main>(<h1>Title</h1><p>{P}</p><p>{P}</p>)</main><section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it.</p></div></section>'),
}


@pytest.fixture(scope="module")
def model():
    return main_text.fit(labelled_pages.pages())


@pytest.mark.parametrize("name", PAGES)
def test_sites(model, name):
    page = PAGES[name]
    inner = page[page.index("(") + 1 : page.rindex(")")]
    want = re.sub(r"</?(a)\b[^>]*>", "", inner)
    want = " ".join(re.sub("<[^>]+>", " ", want).split())
    assert main_text.main_texts([page.replace("(", "", 1)[::-1].replace(")", "", 1)[::-1]], model) == [want]


def test_pages_without_an_article_have_no_text(model):
    empty = [site(""), site('<div id="sidebar"><h3>More</h3><ul><li><a href=x>One two</a></li></ul></div>'), site('<div class="cookie"><p>We use cookies. Accept them.</p><button>OK</button></div>'), "", "<p></p>"]
    assert main_text.main_texts(empty, model) == [""] * 5


def test_unseen_pages_of_the_rule(model):
    right = 0
    unseen = labelled_pages.pages(200, seed=99)
    for page in unseen:
        tree = main_text.read(page)
        label = []
        for name, parent in zip(tree.attributes, tree.parent, strict=True):
            label.append(1 if "data-main=1" in name else 0 if "data-main=0" in name or parent < 0 else label[parent])
        want = " ".join("".join([" " if x == "\n" else x for e, x in tree.runs if label[e] or x == "\n"]).split())
        right += main_text.main_texts([page], model) == [want]
    assert right >= 185
