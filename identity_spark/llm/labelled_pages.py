"""Pages with labels, on which the extraction model is trained.

Elements marked data-main="1" hold main text, those marked data-main="0" don't; an element without a mark is as its
parent. Pages are put together from parts by a seeded rule: layouts of sites of different kinds, with the same parts
under different tags and names."""

from __future__ import annotations

import random

#: Syllables of words without meaning; no word matters to the model.
SYLLABLES = "ka ro mi tel sun dar ve lo pin gra sto mer al fen bu wi cho ra".split()
HEADERS = ['<header data-main="0"><a href="/">{w}</a><p>{s}</p></header>', '<div id="masthead" data-main="0"><h1>{w}</h1><span>{s}</span></div>', '<div class="site-header top" data-main="0">{w}</div>', ""]
MENUS = [
    '<nav data-main="0"><ul>{links}</ul></nav>', '<ul class="menu" data-main="0">{links}</ul>', '<div id="main-menu" role="navigation" data-main="0">{flat}</div>',
    '<div class="breadcrumbs" data-main="0">{flat}</div>', '<table class="navbar" data-main="0"><tr><td>{flat}</td></tr></table>', "",
]
ADVERTS = ['<div class="ad" data-main="0">{s}</div>', '<div class="advert banner" data-main="0"><p>{p}</p></div>', '<aside class="sponsored" data-main="0"><a href="/x">{s}</a></aside>', '<section class="promo-box" data-main="0"><p>{s}</p></section>', ""]
NOTICES = ['<noscript data-main="0"><p>{s}</p></noscript>', '<noscript data-main="0">{s}</noscript>', '<div class="cookie-notice" data-main="0"><p>{s}</p><button>{w}</button></div>', '<div id="newsletter" data-main="0"><form><label>{s}</label><input name="e"></form></div>', '<div class="alert" role="alert" data-main="0">{s}</div>', '<form action="/q" data-main="0"><p>{s}</p><input name="q"></form>', ""]
CONTENTS = [
    '<article data-main="1">{inner}</article>', '<main data-main="1">{inner}</main>', '<main><article data-main="1">{inner}</article></main>', '<div id="content" data-main="1">{inner}</div>', '<div class="post-body" data-main="1">{inner}</div>',
    '<div class="wrapper"><div class="entry-content" data-main="1">{inner}</div></div>', '<div id="page"><section class="story text" data-main="1">{inner}</section></div>', '<table><tr><td data-main="1">{inner}</td></tr></table>', '<div><div data-main="1">{inner}</div></div>',
]
BLOCKS = ["<p>{p}</p>", "<p>{p}", "<p><b>{s}<br><p>{p}</p>", "<h2>{s}</h2><p>{p}</p>", "<ul><li>{s}</li><li>{s}</li></ul>", "<blockquote><p>{p}</p></blockquote>", "<div>{p}</div>", "<pre>{s}</pre>", "<p>{s} <a href='/y'>{w}</a> <em>{w}</em> {p}</p>", "<table><tr><td>{w}</td><td>{s}</td></tr></table>", "<figure><img src='z.png'><figcaption>{s}</figcaption></figure>", "<p>{w}.</p>"]
#: Paragraphs with many links, and parts of an article under names that elsewhere speak of something else.
LINKED = ["<p>{s} <a href='/y'>{s}</a> {w} <a href='/z'>{w} {w}</a>, {s}</p>", "<p>{w} <a href='/y'>{w} {w} {w}</a> {w} <a href='/z'>{w} {w}</a>.</p>", "<p><a href='/y'>{s}</a> {p}</p>", "<ul><li><a href='/y'>{w}</a>: {s}</li><li>{s} <a href='/z'>{w}</a></li></ul>"]
UNUSUAL = ['<div class="more"><p>{p}</p></div>', '<div class="review"><h2>{s}</h2><p>{p}</p><p>{p}</p></div>', '<div class="related-work"><p>{p}</p></div>', '<section class="notice"><p>{p}</p></section>', '<div class="header"><h2>{s}</h2></div>', '<div class="side text"><p>{p}</p></div>', '<div class="top"><p>{s}</p><p>{p}</p></div>']
#: Articles whose own name speaks of something else.
PLAIN = ['<div class="review" data-main="1">{inner}</div>', '<div class="wrap"><article class="more" data-main="1">{inner}</article></div>', '<div class="page-top" data-main="1">{inner}</div>']
INSIDE = ['<div class="share" data-main="0">{flat}</div>', '<aside class="related" data-main="0"><h3>{w}</h3><ul>{links}</ul></aside>', '<div class="ad-slot" data-main="0">{s}</div>', '<footer data-main="0"><p>{s}</p></footer>', '<nav data-main="0">{flat}</nav>', '<form data-main="0"><label>{w}</label><input></form>', '<header data-main="0"><span>{w}</span></header>']
COMMENTS = ['<section id="comments" data-main="0"><h2>{w}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section>', '<div class="discussion" data-main="0"><ol><li class="reply"><p>{p}</p></li></ol></div>', '<ul class="comment-list" data-main="0"><li>{p}</li><li>{s}</li></ul>', "", ""]
SIDES = ['<aside data-main="0"><h3>{w}</h3><p>{p}</p><ul>{links}</ul></aside>', '<div id="sidebar" data-main="0"><p>{p}</p><p>{s}</p></div>', '<div class="widget" data-main="0"><h4>{w}</h4>{flat}</div>', "", ""]
FOOTERS = ['<footer data-main="0">&copy; {w} &middot; {s}</footer>', '<div id="footer" data-main="0"><p>{s}</p>{flat}</div>', '<div class="copyright legal" data-main="0">{s}</div>', ""]


def pages(count: int = 300, seed: int = 5) -> list[str]:
    """``count`` labelled pages, the same each time."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    sentence = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + "."

    def fill(part: str) -> str:
        link = lambda: f'<a href="/{word()}">{word()}</a>'
        for key, make in (("{links}", lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6)))), ("{flat}", lambda: " | ".join(link() for _ in range(rng.randint(2, 6)))), ("{p}", lambda: " ".join(sentence(5, 18) for _ in range(rng.randint(1, 8)))), ("{s}", lambda: sentence(3, 12)), ("{w}", word)):
            while key in part:
                part = part.replace(key, make(), 1)
        return part

    out = []
    for _ in range(count):
        linked = rng.choice([0, 0, 0.3])  # some sites link a lot, most don't
        block = lambda: fill(rng.choice(LINKED if rng.random() < linked else UNUSUAL if rng.random() < 0.04 else BLOCKS))  # noqa: B023, E731
        inner = [fill(rng.choice(["<h1>{s}</h1>", "<h1>{s}</h1>", "", "<header><h1>{s}</h1></header>"]))] + [block() for _ in range(rng.randint(1, 12))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner.insert(rng.randint(1, len(inner)), fill(rng.choice(INSIDE)))
        comments = fill(rng.choice(COMMENTS))
        if rng.random() < 0.4:
            inner.append(comments)
            comments = ""
        parts = [rng.choice(HEADERS), rng.choice(MENUS), rng.choice(ADVERTS), rng.choice(NOTICES)]
        content = rng.choice(CONTENTS if rng.random() < 0.95 else PLAIN)
        body = "".join(map(fill, parts)) + content.replace("{inner}", "".join(inner)) + comments
        body += "".join(map(fill, [rng.choice(SIDES), rng.choice(ADVERTS), rng.choice(NOTICES), rng.choice(FOOTERS)]))
        out.append(f'<!DOCTYPE html><html><head><title>{word()}</title></head><body data-main="0">{body}</body></html>')
    return out
