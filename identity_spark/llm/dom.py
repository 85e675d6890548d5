"""A forgiving reader of HTML into a flat tree: elements with parents, and runs of text with their element."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

#: Comments, declarations, and tags. A value is quoted only after an equals sign, and a quote that nothing closes is a
#: character as any other, so text is never taken for a value.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their contents are characters and no markup, and no page shows them as its text.
RAW = frozenset("script style textarea title".split())
#: What isn't here stands in a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt iframe noscript template fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu"
    " menuitem meta nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio canvas select".split()
) | RAW
#: Opening one of these ends an open one of the named kinds, up to the next container.
ENDS = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "body": frozenset(["head"]),
}
CONTAINERS = frozenset("html body div section article main aside nav header footer form table td th ul ol dl blockquote".split())


@dataclass
class Page:
    """Element i has tag[i], attributes[i] and parent[i] (-1 for the root, element 0); text runs are in page order."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (element, text); "\n" stands between blocks


def _named(attributes: str) -> str:
    """id, class and role in lower case, apart from marks of labelled pages."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("id", "class", "role", "data-main"):
            value = entities.unescape(m[2] or m[3] or m[4] or "").lower()
            found.append(f"data-main={value}" if m[1].lower() == "data-main" else value)
    return " ".join(found)


def read(page: str) -> Page:
    """Elements and texts of a page; whatever it holds, some tree comes out."""
    out = Page()
    stack = [0]
    at, n = 0, len(page)
    unclosed: set[str] = set()  # tags that nothing closes in the rest of the page

    def text(raw: str) -> None:
        if raw:
            out.runs.append((stack[-1], entities.unescape(raw)))

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            out.runs.append((stack[-1], "\n"))
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if out.tag[stack[k]] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and out.tag[stack[k]] in BLOCK:
                    break
            continue
        if tag in RAW:
            # one that nothing closes takes the rest, as in browsers
            close = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*+)?>", re.I).search(page, at) if tag not in unclosed else None
            if close is None:
                unclosed.add(tag)
                at = n
            else:
                at = close.end()
            continue
        if tag in ("html", "body") and any(out.tag[i] == tag for i in stack):
            continue
        for k in range(len(stack) - 1, 0, -1):
            if out.tag[stack[k]] in ENDS.get(tag, ()):
                del stack[k:]
            elif out.tag[stack[k]] in CONTAINERS:
                break
        out.tag.append(tag)
        out.attributes.append(_named(m[3]) if m[3] else "")
        out.parent.append(stack[-1])
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(len(out.tag) - 1)
    return out
