"""Leaf blocks of HTML pages: runs of text that no block element interrupts, with their tag paths.

One scan from left to right, linear in the page's length whatever it holds. Comments, scripts,
styles and other raw or hidden content yield no text; character references are decoded; white
space within a block becomes one space. Unclosed and misnested tags are closed as browsers do in
the common cases; a page may end anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: Elements whose content isn't markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose text isn't shown as such.
DROPPED = frozenset("noscript template svg select datalist button object canvas audio video applet".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements that start and end blocks; so do those with a hyphen in their name.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
) | DROPPED
_ENDS_P = BLOCKS - DROPPED - frozenset("body caption col colgroup head html legend optgroup option tbody td tfoot th thead tr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SCOPES = frozenset("td th caption table template object button".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: What a start tag closes, and the elements that hold that back.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("thead", "tbody"), ("table",)), "tbody": (("thead", "tbody"), ("table",)),
    "tfoot": (("thead", "tbody"), ("table",)), "option": (("option",), ("select", "datalist")),
}
#: Elements of a path that count, from the innermost on, and open elements at most; further ones aren't told apart.
PATH, DEPTH = 16, 512

#: A tag without stray quotes and brackets; other tags are read attribute by attribute.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"'=]*+)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?""")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_NAMING = frozenset("class id role itemprop".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # its element's names first, then those of what holds it
    n_linked: int  # characters in links
    at: int  # the page's character at which it begins


@lru_cache(maxsize=1 << 14)
def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id, role and item property; `hidden` if it says so."""
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in _NAMING:
            out += [f".{w.lower()}" for w in _PARTS.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append(".hidden")
    return tuple(dict.fromkeys(out))


def _tag_end(html: str, at: int) -> int:
    """The place of the tag's closing bracket, from the end of its name on, or -1."""
    end = html.find(">", at)
    if end < 0 or html.find('"', at, end) < 0 and html.find("'", at, end) < 0:
        return end
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            return html.find(">", at)
        at = m.end()


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[str] = []
        self.names: list[tuple[str, ...]] = []
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.dropped = 0
        self.in_link = False
        self.parts: list[str] = []
        self.linked = 0
        self.began = 0

    def text(self, raw: str, at: int) -> None:
        if not self.dropped:
            if not self.parts:
                self.began = at
            shown = unescape(raw) if "&" in raw else raw
            self.parts.append(shown)
            if self.in_link:
                self.linked += len(shown)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                inner, rest = self.names[-1:], self.names[-PATH:-1]
                path = tuple(f"<{x}" for own in inner for x in own) + tuple(x for own in reversed(rest) for x in own)
                self.blocks.append(Block(text, path, min(self.linked, len(text)), self.began))
            self.parts, self.linked = [], 0

    def last(self, *names: str) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def close(self, at: int) -> None:
        """Close the elements from the place `at` on."""
        while len(self.open) > at:
            name = self.open.pop()
            self.names.pop()
            self.where[name].pop()
            if name in _SCOPES:
                self.scopes.pop()
            self.dropped -= name in DROPPED
        self.in_link = False

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        elif name == "br":
            self.text(" ", 0) if self.parts else None
        if name not in BLOCKS and "-" not in name:
            return
        self.flush()
        scope = self.scopes[-1] if self.scopes else -1
        p = self.where.get("p")
        if p and name in _ENDS_P and p[-1] > scope:
            self.close(p[-1])
        if name in _CLOSES:
            ends, holds = _CLOSES[name]
            at = self.last(*ends)
            if at > self.last(*holds) and (at > scope or name in _TABLE):
                self.close(at)
        if name not in VOID and name not in ("html", "head", "body") and len(self.open) < DEPTH:
            self.where.setdefault(name, []).append(len(self.open))
            if name in _SCOPES:
                self.scopes.append(len(self.open))
            self.open.append(name)
            self.names.append(names_of(name, attributes) if len(attributes) < 2000 else names_of.__wrapped__(name, attributes))
            self.dropped += name in DROPPED

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name not in BLOCKS and "-" not in name:
            return
        self.flush()
        at = self.last(*_HEADINGS) if name in _HEADINGS else self.last(name)
        if at >= 0 and (name in _SCOPES or name in _TABLE or not self.scopes or at > self.scopes[-1]):
            self.close(at)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order."""
    page, at, n = _Page(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:], at)
            break
        if lt > at:
            page.text(html[at:lt], at)
        m = _TAG.match(html, lt)
        if m and m[1]:
            page.end(m[2].lower())
            at = m.end()
            continue
        first = m or _NAME.match(html, lt + 1)
        if first:
            if m:
                name, attributes, at = m[2].lower(), m[3], m.end()
            else:
                name, end = first[0].lower(), _tag_end(html, first.end())
                if end < 0:
                    break  # the page ends within the tag
                attributes, at = html[first.end() : end], end + 1
            page.start(name, attributes)
            if name in RAW:
                close = _END[name].search(html, at)
                if not close:
                    break
                end = html.find(">", close.end())
                if end < 0:
                    break
                at = end + 1
        elif html.startswith("</", lt):
            m = _NAME.match(html, lt + 2)
            end = html.find(">", lt + 2) if not m else _tag_end(html, m.end())
            if end < 0:
                break
            if m:
                page.end(m[0].lower())
            at = end + 1
        elif html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
                continue
            end = html.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
        elif html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            if end < 0:
                break
            at = end + 1
        else:
            page.text("<", lt)
            at = lt + 1
    page.flush()
    return page.blocks
