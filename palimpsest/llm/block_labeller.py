"""A recurrent network in NumPy that marks the blocks of a page as main text or not.

A block is read as the sum of its tag path's vectors, the mean of its words' vectors, both by
hash, and a few measures. A bidirectional LSTM reads the blocks of a page in order, so that each
is judged in the context of the whole page. It is trained by gradients through time on pages laid
out here, whose blocks are known, and on pages that mark their article themselves.
"""

from __future__ import annotations

import random
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .html_blocks import Block, blocks_of
from .words import words_of

PATHS, WORDS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 1 << 12, 1 << 13, 16, 8, 8, 24
SIZE = PATH_SIZE + WORD_SIZE + MEASURES
Net = dict[str, np.ndarray]


@lru_cache(maxsize=1 << 16)
def path_bucket(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little") % PATHS


@lru_cache(maxsize=1 << 14)
def path_buckets(path: tuple[str, ...]) -> list[int]:
    return [path_bucket(x) for x in path]


def _sums(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows between neighbouring cuts."""
    out = np.zeros((len(cuts) - 1, rows.shape[1]), rows.dtype)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        out[some] = np.add.reduceat(rows, cuts[some], axis=0)
    return out


class Inputs:
    """Hashes and measures of blocks; what the network reads, whatever its weights."""

    def __init__(self, pages: list[list[Block]]) -> None:
        blocks = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages])
        paths = [path_buckets(b.path) for b in blocks]
        self.path_cuts = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        self.paths = np.array([x for p in paths for x in p], np.int64)
        size = np.array([len(b.text) for b in blocks], np.float32)
        buckets, cuts, capital, digits = [], [np.zeros(1, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for w in words_of(pa.array([b.text for b in blocks], pa.string()), lower=True):
            buckets.append((w.hashes % np.uint64(WORDS)).astype(np.int64))
            cuts.append(w.bounds[1:] + cuts[-1][-1])
            first = w.data[w.starts]
            capital.append(np.bincount(w.row, (first >= 65) & (first <= 90), w.n_rows))
            digits.append(np.bincount(w.row, (first >= 48) & (first <= 57), w.n_rows))
        self.words, self.word_cuts = np.concatenate([np.zeros(0, np.int64), *buckets]), np.concatenate(cuts)
        n_words = np.diff(self.word_cuts).astype(np.float32)
        last = np.array([b.text[-1] in ".!?…:;\"»”" for b in blocks], np.float32)
        commas = np.array([b.text.count(",") for b in blocks], np.float32)
        place = np.concatenate([np.zeros(0), *(np.arange(n) / max(1, n) for n in self.lengths)])
        many = np.maximum(n_words, 1)
        self.measures = np.stack([
            np.log1p(n_words) / 4, np.log1p(size) / 6, np.array([b.n_linked for b in blocks], np.float32) / np.maximum(size, 1), last,
            np.minimum(commas / many * 5, 1), np.concatenate(capital) / many, np.concatenate(digits) / many, place,
        ], axis=1).astype(np.float32) if blocks else np.zeros((0, MEASURES), np.float32)

    def vectors(self, net: Net) -> np.ndarray:
        path = _sums(net["paths"][self.paths], self.path_cuts)
        word = _sums(net["words"][self.words], self.word_cuts) / np.maximum(np.diff(self.word_cuts), 1)[:, None]
        return np.concatenate([path, word.astype(np.float32), self.measures], axis=1)


def new_net(seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    bias = np.zeros((2, 4 * HIDDEN), np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return {
        "paths": np.zeros((PATHS, PATH_SIZE), np.float32), "words": np.zeros((WORDS, WORD_SIZE), np.float32),
        "wx": draw(2, SIZE, 4 * HIDDEN, by=SIZE**-0.5), "wh": draw(2, HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5), "b": bias,
        "out": draw(2 * HIDDEN + SIZE, by=0.1), "shift": np.zeros(1, np.float32),
    }


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks in a row after each other: (page, step) of each, and of each in reverse order."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return page, step, lengths[page] - 1 - step


def _gates(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sigmoids of the first three quarters (in, keep, out) and the tanh of the last."""
    z[..., : 3 * HIDDEN] *= 0.5
    np.tanh(z, out=z)
    return 0.5 * z[..., : 3 * HIDDEN] + 0.5, z[..., 3 * HIDDEN :]


def forward(net: Net, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Margins of the blocks x of pages of those lengths; with keep, also what training needs."""
    page, step, back = _padded(lengths)
    t = int(lengths.max(initial=0))
    n, h = len(lengths), HIDDEN
    ahead = x @ net["wx"][0] + net["b"][0], x @ net["wx"][1] + net["b"][1]
    z = np.zeros((t, 2, n, 4 * h), np.float32)
    z[step, 0, page], z[back, 1, page] = ahead
    state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    states = np.empty((t, 2, n, h), np.float32)
    kept = {"gates": np.empty((t, 2, n, 3 * h), np.float32), "new": np.empty_like(states), "cells": np.empty_like(states)} if keep else {}
    for k in range(t):
        gates, new = _gates(z[k] + state @ net["wh"])
        cell = gates[..., h : 2 * h] * cell + gates[..., :h] * new
        state = gates[..., 2 * h :] * np.tanh(cell)
        states[k] = state
        if keep:
            kept["gates"][k], kept["new"][k], kept["cells"][k] = gates, new, cell
    both = np.concatenate([states[step, 0, page], states[back, 1, page], x], axis=1)
    return both @ net["out"] + net["shift"][0], kept | {"states": states, "both": both, "where": (page, step, back)}


def gradients(net: Net, inputs: Inputs, labels: np.ndarray) -> tuple[float, Net]:
    """Mean cross entropy of the blocks, and its derivatives by all weights."""
    x, h = inputs.vectors(net), HIDDEN
    margin, kept = forward(net, x, inputs.lengths, keep=True)
    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    loss = float(-np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-9)))
    d = ((p - labels) / len(labels)).astype(np.float32)
    out = {"out": kept["both"].T @ d, "shift": np.array([d.sum()], np.float32)}
    both = d[:, None] * net["out"]
    dx = both[:, 2 * h :].copy()
    page, step, back = kept["where"]
    t, _, n, _ = kept["states"].shape
    ds = np.zeros((t, 2, n, h), np.float32)
    ds[step, 0, page], ds[back, 1, page] = both[:, :h], both[:, h : 2 * h]
    dz = np.empty((t, 2, n, 4 * h), np.float32)
    state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    across = net["wh"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        gates, new, c = kept["gates"][k], kept["new"][k], np.tanh(kept["cells"][k])
        i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
        s = ds[k] + state
        cell = cell + s * o * (1 - c * c)
        before = kept["cells"][k - 1] if k else 0
        dz[k] = np.concatenate([cell * new * i * (1 - i), cell * before * f * (1 - f), s * c * o * (1 - o), cell * i * (1 - new * new)], axis=-1)
        cell = cell * f
        state = dz[k] @ across
    earlier = np.concatenate([np.zeros((1, 2, n, h), np.float32), kept["states"][:-1]])
    out["wh"] = np.stack([np.tensordot(earlier[:, k], dz[:, k], ((0, 1), (0, 1))) for k in (0, 1)])
    flat = dz[step, 0, page], dz[back, 1, page]
    out["wx"], out["b"] = np.stack([x.T @ z for z in flat]), np.stack([z.sum(axis=0) for z in flat])
    for k in (0, 1):
        dx += flat[k] @ net["wx"][k].T
    for name, at, cuts, a, b, mean in (("paths", inputs.paths, inputs.path_cuts, 0, PATH_SIZE, False), ("words", inputs.words, inputs.word_cuts, PATH_SIZE, PATH_SIZE + WORD_SIZE, True)):
        many = np.diff(cuts)
        own = dx[:, a:b] / np.maximum(many, 1)[:, None] if mean else dx[:, a:b]
        out[name] = np.zeros_like(net[name])
        np.add.at(out[name], at, np.repeat(own, many, axis=0))
    return loss, out


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 10, rate: float = 0.01, batch: int = 24, seed: int = 5) -> Net:
    """The network of (blocks, label of each) pages, by Adam; pages of like length go together."""
    net, rng = new_net(seed), random.Random(seed)
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    groups = [pages[i : i + batch] for i in range(0, len(pages), batch)]
    ready = [(Inputs([b for b, _ in g]), np.array([y for _, own in g for y in own], np.float32)) for g in groups]
    first, second, t = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(ready)
        for inputs, labels in ready:
            _, g = gradients(net, inputs, labels)
            t += 1
            by = rate * 0.75**epoch
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                net[k] -= (by * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def label(net: Net, pages: list[list[Block]], cells: int = 1 << 14) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length go together, `cells` blocks at a time or one page."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        n = max(1, min(len(order), cells // len(pages[order[0]])))
        while n > 1 and len(pages[order[n - 1]]) * n > 2 * cells:
            n //= 2
        now, order = order[:n], order[n:]
        inputs = Inputs([pages[i] for i in now])
        margin, _ = forward(net, inputs.vectors(net), inputs.lengths)
        for i, own in zip(now, np.split(margin > 0, np.cumsum(inputs.lengths)[:-1]), strict=True):
            out[i] = own
    return out


# What pages are laid out from: names that sites give to their parts, and the parts' usual words.
_NAMES = {
    "main": "content main main-content page-content article post entry entry-content post-content article-body article-content story story-body post-body body-text text hentry single blog-post news-item wiki-content mw-parser-output markdown documentation richtext contenu inhalt contenido",
    "wrap": "page wrapper container site row col-md-8 layout inner outer grid columns column center section block box app root primary wrap",
    "menu": "nav menu navbar navigation main-menu mainnav topnav nav-menu breadcrumb breadcrumbs tabs pagination pager toc links site-nav sidenav dropdown submenu",
    "header": "header site-header masthead top topbar banner branding logo page-header head site-title tagline toolbar",
    "footer": "footer site-footer bottom colophon copyright footer-links page-footer foot legal credits imprint",
    "sidebar": "sidebar side aside widget widgets widget-area rail right-rail secondary complementary left-col right-col related related-posts recommended popular trending tags tag-cloud archives",
    "notice": "cookie cookies cookie-banner consent gdpr notice alert banner popup modal overlay privacy-notice subscribe-banner paywall warning message announcement toast",
    "ad": "ad ads advert advertisement advertising sponsored sponsor promo promoted promotion adsense ad-slot ad-container banner-ad partner commercial dfp",
    "form": "form search search-form login signup newsletter subscribe contact-form register searchbox subscription",
    "comments": "comments comment comment-list commentlist comment-body comments-area responses discussion replies reader-comments disqus comment-content respond kommentare commentaires comentarios feedback reply",
    "share": "share sharing social social-links share-buttons addthis meta post-meta byline tools print",
}
_SHORT = {
    "menu": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Archive|Help|FAQ|Search|Start|Startseite|Kontakt|Accueil|Contactez-nous|Inicio|Contacto|Next|Previous|Back to top|Skip to content|Sitemap|Shop|Sports|Politics|Business|Technology|Culture|Weather",
    "header": "Daily News|The Blog|Welcome|My Site|Official website|Free shipping on all orders|Open daily from 9 to 5|Today's paper",
    "footer": "Copyright © 2021 All rights reserved.|© 2019 Company Inc.|Privacy policy|Terms of use|Terms of service|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by WordPress|Contact us|Careers|Accessibility|All rights reserved|Alle Rechte vorbehalten|Tous droits réservés",
    "sidebar": "Related articles|Popular posts|Recent posts|Recent comments|Categories|Archives|Tags|Most read|You may also like|Read more|Follow us|Trending now|Meistgelesen|À lire aussi|Más leídas|Top stories",
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our cookie policy.|Accept all cookies|Accept|Reject all|Cookie settings|You have reached your limit of free articles.|Please enable JavaScript to view this page.|Wir verwenden Cookies.|Nous utilisons des cookies.|Utilizamos cookies.|Subscribe now to continue reading.",
    "ad": "Advertisement|Sponsored content|Buy now and save 50%|Limited offer|Anzeige|Publicité|Publicidad|Click here to learn more|Shop the sale today|Sponsored by our partners",
    "form": "Search|Email address|Password|Subscribe to our newsletter|Sign up for free|Your name|Your email|Send message|Log in to your account|Enter your search terms|Forgot your password?|Newsletter abonnieren",
    "comments": "Comments|3 comments|Leave a comment|Leave a reply|Reply|Log in to comment|Posted by a reader|Anonymous says:|Kommentare|Commentaires|Comentarios|Add a comment|Report abuse",
    "share": "Share on Facebook|Tweet|Share this|Print|Email this article|By Staff Writer|Posted on 3 May 2020|Tags: news|Filed under: world|5 min read",
}
_SHORT = {k: v.split("|") for k, v in _SHORT.items()}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_MAIN, _OTHER = "\ue000", "\ue001"


class _Layout:
    """Lays out one page; each text begins with a mark of what it is."""

    def __init__(self, rng: random.Random, texts: list[str]) -> None:
        self.rng, self.texts, self.plain = rng, texts, rng.random() < 0.2  # plain pages name nothing

    def some(self, most: float = 1.0) -> bool:
        return self.rng.random() < most

    def named(self, part: str) -> str:
        if self.plain or self.some(0.1):
            return ""
        names = self.rng.sample(_NAMES[part], self.rng.choice([1, 1, 2])) + (self.rng.sample(_NAMES["wrap"], 1) if self.some(0.15) else [])
        return f' {self.rng.choice(["class", "class", "id"])}="{" ".join(names)}"'

    def words(self, least: int, most: int) -> str:
        out: list[str] = []
        n = self.rng.randrange(least, most)
        while len(out) < n:
            out += self.rng.choice(self.texts).split()[: n - len(out)]
        return " ".join(out)

    def escaped(self, mark: str, text: str) -> str:
        return mark + text.replace("&", "&amp;").replace("<", "&lt;")

    def paragraph(self, mark: str, least: int = 1, most: int = 90) -> str:
        text = self.escaped(mark, self.words(least, least + 5) if self.some(0.2) else self.words(least, most))
        if self.some(0.3):
            head, _, tail = text.partition(" ")
            text = f"{head} <{(t := self.rng.choice(['b', 'i', 'em', 'strong', 'a', 'span']))}>{tail}" + (f"</{t}>" if self.some(0.8) else "")
        if self.some(0.1):
            text += "<br>" + self.words(2, 12)
        return f"<p>{text}" + ("</p>" if self.some(0.9) else "")

    def heading(self, mark: str, level: int) -> str:
        return f"<h{level}>{self.escaped(mark, self.words(1, 10))}</h{level}>"

    def main(self, n: int) -> str:
        out = []
        for _ in range(n):
            kind = self.rng.random()
            if kind < 0.72:
                out.append(self.paragraph(_MAIN))
            elif kind < 0.8:
                out.append(self.heading(_MAIN, self.rng.choice([2, 3])))
            elif kind < 0.87:
                tag = self.rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.escaped(_MAIN, self.words(1, 25))}</li>" for _ in range(self.rng.randrange(1, 6))) + f"</{tag}>")
            elif kind < 0.91:
                out.append(f"<blockquote>{self.paragraph(_MAIN)}</blockquote>")
            elif kind < 0.94:
                rows = "".join("<tr>" + "".join(f"<td>{self.escaped(_MAIN, self.words(1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randrange(1, 4)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.97:
                out.append(f'<figure><img src="x.png"><figcaption>{self.escaped(_MAIN, self.words(2, 15))}</figcaption></figure>')
            else:
                out.append(f"<pre>{self.escaped(_MAIN, self.words(2, 30))}</pre>")
        return "".join(out)

    def links(self, part: str, least: int = 2, most: int = 9) -> str:
        entry = lambda: self.escaped(_OTHER, self.rng.choice(_SHORT[part]) if self.some(0.5) else self.words(1, 5))
        each = [f'<a href="/{i}">{entry()}</a>' for i in range(self.rng.randrange(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.some(0.75) else "".join(f"<div>{x}</div>" for x in each)

    def boiler(self, part: str) -> str:
        """A part that isn't main text: short phrases, links, or a passage like any other."""
        tags = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div"], "form": ["form", "div"], "comments": ["section", "div", "div"]}
        tag = self.rng.choice(tags.get(part, ["div", "div", "section", "aside"]))
        # without a telling name the words or the tag have to tell
        name = self.named(part) if tag in ("nav", "header", "footer", "aside", "form") else f' class="{self.rng.choice(_NAMES[part])}"'
        phrase = lambda: f"<{(t := self.rng.choice(['p', 'div', 'span', 'li' if tag == 'ul' else 'p']))}>{self.escaped(_OTHER, self.rng.choice(_SHORT[part]))}</{t}>"
        if part == "menu":
            inside = self.links(part) if tag != "ul" else "".join(f'<li><a href="#">{self.escaped(_OTHER, self.words(1, 3))}</a></li>' for _ in range(4))
        elif part == "form":
            inside = "".join(f'<label>{self.escaped(_OTHER, self.rng.choice(_SHORT[part]))}</label><input type="text">' for _ in range(self.rng.randrange(1, 3))) + "<button>Go</button>"
        elif part == "comments":
            one = lambda: f"<{(t := self.rng.choice(['div', 'li', 'article']))}{self.named('comments')}>" + (phrase() if self.some(0.5) else "") + self.paragraph(_OTHER, 2, 70) + f"</{t}>"
            inside = (self.heading(_OTHER, 3) if self.some(0.4) else phrase()) + "".join(one() for _ in range(self.rng.randrange(1, 6))) + (self.boiler("form") if self.some(0.4) else "")
        elif part == "sidebar":
            inside = (self.heading(_OTHER, 3) if self.some(0.6) else "") + (self.links(part) if self.some(0.6) else self.paragraph(_OTHER, 3, 60))
        elif self.some(0.45):
            inside = self.escaped(_OTHER, self.words(2, 30))  # any words, as in main text
            inside = f"<p>{inside}</p>" if self.some(0.5) else inside
        else:
            inside = "".join(phrase() for _ in range(self.rng.randrange(1, 4))) + (self.links(part, 1, 5) if part in ("footer", "header", "share") and self.some(0.4) else "")
        return f"<{tag}{name}>{inside}</{tag}>"

    def page(self) -> str:
        n = self.rng.choice([1, 2, 3, 5, 8, 13, 25])
        before = [self.boiler(p) for p in ("notice", "header", "menu", "menu", "form", "ad", "sidebar") if self.some(0.4)]
        after = [self.boiler(p) for p in ("sidebar", "ad", "notice", "form", "footer", "footer") if self.some(0.45)]
        inner = [(self.heading(_MAIN, 1) if self.some(0.8) else ""), *(self.main(1) for _ in range(n))]
        for part in ("ad", "share", "sidebar", "form", "notice"):
            if self.some(0.15):
                inner.insert(self.rng.randrange(1, len(inner) + 1), self.boiler(part))
        comments = self.boiler("comments") if self.some(0.35) else ""
        if comments and self.some(0.4):
            inner.append(comments)
            comments = ""
        tag = self.rng.choice(["article", "article", "main", "div", "div", "div", "section", "td"])
        body = f"<{tag}{self.named('main')}>{''.join(inner)}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}<td>{self.boiler('sidebar')}</td></tr></table>"
        if self.some(0.3):
            body = f"<{(t := self.rng.choice(['main', 'div', 'article', 'section']))}{self.named('main')}>{body}{comments if self.some(0.5) else ''}</{t}>"
        body = "".join(before) + body + comments + "".join(after)
        for _ in range(self.rng.randrange(3)):
            body = f"<div{self.named('wrap')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


def laid_out(n: int, texts: list[str], seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """n pages with a label for each block; texts fill main text and other parts alike."""
    rng, out = random.Random(seed), []
    texts = [t for t in texts if t.split() and _MAIN not in t and _OTHER not in t] or ["one two three, four five.", "six seven eight nine ten eleven twelve."]
    for _ in range(n):
        blocks, labels = [], []
        for b in blocks_of(_Layout(rng, texts).page()):
            if _MAIN in b.text or _OTHER in b.text:
                labels.append(int(_MAIN in b.text))
                b.text = b.text.replace(_MAIN, "").replace(_OTHER, "")
                blocks.append(b)
        kept = [i for i, b in enumerate(blocks) if b.text]
        out.append(([blocks[i] for i in kept], [labels[i] for i in kept]))
    return out


_WITHIN = frozenset("nav aside footer form header".split())
_APART = frozenset(f".{w}" for part in ("comments", "ad", "notice", "share", "form", "sidebar") for x in _NAMES[part] for w in x.split("-") if w not in ("side", "message", "meta", "tools", "print", "left", "right", "col", "body", "content", "area", "list", "container", "slot"))


def self_marked(blocks: list[Block]) -> tuple[list[Block], list[int]] | None:
    """The page's blocks and labels if it marks its article: within it, and in no part apart from it."""
    bare = lambda x: x[1:] if x[0] == "<" else x
    inside = [{bare(x) for x in b.path} for b in blocks]
    labels = [int(("article" in p or "main" in p) and not p & _WITHIN and not p & _APART) for p in inside]
    return (blocks, labels) if 0 < sum(labels) < len(labels) else None
