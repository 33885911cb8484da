import html as entities
import re
import time

import numpy as np
import pytest

from palimpsest.llm import block_labeller, html_extract, queries
from palimpsest.llm.html_blocks import blocks_of

SAYINGS = ["The council met on Tuesday to discuss the new bridge, which has been delayed twice.", "Nobody expected the river to rise so fast; the old mill was lost within hours.",
           "In 1998, a survey of 200 farms found that most wells were too shallow.", "Short one.", "She said that the plan, however costly, would go ahead next spring."]


@pytest.fixture(scope="module")
def net():
    return html_extract.fit([f"<p>{s}</p>" for s in SAYINGS])


def said(page):
    return [b.text for b in blocks_of(page)]


def test_blocks_and_references():
    assert said("<p>a <b>b</b>c&amp;d&nbsp;&eacute;&#8211;&#x41; &unknown; &am<p>next<div>x<br>y\n\t z</div>w") == ["a bc&d é–A &unknown; &am", "next", "x y z", "w"]
    assert said("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b<ul><li>c</ul></ul><dl><dt>t<dd>d</dl>") == ["1", "2", "3", "a", "b", "c", "t", "d"]
    assert said('a<script>if (a < b) "</p>"</script>b<style>p{}</style><!-- <p>no</p> -->c<textarea>t</textarea><SCRIPT>x</Script >d') == ["abcd"]
    assert said('<a title="x > y" href=\'<p>\'>link</a> 1 < 2 <!doctype html><?xml ?></ >z') == ["link 1 < 2 z"]
    assert said("<select><option>a<option>b</select><noscript>n</noscript><button>Go</button><svg><text>s</text></svg>t") == ["t"]


def test_pages_that_end_anywhere():
    page = '<div class="a"><p>one<p title="t>">two <b>three</b></div><!-- c --><script>x</script><p>four &amp; five'
    for i in range(len(page) + 1):
        assert all(t.strip() == t and t for t in said(page[:i]))
    assert said('<p>one</p><p class="x') == said("<p>one</p><!-- x") == said("<p>one</p><script>x") == ["one"]


def test_paths():
    b = blocks_of('<body class="z"><div id="page"><ul class="siteNav main-menu" role="navigation"><li hidden>x <a>yz</a></li></ul><p>t</div>u')
    assert b[0].path == ("<li", "<.hidden", "ul", ".site", ".nav", ".main", ".menu", ".navigation", "div", ".page") and b[0].n_linked == 2
    assert b[1].path == ("<p", "div", ".page") and b[2].path == ()


@pytest.mark.parametrize("unit", ["<", "<a ", '<a b="', "<!--", "</", "<p>a", "<div>a", "</div>", "<td>a</x>", "&amp", "<script>", "<p class='", "<div><table><td><p></div>", "&#", "<a b=c ", "a ", "<li>x<ul>"])
def test_hostile_pages_take_linear_time(net, unit):
    page = unit * (1_000_000 // len(unit))
    began = time.time()
    blocks = blocks_of(page)
    assert time.time() - began < 4
    assert len(blocks) < 400_000


def test_gradients_are_those_of_the_loss():
    pages = block_labeller.laid_out(3, SAYINGS)
    inputs, labels = block_labeller.Inputs([b for b, _ in pages]), np.array([y for _, own in pages for y in own])
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in block_labeller.new_net().items()}
    for k in ("paths", "words"):
        net[k] += rng.normal(0, 0.1, net[k].shape)
    _, g = block_labeller.gradients(net, inputs, labels)
    for k, v in net.items():
        flat, own = v.reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            was, each = flat[i], []
            for step in (0.01, -0.01):
                flat[i] = was + step
                each.append(block_labeller.gradients(net, inputs, labels)[0])
            flat[i] = was
            assert (each[0] - each[1]) / 0.02 == pytest.approx(own[i], rel=0.02, abs=2e-4)


def test_labels_do_not_depend_on_the_pages_beside(net):
    pages = [b for b, _ in block_labeller.laid_out(40, SAYINGS, seed=3)] + [[]]
    alone = [block_labeller.label(net, [p])[0].tolist() for p in pages]
    assert [x.tolist() for x in block_labeller.label(net, pages)] == alone
    assert [x.tolist() for x in block_labeller.label(net, pages, cells=4)] == alone


def test_held_out_layouts(net):
    """Pages laid out by another seed, with words that training never saw."""
    pages = block_labeller.laid_out(200, ["Vorbi zant melo, quirp sande ulo vex.", "Tamrin olde, flass nour bint."], seed=77)
    right = np.concatenate([x == np.array(y, bool) for x, (_, y) in zip(block_labeller.label(net, [b for b, _ in pages]), pages, strict=True)])
    assert right.mean() > 0.98


MAIN = "<h1>River floods the old town</h1>" + "".join(f"<p>{s}</p>" for s in SAYINGS)
WANTED = " ".join(["River floods the old town", *SAYINGS])
PARTS = {
    "plain": MAIN,
    "menus": f'<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav><main>{MAIN}</main><footer><p>© 2020 The Paper. All rights reserved.</p></footer>',
    "divs": f'<div id="header"><div class="logo">The Paper</div></div><div id="wrapper"><div class="post-content">{MAIN}</div><div class="sidebar"><h3>Popular</h3><p>{SAYINGS[1]}</p></div></div><div id="footer">Impressum</div>',
    "comments": f'<article class="post">{MAIN}</article><div id="comments"><h3>2 comments</h3><div class="comment"><p>{SAYINGS[0]}</p></div><div class="comment"><p>{SAYINGS[4]}</p></div></div>',
    "notices": f'<div class="cookie-banner"><p>We use cookies to improve your experience.</p><a href="#">Accept</a></div><div class="ad">{SAYINGS[2]}</div><div class="content">{MAIN}<div class="ad"><p>Buy now</p></div></div>',
    "form": f'<form class="search"><label>Search</label><input></form><div class="entry">{MAIN}</div><form action="/s"><p>Subscribe to our newsletter</p><label>Email address</label><input><button>Go</button></form>',
    "script": f'<head><title>x</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><article><!-- no -->{MAIN}</article>',
    "cut": f"<nav><a>Home</a></nav><article>{MAIN}</article><footer><p>Contact us",
}


@pytest.mark.parametrize("part", PARTS)
def test_the_article_without_what_surrounds_it(net, part):
    got = next(html_extract.main_texts(net, iter([PARTS[part]])))
    assert got == WANTED


def test_rows_are_kept_whatever_they_hold(spark, net):
    rows = [(1, "u", MAIN, "x", 5), (None, None, None, None, None), (2, "u", "", "x", 1), (2, "u", "<div></div>", "y", 2), (1, "u", MAIN, "x", 5), (3, "v", f"<article>{'<p>word word word word.</p>' * 30000}</article>", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = sorted(html_extract.extract(pages, net=net).collect(), key=str)
    assert len(got) == 6 and [r["n_chars"] for r in got if r["id"] == 1] == [len(WANTED)] * 2
    assert sorted(r["text"] for r in got if r["id"] in (2, None)) == ["", "", ""] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["id"] == 3)["text"].count("word") > 100_000
    assert html_extract.extract(pages.where("false")).collect() == []


def by_hand(page):
    """The article element's text: blocks here end at p and h1 tags only."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)
    return " ".join(x for x in (" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside[1] if inside else "")) if x)


def test_query_on_all_pages(spark, sf_dir):
    """The given pages have one article each; what the network marks has to be that."""
    got = {r["page_id"]: r["text"] for r in queries.op12_html(spark, sf_dir).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    wrong = [k for k, t in got.items() if t != by_hand(pages[k])]
    assert len(wrong) <= len(pages) // 100
