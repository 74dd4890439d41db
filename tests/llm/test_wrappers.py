"""Wrapper inference: expressions, slots, and the main text of sites with and without telling names."""

from __future__ import annotations

import html
import random
import re

import pytest
from corpus_data import SF

from wardops.llm import wrappers
from wardops.llm.frames import table

WORDS = "stone river market winter paper garden letter bridge summer window silver harbour".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def plain(page):
    """The article of the test data's one template, cut out with patterns."""
    page = re.sub(r"<(script|style|title)\b.*?</\1>|<!--.*?-->", "", page or "", flags=re.S)
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found.group(1)) if found else []
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", p))).split()) for p in parts)))


def named_site(rng, i):
    """Everything the contract leaves out, under telling names; some parts are missing on some pages."""
    title, body = sentence(rng, 5), [sentence(rng) for _ in range(rng.randint(1, 6))]
    notice = '<div class="notice"><p>Our terms have changed.</p></div>' if i % 3 else ""
    inner = "".join(f"<h2>{b[:9]}</h2><p>{b}" for b in body)
    page = f"""<!doctype html><HTML lang=en><head><title>{title} - Site</title><style>p > a {{}}</style></head>
    <body class="post has-sidebar"><header><a href=/>The Site</a><p>Daily news</p></header>{notice}
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav>
    <main><article class="post"><header><h1>{title}</h1></header><!-- <p>not this -->
    <aside class="ad">Buy now!</aside>{inner}<p>Caf&eacute; &#8211; a&nbsp;b &lt;tag&gt;<span class="ad">sponsored</span>
    <form action="/s"><input name=q><p>Search here</p></form><script>if (a < b) document.write("<p>no</p>")</script>
    <footer>Filed under news</footer></article>
    <section class="comments" id="comments"><h3>2 comments</h3><article class="comment"><p>{sentence(rng, 40)}</article></section></main>
    <div id="sidebar"><p>{sentence(rng, 30)}</p></div><div style="display: none">hidden words</div>
    <footer>&copy; The Site</footer></body></html>"""
    expected = [title, *(x for b in body for x in (b[:9], b)), "Café – a b <tag>"]
    return page, "\n".join(" ".join(e.split()) for e in expected)


def nameless_site(rng, i):
    """Only divs without names; menus are linked, notices constant."""
    body = [sentence(rng, 20) for _ in range(rng.randint(2, 6))]
    offer = "<div><p>Members save ten percent this week and every week of the year.</p></div>" if i % 2 else ""
    page = f"""<html><body><div><div><a href=/>Home</a> <a href=/x>World</a></div>{offer}<div><h1>{body[0]}</h1>{"".join(f"<p>{b}</p>" for b in body)}</div>
    <div>All rights reserved by the people who run this site, wherever they may be.</div></div>"""
    return page, "\n".join([body[0], *body])


@pytest.mark.parametrize("make", [named_site, nameless_site])
def test_sites(spark, make):
    rng = random.Random(5)
    pages = [(i, f"https://www.example.com:8080/{i}", *make(rng, i)) for i in range(40)]
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.main_text(frame).collect()}
    assert got == {i: text for i, _, _, text in pages}


def test_pages_of_the_test_data(spark):
    pages = table(spark, SF, "pages")
    expected = {r.page_id: plain(r.html) for r in pages.collect()}
    rows = wrappers.op13_wrappers(spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == expected
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == pages.count()


def test_partial_wrappers_merge_in_rounds(spark, monkeypatch):
    """A host with many more partial wrappers and templates than one group takes."""
    monkeypatch.setattr(wrappers, "FAN", 6)
    monkeypatch.setattr(wrappers, "TEMPLATES", 2)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    rng = random.Random(6)
    pages = [(i, "http://one.example", *named_site(rng, i)) for i in range(60)]
    odd = [(100 + i, "http://one.example", f"<body><section class=k{'xyzuvwrst'[i]}><table class=q{'xyzuvwrst'[i]}><td>cell {i}", f"cell {i}") for i in range(9)]
    frame = spark.createDataFrame([p[:3] for p in pages + odd], "page_id long, url string, html string").repartition(24)
    got = {r.page_id: r.text for r in wrappers.main_text(frame).collect()}
    assert got == {i: text for i, _, _, text in pages + odd}


def shape(item):
    """An expression as text."""
    if item.label == "#":
        own = "#"
    else:
        own = f"{'' if item.label == '()' else item.label}({' '.join(map(shape, item.items))})"
    return own + ("+" if item.repeated else "") + ("?" if item.optional else "")


def test_mismatches_become_optional_or_repeated():
    pages = ["<div><h1>a</h1><p>b</p></div>", "<div><h1>c</h1><p>d</p><p>e</p><ul><li>f<li>g</ul></div>", "<div><p>h</p></div>"]
    found = wrappers.Templates()
    for page in pages:
        found.add(wrappers.bare(wrappers.page_tree(page)[0]))
    [(wrapper, _, n)] = found.kept()
    assert n == 3 and shape(wrapper.items[0]) == "div(h1(#)? p(#+)+ ul(li(#+)+)?)"


def test_recurring_runs_become_groups():
    page = wrappers.page_tree("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")[0]
    assert shape(page.items[0]) == "dl((dt(#+)+? dd(#+)+?)+)"


def test_wide_levels_stay_bounded_and_lose_no_text():
    rng = random.Random(7)
    tags = [rng.choice(["p", "h2", "ul", "div", "blockquote", "table"]) for _ in range(3000)]
    body = "".join(f'<{t} class="c{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}">{i}</{t}>' for i, t in enumerate(tags))
    tree, blocks = wrappers.page_tree(f"<article>{body}</article>")
    assert len(list(wrappers.every(tree))) < 3 * wrappers.WIDTH
    assert wrappers.extract(f"<article>{body}</article>", []) == "\n".join(map(str, range(3000))) and len(blocks) == 3000


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("   ", ""), ("just words &amp; signs < 3", "just words & signs < 3"), ("<p>a<p>b<li>c", "a\nb\nc"),
        ("<article><p>a<!-- open <p>b", "a"), ("<article><p>a</p><script>var x = '<p>b'", "a"), ("<article><p class='x>a</p><p>b", "a\nb"),
        ("<div>" * 300 + "deep" + "</div>" * 300 + "<p>flat", "deep\nflat"), ("<article>x" + "<b>y" * 20_000, "x" + "y" * 20_000),
        ("<article>a<br>b &nbsp;\n c<hr>d</article>", "a b c\nd"), ("<ARTICLE>&#x41;&#66;&eacute;&notanentity;</ARTICLE>", "ABé¬anentity;"),
        ("<article><![CDATA[raw <b>]]></article></div></p>", "raw <b>"), ("<nav>only a menu</nav>", ""),
    ],
)
def test_odd_pages(page, text):
    assert wrappers.extract(page, []) == text


def test_odd_rows(spark, edge_dir):
    rows = sorted(map(tuple, wrappers.op13_wrappers(spark, edge_dir).collect()), key=repr)
    assert rows == sorted(
        [(1, "http://a.example/x", "Same text", 9), (1, "http://a.example/x", "Same text", 9), (2, None, "no address", 10), (3, "http://a.example", "", 0),
         (4, "not a url", "", 0), (None, "http://b.example", "no id", 5)], key=repr)
