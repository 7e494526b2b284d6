"""Main text extraction on planted pages and on the page table."""

from __future__ import annotations

import html
import re

import pytest

from trackloom.llm import queries, wrappers
from trackloom.llm.wrappers import WrapperConfig, align, parse

SF = "/root/testdata/sf0.001"


def texts(spark, rows, cfg=WrapperConfig()):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host string")
    out = wrappers.main_text(df, cfg)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def one(spark, page):
    return texts(spark, [(1, "http://h.org/a", page, None, None)])[1]


def test_page_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op4_wrapper_induction(spark, SF).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
        assert r.text == "\n".join(p for p in parts if p)


def test_regions_that_are_not_main_text(spark):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
    <header>Site</header><nav>Menu</nav><div class="cookie-notice">Cookies</div><div id="sidebar"><p>Side</p></div>
    <main><article class="post comments-open"><header><h1>Head &amp; shoulders</h1></header><p>First  <b>bold</b>text.<p>Second&nbsp;one
    <ul><li>a<li>b</ul><div class="ad">Buy</div><form><p>Form</p></form><table><tr><td>x<td>y</table>
    <section class="comments"><article class="comment"><p>Reader</p></article></section></article></main>
    <aside>Aside</aside><footer>Foot</footer></body></html>"""
    assert one(spark, page) == "Head & shoulders\nFirst boldtext.\nSecond one\na\nb\nx\ny"


def test_without_article(spark):
    page = "<body><ul class=menu><li><a href=/>Home</a></ul><div><div><h1>Title here</h1><p>Long running text of the page, first part.</p><p>And the second part of it.</p></div><div class='related'><p>Other</p></div></div><footer>f</footer>"
    assert one(spark, page) == "Title here\nLong running text of the page, first part.\nAnd the second part of it."


def test_parts_beside_the_densest_region(spark):
    long = "Long running text of the page that goes on and on, sentence by sentence. "
    page = f"""<body><div class=nav><p>Menu</p></div><div class=top><h1><a href=/x>Headline</a></h1></div><div class=lead>The lead.</div>
    <div><a href=/a>Home</a> | <a href=/b>About</a></div><div class=body><p>{long * 9}</p><p>See <a href=/c>this</a>.</p><ul><li><a href=/d>Source</a></li></ul></div>
    <div class=more><p>The last section.</p></div><div class=related><p>Other</p></div></body>"""
    assert one(spark, page).split("\n") == ["Headline", "The lead.", (long * 9).strip(), "See this.", "Source", "The last section."]


def test_constant_nodes_become_template(spark):
    rows = [(i, "https://x.net:80/p?q", f"<div><div><p>Shop of the year</p></div><div><p>Text number {i} is about {i * 7} things.</p><p>Its second line, {i}.</p></div></div>", None, None) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == f"Text number {i} is about {i * 7} things.\nIts second line, {i}." for i in range(12))


@pytest.mark.parametrize("page", [None, "", "plain text", "<p>", "<div" * 50, "<!-- x", "<script>never closed <p>a</p>", "<div>" * 5000 + "deep", "a &am<b>p; b</b> &lt;p&gt; &#233;&#x1F600;", "</p></div>x", "<p>" + "long " * 40_000])
def test_odd_pages(spark, page):
    want = {None: "", "": "", "plain text": "plain text", "<p>": "", "</p></div>x": "x", "a &am<b>p; b</b> &lt;p&gt; &#233;&#x1F600;": "a &amp; b <p> é😀"}
    got = one(spark, page)
    if page in want:
        assert got == want[page]
    elif page.startswith("<p>long"):
        assert got == ("long " * 40_000).strip()
    elif page.endswith("deep"):
        assert got == "deep"


def test_copies_nulls_and_empty(spark):
    rows = [(1, None, "<article><p>A</p></article>", None, None)] * 7 + [(2, "http://h/", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host string")
    assert sorted(r.text for r in wrappers.main_text(df).collect()) == [""] + ["A"] * 7
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_repeated_pages_are_no_template(spark):
    article, plain = "<body><article><h1>Head</h1><p>The whole story.</p></article></body>", "<div><div><p>Running text of a page.</p></div></div>"
    rows = [(i, "http://one.org/a", article, None, None) for i in range(25)] + [(100 + i, "http://two.org/a", plain, None, None) for i in range(7)]
    rows += [(200 + i, "http://three.org/a", f"<div><div><p>Shop of the year</p></div><div><p>Text {i // 3} of many things.</p></div></div>", None, None) for i in range(36)]
    got = texts(spark, rows)
    assert all(got[i] == "Head\nThe whole story." for i in range(25))
    assert all(got[100 + i] == "Running text of a page." for i in range(7))
    assert all(got[200 + i] == f"Text {i // 3} of many things." for i in range(36))


def test_two_templates_of_a_host(spark):
    def shop(i):
        return f"<div class=shop><p>Fine wares daily</p><div class=body><p>Ware number {i} costs {i * 3} coins.</p><p>Packed in lot {i}.</p></div></div>"

    def talk(i):
        return f"<div class='talk t{i}'><div class=lead><p>Voices of the town</p></div><div class=turns><p>Speech {i} lasted {i + 7} minutes.</p></div></div>"

    rows = [(i, "http://two.org/x", shop(i), None, None) for i in range(40)]
    rows += [(100 + i, "http://two.org/y", talk(i), None, None) for i in range(25)]
    rows += [(200 + i, "http://two.org/z", "", None, None) for i in range(30)]
    got = texts(spark, rows)
    assert all(got[i] == f"Ware number {i} costs {i * 3} coins.\nPacked in lot {i}." for i in range(40))
    assert all(got[100 + i] == f"Speech {i} lasted {i + 7} minutes." for i in range(25))
    assert all(got[200 + i] == "" for i in range(30))


def test_a_reference_with_a_text_of_its_own(spark):
    """The most frequent text of a node is template whatever the reference page has there."""
    rows = [(i, "http://own.org/x", f"<div><div><p>{'Odd' if i % 8 == 0 else 'Usual'} heading words</p></div><div><p>Story {i} of {i * 5} ends.</p></div></div>", None, None) for i in range(24)]
    for shift in range(3):  # other pages have the lowest hash
        moved = [(i, u, h.replace("Story", "Story" + "x" * shift), t, o) for i, u, h, t, o in rows]
        got = texts(spark, moved)
        assert all(("heading" in got[i]) == (i % 8 == 0) for i in range(24))


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    test_constant_nodes_become_template(spark)


def test_simple_tree_matching():
    a, _ = parse("<div><p>1</p><span>s</span><ul><li>x</li><li>y</li></ul></div>")
    b, _ = parse("<div><p>2</p><ul><li>x</li><li>z</li><li>w</li></ul></div>")
    pairs = {(a[i].tag, b[j].tag) for i, j in align(a, b, WrapperConfig()).items()}
    assert pairs == {("", ""), ("div", "div"), ("p", "p"), ("ul", "ul"), ("li", "li")}
    assert len(align(a, b, WrapperConfig())) == 6
    assert len(align(a, b, WrapperConfig(cells=0))) == 6


def test_long_sibling_lists_and_deep_nests_are_aligned():
    a, _ = parse("<div>" + "<p>x</p>" * 30 + "<div class=box><b>t</b></div>" + "<p>y</p>" * 30 + "</div>")
    b, _ = parse("<div>" + "<p>u</p>" * 45 + "<div class=box><b>t</b></div>" + "<p>v</p>" * 30 + "<ul></ul></div>")
    labels = {(a[i].label, b[j].label) for i, j in align(a, b, WrapperConfig()).items()}
    assert ("div.box", "div.box") in labels and ("b", "b") in labels
    deep, _ = parse("<div>" * 3000 + "<i>t</i>")
    assert len(align(deep, deep, WrapperConfig())) == 3002


def test_array_and_plain_matching_agree():
    import random

    r = random.Random(7)

    def tree(depth):
        t = r.choice("abcd")
        return f"<x-{t}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 4) if depth else 0)) + f"</x-{t}>"

    for _ in range(60):
        a, b = (parse("".join(tree(3) for _ in range(r.randint(1, 9))))[0] for _ in range(2))
        plain, array = align(a, b, WrapperConfig(cells=10**9)), align(a, b, WrapperConfig(cells=0))
        assert plain == array

        def most(i, j, a=a, b=b):
            x, y = a[i].kids, b[j].kids
            w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p, k in enumerate(x):
                for q, m in enumerate(y):
                    gain = 1 + most(k, m) if a[k].label == b[m].label else 0
                    w[p + 1][q + 1] = max(w[p][q] + gain, w[p][q + 1], w[p + 1][q])
            return w[-1][-1]

        assert len(plain) == 1 + most(0, 0)
