import difflib
import random

import pytest

from tracemill.llm import html_diff as h

SCHEMA = "page_id long, url string, html string, text string, key int"
ARTICLE = """<!DOCTYPE html><html class="no-sidebar"><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies</div>
<div class="ad">Buy</div><article class="post comments-open"><header><h1>Head &amp; line</h1></header><p><b>One&nbsp; two<br>three<p>Four <i>fi</i>ve &lt;b&gt; &#233; 1 < 2
<aside>see also</aside><form><p>mail?<input></form><p class='promo x'>hidden</p><ul><li>i<li>ii</ul><div id=share><div>tweet</div></div><pre>a
  b</pre><section class="comments"><article><p>nice</p></article></section></article><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    "page, want",
    [
        (ARTICLE, ["Head & line", "One two three", "Four five <b> é 1 < 2", "i", "ii", "a b"]),
        ("<main><p>x</p></main><p>out", ["x"]),
        ("<article><p>cut off he", ["cut off he"]),
        ("<article><p>a</p><div class=ad><p>b</p></div><p>c</p></article><p cla", ["a", "c"]),
        ("just text <b>bold</b>", ["just text bold"]),
        ("<div hidden>a</div><div style='display: none'>b</div><div role=navigation>c</div><div>d</div>", ["d"]),
        ("<article><p>a <p class=notice>n<p>b</article>", ["a", "b"]),
        ("<article></article><p>only this", ["only this"]),
        ('<p title="unclosed>a</p><p>b</p>', ["a", "b"]),
        ("", []),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ],
)
def test_structure(page, want):
    assert [t for t, _ in h.kept(page)] == want


def test_shared_lines_are_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.sample(range(30), rng.randrange(1, 20)) for _ in range(2)]
        got = h.shared(a, b)
        kept = [a[k] for k in sorted(got)]
        at = iter(b)
        assert all(x in at for x in kept)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(got) == table[-1][-1] >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())


def page(*blocks):
    return "<html><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>"


def test_neighbours_delete_shared_lines(spark):
    own = lambda k: [f"own text of page {k}, part {j}, and some more of it" for j in range(3)]
    rows = [(k, f"http://A.example/x/{k}?q={k}", page("Home", "Menu", *own(k), "All rights reserved"), "", 0) for k in range(5)]
    rows += [(50, "http://b.example/x/1", page("Home", "Menu", *own(9)), "", 0)]  # alone on its host
    rows += [(60, "http://c.example/1", page(*own(7)), "", 0), (61, "http://c.example/2", page(*own(7)), "", 0)]  # copies
    rows += [(70, "http://a.example/x/2", "<article><p>Home</p><p>All rights reserved</p></article>", "", 0)]  # main text stays
    rows += [(80, None, None, None, None), (None, "", "", "", 0), (81, "no url", "x", "", 0), (81, "no url", "x", "", 0)]
    got = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for k in range(5):
        assert text[k, rows[k][1]] == "\n\n".join(own(k))
    assert text[50, "http://b.example/x/1"].startswith("Home\n\nMenu")
    assert text[60, "http://c.example/1"] == text[61, "http://c.example/2"] == "\n\n".join(own(7))
    assert text[70, "http://a.example/x/2"] == "Home\n\nAll rights reserved"
    assert text[80, None] == text[None, ""] == "" and text[81, "no url"] == "x"
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_posts_lose_long_menus(spark):
    menu = [f"menu entry {j} of the site" for j in range(40)]
    rows = [(k, f"http://a.example/{k}", page(*menu, f"short post {k}"), "", 0) for k in range(4)]  # about 1% of its own
    rows += [(k, f"http://b.example/{k}", page(*menu[:8], f"a post {k} of more words than the others have", "it has two lines" * k), "", 0) for k in (10, 11)]
    rows += [(k, f"http://c.example/{k}", page(*menu, "x" * (k % 2)), "", 0) for k in (20, 21)]  # copies
    got = {r.page_id: r.text.split("\n\n") for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in (1, 2):
        assert got[k] == [f"short post {k}"]
    for k in (10, 11):
        assert got[k] == [f"a post {k} of more words than the others have", "it has two lines" * k]
    assert got[20] == menu and got[21] == [*menu, "x"]


def test_pages_with_an_article_are_compared(spark):
    own = lambda k: [f"own text of page {k}, part {j}, and some more of it" for j in range(4)]
    article = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    long = "a long passage that one page quotes from another " * 8
    said = "One sentence that some pages share."
    rows = [(k, f"http://a.example/{k}", article("Sign up for our letter", *own(k), *([long] if k in (1, 2) else []), *([said] if k < 5 else [])), "", 0) for k in range(12)]
    rows += [(k, f"http://b.example/{k}", page("Home", article("Teaser"), *own(k)), "", 0) for k in range(100, 112)]  # text beside a teaser
    rows += [(k, f"http://c.example/{k}", article(*own(7), "x"[: k % 2]), "", 0) for k in (20, 21)]  # copies
    rows += [(30, "http://d.example/", page("out", article("in")), "", 0)]  # alone on its host
    rows += [(k, f"http://e.example/{k}", article(said, *own(k)), "", 0) for k in range(40, 44)]  # a host of few pages
    got = {r.page_id: (r.text.split("\n\n"), r.n_shared) for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(12):
        assert got[k] == (own(k) + ([long.strip()] if k in (1, 2) else []) + ([said] if k < 5 else []), 1)
    for k in range(100, 112):
        assert got[k] == (own(k), 2)
    for k in range(40, 44):
        assert got[k] == ([said, *own(k)], 0)
    assert got[20] == (own(7), 0) and got[21] == (own(7) + ["x"], 0) and got[30] == (["in"], 0)


@pytest.mark.parametrize("at_once", [1, 3, 2000])
def test_neighbours_across_cuts(spark, at_once, monkeypatch):
    monkeypatch.setattr(h, "PAGES_AT_ONCE", at_once)
    rows = [(k, f"http://{host}.example/{k}", page("Menu", f"own text of page {k}"), "", 0) for host, first in (("a", 10), ("b", 20), ("c", 30)) for k in range(first, first + 2 + first // 10)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"own text of page {k}" for k, *_ in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_pages(spark, sf):
    """The pages of the test tables have all their text but furniture in one article, whose blocks are p and h1."""
    import html
    import re

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in h.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>|<[^>]*$", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
