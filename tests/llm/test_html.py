import html as H
import re

import numpy as np

from quillgraph.llm import htmltext as X

TREE = X.train()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-header"><header><a href=/>Home</a> Site name</header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site to make it better for all of you, dear readers.</div>
<div id=content><article><h1>A title &amp; more</h1><p>First <b>par</b>agraph,<br>with  a&nbsp;break &lt;here&gt;.<p>Unclosed one<ul><li>Item one</li><li>Item</li></ul>
<div class="ad-box">Buy now and save a lot of money with our great offer today</div><p hidden>secret words</p>
<section class="comments"><h3>Comments</h3><p>I think that this is a very good article and I like it a lot, thanks.</p></section></article></div>
<aside><p>Related reading about something else that goes on and on for many words in the sidebar of it.</p></aside>
<form><label>Name</label><input name=a><p>Please fill in</p></form><footer>&copy; 2020 Company</footer><script>var t="</p><p>no text";</script></body></html>"""


def test_page():
    assert X.main_text(PAGE, TREE) == "A title & more First paragraph, with a break <here>. Unclosed one Item one Item"


def test_without_containers():
    long = "word " * 40
    page = f"<div><a href=a>Home</a> | <a href=b>News</a></div><h1>Big title here</h1><div>{long}</div><p>{long}</p><div><a href=c>Next page</a></div>"
    assert X.main_text(page, TREE) == " ".join(["Big title here", long.strip(), long.strip()])


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("  \n", ""), ("just text", "just text"), ("<article>a <p>b &amp", "a b &"), ("<article>x<p", "x"), ("<article>x <!-- y", "x"), ("<script>x", ""), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"), ('<article><a title="x>y" href=z>k</a></article>', "k"), ("<article>" + "word " * 30000 + "</article>", ("word " * 30000).strip())):
        assert X.main_text(page, TREE) == want


def test_tree_fits_its_table():
    x, y = X.labelled()
    assert np.mean([X.judge(TREE, r) == t for r, t in zip(x, y)]) >= 0.97


def test_tables(spark, sf):
    """Pages of the test tables: everything in the article, nothing else."""
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in X.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", inner[1] if inner else "")
        want = " ".join(filter(None, (" ".join(H.unescape(re.sub(r"<[^>]*(>|$)", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts)))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, "u", 5), (1, None, "u", 5), (None, "<p>a", None, 6)], "page_id long, html string, url string, n_chars int")
    assert sorted(map(str, X.extract(odd).select("page_id", "text", "n_chars").collect())) == ["Row(page_id=1, text='', n_chars=0)"] * 2 + ["Row(page_id=None, text='a', n_chars=1)"]
    assert X.extract(odd.limit(0)).count() == 0


W = " ".join(["word"] * 40)
HELD_OUT = [
    (f"<article><h1>Big Title</h1><p><a>By Author</a></p><p>{W}</p></article>", f"Big Title {W}"),
    (f"<article><p>{W}</p></article><div><a>Next page</a></div>", W),
    ("<div>" + " ".join(f"<a href=x>link{i}</a>" for i in range(40)) + "</div>", ""),
    (f"<article class='comments-off'><h1>T</h1><p>{W}</p></article>", f"T {W}"),
    (f"<article><p>{W}</p><p class='side-note'>{W}</p></article>", f"{W} {W}"),
    (f"<article><p>{W}</p><div class='promo-video-wrap'>{W}</div></article>", f"{W} {W}"),
    (f"<div class='page no-ads'><article class='post comment-open'><h1>Head line</h1><p>{W}</p></article></div>", f"Head line {W}"),
    (f"<div id='wrapper'><div id='header'><h1>Site</h1><a href=/>Home</a></div><div id='content'><h2>The head</h2><p>{W}</p><p>{W}</p></div><div id='footer'>copyright me</div></div>", f"The head {W} {W}"),
    (f"<nav><a>a</a></nav><main><h1>Head</h1><p>Short one.</p><ul><li>one</li><li>two three</li></ul><p>{W}</p></main><div class='comments'><article><p>{W}</p></article></div>", f"Head Short one. one two three {W}"),
    (f"<article><header><h1>Own head</h1></header><p>{W}</p><footer>Filed under x</footer></article>", f"Own head {W}"),
    (f"<header><h1>Site</h1></header><section class='site-notice'><p>{W}</p></section><article><h2>A b c</h2><p>{W}</p><p>{W}</p></article>", f"A b c {W} {W}"),
    (f"<form id=f><article><p>{W}</p></article><input></form>", W),
    (f"<aside><p>{W}</p></aside><p>{W}</p><p>{W}</p>", f"{W} {W}"),
    (f"<article><p>{W}</p><div hidden><p>{W}</p></div><div style='display:none'>{W}</div><p aria-hidden=true>x</p><p>{W}</p></article>", f"{W} {W}"),
    (f"<div class=newsletter><p>{W}</p></div><article><p>{W}</p></article>", W),
]


def test_held_out_pages():
    for page, want in HELD_OUT:
        assert X.main_text(page, TREE) == want, page[:80]


def test_very_long_page_and_clashing_columns(spark):
    page = "<article>" + f"<p>{W}</p>" * 5000 + "</article>"
    docs = spark.createDataFrame([(1, page, "u", "t", "n")], "page_id long, html string, url string, text string, TREE string")
    r = X.extract(docs).first()
    assert r.n_chars == len(W) * 5000 + 4999 and r.text.startswith(W) and r.TREE == "n"


def test_features_against_their_definition():
    b = X.blocks(f"<nav><a>x y</a></nav><article><h1>t</h1>{W} <a>z</a></article><div>q</div>")
    got = X.features(b).tolist()
    assert [r[2] for r in got] == [2, 1, 41, 1] and [r[0] for r in got] == [0, 2, 1, 41] and [r[4] for r in got] == [1, 41, 1, 0]
    assert [r[6:] for r in got] == [[0, 1, 0, 0], [1, 0, 0, 1], [1, 0, 0, 0], [0, 0, 1, 0]] and got[0][3] == 100
