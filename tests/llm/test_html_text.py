import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from frametide.llm.html_text import BLOCK, block_sums, extract, lines_of, main_text, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s
<div class="comments"><h2>Comments</h2><p>I do not agree at all with what was written here.</p></div><aside><p>Related</p></aside>
<form>Name <input> <button>Go</button></form><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Head &amp; more</h1><p>First   para\n goes <b>on</b>.<p>Second<br>part.</article>", "Head & more First para goes on. Second part."),
        ("<main><p>One.</p><div class='ad'>buy</div><p>Two.</p></main>", "One. Two."),
        ("<div id=content><h1>Title</h1><p>A paragraph that is long enough to be the text of this page.</p></div>", "Title A paragraph that is long enough to be the text of this page."),
        ("<article><p>Ok.</p></article>", "Ok."),
        ("<article></article>", ""),
        ("<article class='post comments-open'><p>Text.</p><article class='comment'><p>No.</p></article><p>More.</p></article>", "Text. More."),
        ("<article><p>a &lt;b&gt; &#233;&eacute; &nbsp; c</p></article>", "a <b> éé c"),
        ("<article><p>x<!-- <p>gone</p> -->y</p></article>", "xy"),
        ("<article><table><tr><td>1</td><td>2</td></tr></table><ul><li>a</li><li>b</li></ul></article>", "1 2 a b"),
    ],
)
def test_pages(body, want):
    assert main_text(PAGE % body) == want


@pytest.mark.parametrize(
    "page, want",
    [(None, ""), ("", ""), ("plain < text 3 < 4 &amp; 5 > 2", "plain < text 3 < 4 & 5 > 2"), ("<p>a", "a"), ("<article><p>cut o", "cut o"), ("<article><nav>menu<p>x</article>", ""), ("a<br/>b", "a b"), ("<p title='>'>t</p>", "t")],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


LONG = "".join(f"<p>{'word ' * 80}{i}</p>" for i in range(3))
TEXT = " ".join(f"{'word ' * 80}{i}" for i in range(3))
AD = "<div class=ad>buy</div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div id=content>{LONG}{AD}<p>The end.</p></div>", f"{TEXT} The end."),
        (f"<div>{LONG}\n</div>\n<div>\n<p>The end.</p>\n</div>", f"{TEXT} The end."),
        (f"<body>{LONG}{AD}<div class=quote>So.</div>{AD}<p>The end.</p></body>", f"{TEXT} So. The end."),
        (f"<div><section class=a>{LONG}</section>{AD}<section class=b><p>The end.</p></section></div>", f"{TEXT} The end."),
        (f"<div><div class=part>{LONG}</div>{AD}<div class=part><p>The end.</p></div></div>", f"{TEXT} The end."),
        (f"<body><div class=top>Home</div>{AD}<div id=content>{LONG}{AD}<p>The end.</p></div>{AD}<div class=low>Imprint</div></body>", f"{TEXT} The end."),
    ],
)
def test_short_parts_of_unmarked_articles(page, want):
    assert main_text(page) == want


def test_synthetic_articles(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        assert main_text(r.html) == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def naive(weights, low, ends, block=BLOCK):
    """Lines that are in no block with a sum of ``low`` or less; every block is summed anew."""
    n, out = len(weights), set()
    for first in range(-block + 1, n):
        places = [i for i in range(first, first + block)]
        if ends or (first >= 0 and places[-1] < n):
            if sum(weights[i] for i in places if 0 <= i < n) <= low:
                out.update(places)
    return [i for i in range(n) if i not in out]


def test_regions_are_those_of_all_block_sums(sf):
    rng = random.Random(5)
    cases = [[rng.choice((0, 0, 0, 1, 5, 40, 300)) for _ in range(rng.randrange(0, 40))] for _ in range(400)]
    cases += [[x.plain for x in lines_of(r["html"])[0]] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    for weights in cases:
        assert [s for s in block_sums(weights)][: len(weights)] == [sum(weights[max(0, i - BLOCK + 1) : i + 1]) for i in range(len(weights))]
        for low in (0, 6, 60):
            for ends in (True, False):
                found = regions(weights, low, ends)
                assert [i for a, b, _, _ in found for i in range(a, b)] == naive(weights, low, ends)
                assert all(total == sum(weights[a:b]) for a, b, total, _ in found)


MENU = "<div><a href=/>Home</a> <a href=/a>About</a> <a href=/c>Contact</a></div>"
LINKS = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(5))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"{MENU}<div>{LONG}</div>", TEXT),
        (f"<body><ul>{LINKS}</ul><h1>Head</h1>{LONG}<div>Imprint</div><div>Contact</div><div>(c)</div></body>", f"Head {TEXT}"),
        (f"<div><h1><a href=/>Head</a></h1></div><div>{LONG}<p><a href=/x>See there.</a></p><p>End.</p></div>", f"Head {TEXT} See there. End."),
        ('<div class="content-sidebar-wrap"><div class="content"><p>Some text.</p></div></div>', "Some text."),
        ('<article><p>In.</p><section id="related-work"><p>Others.</p></section><div class="search-algorithms"><p>Binary.</p></div></article>', "In. Others. Binary."),
        (f"<div class=sidebar>{LONG}</div>", TEXT),
        (f"<article><p>One.</p><ul>{LINKS}</ul><p>Two, <a href=/>linked</a>.</p><p><a href=/x>Only.</a></p></article>", "One. Two, linked. Only."),
        (f"<article><p>Ok.</p><div class=comment-list>{LONG}</div></article>", "Ok."),
        (f"<div id=a>{LONG}</div><div class='reader-comments'>{LONG}</div>", TEXT),
        ("<div><p>same size</p></div><div class=x></div><nav>n</nav><section><p>same size</p></section>", "same size same size"),
    ],
)
def test_the_distribution_decides(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("unit", ["<option>x", "<div>", "<div><section></div>", "<nav><div></span>", "<div class=ad>x", "<p><a>x</a><li>"])
def test_time_follows_the_length(unit):
    took = []
    for n in (16_000, 64_000):
        began = time.process_time()
        main_text(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.1)


def test_linear_time():
    began = time.time()
    for page in ("<a " * 200_000, "<" * 200_000, "<p title=\"" + "x" * 300_000, "<!--" * 100_000, "<script>" * 20_000, "<div class='ad'>" * 50_000, '<a "' * 50_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "</p>" * 100_000):
        main_text(page)
    assert time.time() - began < 20


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é x</p>", "t"), (1, "u", "<p>é x</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")  # text: a clashing name
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()) == [(0, "", 0), (1, "é x", 3), (1, "é x", 3)]
    assert extract(df.limit(0)).count() == 0
