"""Article text: every test page against its article element, and hand-made layouts."""

from __future__ import annotations

import html
import re
import time

import pytest

from tilewright.llm import extraction
from tilewright.llm.extraction import extract, main_text

SF = "/root/testdata/sf0.01"
LONG = "A sentence of some length, with a comma or two, that goes on for quite a while. " * 3
BODY = " ".join(f"<p>{LONG}{i}</p>" for i in range(4))
TEXT = " ".join(" ".join((LONG + str(i)).split()) for i in range(4))


def test_all_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>one<p>two", "one two"), ("<div>a<b>b</b>c &amp;&nbsp; d&#33;</div>", "abc & d!"),
    ("<script>var x = '<p>no</p>';</script><p>yes</p>", "yes"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<p>a < b &lt; c</p>", "a < b < c"),
    ("<title>T</title><style>p{}</style><nav>menu</nav>", ""),
    (f"<body><div class=sidebar>{BODY}</div><div id=content>{BODY}</div></body>", TEXT),
    (f"<body><header>top</header><div><div class='post-body'>{BODY}</div></div><div class='comments'><p>{LONG}</p></div><footer>x</footer></body>", TEXT),
    (f"<body><article><header><h1>Title</h1></header>{BODY}</article><aside>{BODY}</aside></body>", "Title " + TEXT),
    (f"<body><main><form>{BODY}</form>{BODY}<ul><li><a href=x>link one</a></li><li><a>link two</a></li></ul></main></body>", TEXT),
    (f"<body><div><h2>Head</h2><div>{BODY}</div><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div></body>", f"Head {TEXT} {' '.join(LONG.split())}"),
    (f"<table><tr><td><a>x</a><td>{BODY}</table>", TEXT), (f"<div style='display: none'>{BODY}</div><div>{BODY}</div>", TEXT),
    ("<p title='a > b'>quoted</p>", "quoted"), ("<p>unclosed <b>bold<p>next</b> x", "unclosed bold next x"),
])
def test_layouts(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(("page", "want"), [
    *((f"<body><article><h2 id='{i}'>Head</h2>{BODY}</article></body>", f"Head {TEXT}") for i in ("related-work", "discussion", "search-algorithms", "comments")),
    *((f"<body><div><h2 id='{i}'>Head</h2>{BODY}</div></body>", f"Head {TEXT}") for i in ("related-work", "section-header")),
    (f"<body><article>{BODY}<section id='legal'><h2>Legal</h2><p>{LONG}</p></section></article></body>", f"{TEXT} Legal {' '.join(LONG.split())}"),
    *((f"<body><div class='{c}'>{BODY}</div><div class=sidebar><p>{LONG}</p></div></body>", TEXT) for c in ("content has-sidebar", "no-comments", "side-by-side", "page with_sidebar", "post sidebar-right")),
    (f"<body><div class='page sidebar-right'><h1>Head</h1>{BODY}</div></body>", f"Head {TEXT}"),
    (f"<body><article>{BODY}<div class=comments><p>{LONG}</p></div><div class='related'><a href=x>Another</a></div><div class=ad>Buy</div></article></body>", TEXT),
    (f"<body><article>{BODY}<ol class='comment-list'><li><article>{LONG}</article></li></ol></article></body>", TEXT),
    (f"<body><article><pre>x = 1 <span class=comment># one</span></pre>{BODY}</article></body>", f"x = 1 # one {TEXT}"),
    (f"<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p>{BODY}</article></body>", f"Let x=1 be. {TEXT}"),
])
def test_names_do_not_cut_the_article(page, want):
    assert main_text(page) == want


REFERENCE = "<li><a href=x>A. Writer, On the length of rivers and other things, 2nd edition. Some Press, 1999.</a></li>"


@pytest.mark.parametrize(("inside", "want"), [
    (f"{BODY}<table><tr><td><a href=x>Paris</a></td><td>2 million</td></tr><tr><td><a href=x>Lyon</a></td><td>0.5 million</td></tr></table>", f"{TEXT} Paris 2 million Lyon 0.5 million"),
    (f"{BODY}<table><tr><td><a href=x>Paris</a></td><td><p>Seine</p></td></tr></table><p>{LONG}</p>", f"{TEXT} Paris Seine {' '.join(LONG.split())}"),
    (f"{BODY}<ol>{REFERENCE * 2}</ol>", TEXT + 2 * " A. Writer, On the length of rivers and other things, 2nd edition. Some Press, 1999."),
    (f"{BODY}<h2>Rivers</h2><ul><li><a href=x>Seine</a></li><li><a href=x>Loire</a></li></ul>", f"{TEXT} Rivers Seine Loire"),
    (f"{BODY}<ul><li><a href=x>Seine</a></li><li><a href=x>Loire</a></li></ul><p>{LONG}</p>", f"{TEXT} Seine Loire {' '.join(LONG.split())}"),
    (f"{BODY}<p>Its rivers:</p><ul><li><a href=x>Seine</a></li></ul>", f"{TEXT} Its rivers: Seine"),
    ("<ul>" + "".join(f"<li><a href=x>River {i}</a></li>" for i in range(9)) + "</ul><p>And others.</p>", " ".join(f"River {i}" for i in range(9)) + " And others."),
    (f"<ul><li><a href=x>Home</a></li></ul>{BODY}<ul><li><a href=x>Next</a></li></ul><div><a href=x>Top</a></div>", TEXT),
    (f"{BODY}<ul class=menu><li><a href=x>Home</a></li></ul><p>{LONG}</p>", f"{TEXT} {' '.join(LONG.split())}"),
])
def test_linked_text_inside_the_article(inside, want):
    assert main_text(f"<body><article>{inside}</article></body>") == want


def test_long_and_deep_pages():
    assert main_text("<div>" * 20_000 + f"<p>{LONG}</p>") == " ".join(LONG.split())
    assert len(main_text("<p>" + "word, " * 300_000 + "</p>")) > 1_700_000


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)], key=str)
    assert extract(pages.limit(0)).count() == 0


def para(n):
    return f"<p>Paragraph {n} has enough words, commas, and sense to count as text of the article.</p>"


def words(*numbers):
    return " ".join(f"Paragraph {n} has enough words, commas, and sense to count as text of the article." for n in numbers)


def test_quotes_in_bare_attribute_values():
    page = "<body><div><p data-x=it's>First paragraph, long enough to count, it's here.</p><p>Second one, which is as long as that, too.</p></div></body>"
    assert extraction.main_text(page) == "First paragraph, long enough to count, it's here. Second one, which is as long as that, too."
    page = """<div><p>One, with <a href=/o'neil>a link</a> and <a href=/x"y title='a > b' b="c>d">another</a>, and more text.</p></div>"""
    assert extraction.main_text(page) == "One, with a link and another, and more text."
    page = "<div><p a=' b>Quote never closed, but the text goes on here.</p><p>And here, where it is long enough.</p></div>"
    assert extraction.main_text(page) == "Quote never closed, but the text goes on here. And here, where it is long enough."


def test_sections_in_wrappers_all_stay():
    wrapped = "".join(f"<div class=sec><div>{para(3 * k)}{para(3 * k + 1)}{para(3 * k + 2)}</div></div>" for k in range(2))
    page = f"<body><div class=menu><ul><li><a href=/>Home</a></li></ul></div><div id=content>{wrapped}</div><div class=sidebar><div>{para(9)}{para(9)}{para(9)}</div></div></body>"
    assert extraction.main_text(page) == words(*range(6))


def test_articles_side_by_side_stay():
    page = f"<body><nav>menu</nav><article>{para(1)}</article><article>{para(2)}</article><article class=comment>{para(3)}</article></body>"
    assert extraction.main_text(page) == words(1, 2)
    page = f"<body><article>{para(1)}{para(2)}{para(3)}</article><article>{para(4)}</article></body>"
    assert extraction.main_text(page) == words(1, 2, 3)


def test_tags_are_read_in_linear_time():
    start = time.process_time()
    for page in ("<p " + "a=' " * 100_000, "<p " + "a b = / " * 100_000 + ">x", "<" * 300_000, "<a " + '"' * 300_000, "<p" + " " * 300_000 + ">t"):
        extraction.main_text(page)
    assert time.process_time() - start < 10
