import html as entities
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from trainkit.llm import html, queries

LONG = "This sentence is part of the article, and it goes on for a while so that it has weight."


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
CASES = [
    (page(f"<article><h1>Title</h1><p>{LONG}</p><p>Two &amp; &lt;b&gt; &eacute;&#33;</p></article>", NAV), f"Title\n{LONG}\nTwo & <b> é!"),
    (page(f"<div class='content'><h1>Title</h1><p>{LONG}</p><p>{LONG} Again.</p></div>", NAV, "<footer>&copy; us</footer>"), f"Title\n{LONG}\n{LONG} Again."),
    (page(f"<div id=main><p>{LONG}<p>{LONG} b<br>c</div>", '<div class="ad">Buy now, this text is quite long and has no links at all.</div>'), f"{LONG}\n{LONG} b c"),
    (page(f"<main><p>{LONG}</p><form><label>Mail</label><input></form><p>End.</p></main>", "<header><h1>Site</h1></header>"), f"{LONG}\nEnd."),
    (page(f"<article><p>{LONG}</p><div class='comments'><p>I disagree with all of this.</p></div></article>"), LONG),
    (page(f"<article><p>{LONG}</p><aside>See also</aside><ul><li>One</li><li>Two</li></ul></article>", "<div class='cookie-notice'>We use cookies to make this better.</div>"), f"{LONG}\nOne\nTwo"),
    (page(f"<article><header><h1>Own title</h1></header><p>{LONG}</p></article>"), f"Own title\n{LONG}"),
    (page(f"<article><p><b>{LONG}<br><p>Next   \n one&nbsp;x</p></article>"), f"{LONG}\nNext one x"),
    (f"<article><p>{LONG}</p><p>cut of", f"{LONG}\ncut of"),
    (page(f"<article><p>{LONG}</p><script>var t='</p>';</script><!-- <p>no</p> --><noscript><p>on</p></noscript><p>5 < 6 > 4</p></article>"), f"{LONG}\n5 < 6 > 4"),
    (page(f"<div><div><h2>A</h2><p>{LONG}</p></div><div><h2>B</h2><p>{LONG} And a little more of it.</p></div></div>", NAV), f"A\n{LONG}\nB\n{LONG} And a little more of it."),
    (page(f"<div class='post'><div class='post-header'><h1>Title</h1></div><p>{LONG}</p><div class='SIDEBAR'><p>See this other long story about things.</p></div><p>End.</p></div>", NAV), f"Title\n{LONG}\nEnd."),
    (page(f"<div id='story'><p>{LONG}</p><p>{LONG} b</p></div>", "", "<section id='comments'><h2>Comments</h2><p>First! This is a reader's long opinion on the matter, at length and more.</p></section>"), f"{LONG}\n{LONG} b"),
    (page(f"<article><p>{LONG}</p><table><tr><td>a<td>b</table><pre>x  y</pre></article>"), f"{LONG}\na\nb\nx y"),
    ("", ""),
    (None, ""),
    ("plain words only", "plain words only"),
    ("<html><body></body></html>", ""),
]


@pytest.mark.parametrize("source,text", CASES)
def test_pages(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize("opening,closing", [("<div class='content has-sidebar'>", "</div>"), ("<div class='article-with-comments'>", "</div>"), ("<section id='discussion'>", "</section>"), ("<form>", "</form>")])
def test_names_do_not_drop_most_of_the_text(opening, closing):
    assert html.main_text(page(f"{opening}<h1>Title</h1><p>{LONG}</p><p>{LONG} b</p>{closing}", NAV)) == f"Title\n{LONG}\n{LONG} b"


LINKS = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(8))
PLAIN_MENU = f"<div><ul>{LINKS}</ul></div>"


@pytest.mark.parametrize(
    "body,text",
    [
        # No article element and no telling names: density alone tells the text from menus and link lists.
        (f"{PLAIN_MENU}<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG} b</p></div>{PLAIN_MENU}", f"Title\n{LONG}\nShort.\n{LONG} b"),
        (f"{PLAIN_MENU}<div><div><h2>A</h2><p>{LONG}</p><p>{LONG} 2</p></div>{PLAIN_MENU}<div><h2>B</h2><p>{LONG} 3</p></div></div>", f"A\n{LONG}\n{LONG} 2\nB\n{LONG} 3"),
        (f"<article><h1>T</h1><p>{LONG}</p>{PLAIN_MENU}<p>{LONG} b</p></article>", f"T\n{LONG}\n{LONG} b"),
        (f"{PLAIN_MENU}<article><p>{LONG}</p></article><article><p>{LONG} b</p></article>", f"{LONG}\n{LONG} b"),
    ],
)
def test_density_decides(body, text):
    assert html.main_text(page(body)) == text
    assert html.main_text(page(body), by_density=False) != text


@pytest.mark.parametrize(
    "body,text",
    [
        (f'<div class="layout has-sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<section class="post no-comments"><p>{LONG}</p></section>', LONG),
        (f'<form id="aspnetForm"><article><p>{LONG}</p></article></form>', LONG),
        (f'<div title="a hidden gem"><p>{LONG}</p></div>', LONG),
        (f'<article><p>{LONG} <span class="search-term">needle</span> end</p></article>', f"{LONG} needle end"),
        (f'<article><p>{LONG}</p><p class="ad">Buy now</p></article>', LONG),
    ],
)
def test_names_are_taken_whole(body, text):
    assert html.main_text(page(body)) == text


def test_an_article_ends_unclosed_boilerplate():
    assert html.main_text(page(f"<div class='menu'><p>Home<article><p>{LONG}</p></article>")) == LONG


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 30_000 + "x") == "x"
    text = html.main_text(page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"))
    assert text.count("\n") == 19_999


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", CASES[0][0], "x"), (None, None, None, None), (1, "u", CASES[0][0], "x")], "page_id long, url string, html string, text string")
    got = html.extract_text(pages, [F.col("page_id"), F.col("text")]).collect()
    assert sorted((r.text, r.n_chars) for r in got) == sorted([("", 0), (CASES[0][1], len(CASES[0][1])), (CASES[0][1], len(CASES[0][1]))])
    assert html.extract_text(pages.limit(0), [F.col("page_id")]).count() == 0


def test_query_against_the_article_element(spark):
    """The given pages keep their article in one element of headings and paragraphs."""
    source = {r.page_id: r.html for r in spark.read.parquet(f"{ORACLE}/pages.parquet").collect()}
    got = queries.op2_html_text(spark, ORACLE).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", ""))]
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text)


LONGER = " ".join([LONG] * 3)
SMALL = f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG} b</p><p>{LONG} c</p></div>"
SMALL_TEXT = f"Title\n{LONG}\n{LONG} b\n{LONG} c"
MANY = "".join(f"<p>{LONGER} {i}</p>" for i in range(6))


@pytest.mark.parametrize(
    "other",
    [f"<section id='comments'>{MANY}</section>", f"<div class='sidebar'>{MANY}</div>", f"<form>{MANY}</form>", f"<div class='cookie-notice'>{MANY}</div>", f"<div class='user-comments'>{MANY}</div>",
     f"<div class='comment-body'>{MANY}</div>", f"<div class='thread comments2'>{MANY}</div>", f"<div id='fbCommentsPlugin'>{MANY}</div>", f"<aside>{MANY}</aside>"],
)
def test_a_small_article_beside_long_boilerplate(other):
    assert html.main_text(page(SMALL + other, NAV)) == SMALL_TEXT
    assert html.main_text(page(other + SMALL, NAV)) == SMALL_TEXT
    assert html.main_text(page(f"<div class='page'>{SMALL}{other}</div>", NAV)) == SMALL_TEXT


@pytest.mark.parametrize(
    "body,text",
    [
        (f"<article><h1><a href='/t'>The Title</a></h1><p>{LONG}</p></article>", f"The Title\n{LONG}"),
        (f"<div><h1><a href='/t'>The Title</a></h1><p>{LONG}</p><p>{LONG} b</p></div>", f"The Title\n{LONG}\n{LONG} b"),
        (f"<article><p>{LONG}</p><p><a href='/x'>One whole paragraph is a link</a></p><p>End.</p></article>", f"{LONG}\nOne whole paragraph is a link\nEnd."),
        (f"<article><p>{LONG}</p><h2>References</h2><ol><li><a>First</a></li><li><a>Second</a></li><li><a>Third</a></li><li><a>Fourth</a></li><li><a>Fifth</a></li></ol></article>", f"{LONG}\nReferences\nFirst\nSecond\nThird\nFourth\nFifth"),
        (f"<article><p>{LONG}</p><ul><li><a>Smith, J. (2001). On the things that one can say at length.</a></li><li><a>Jones</a>, a short note</li></ul></article>", f"{LONG}\nSmith, J. (2001). On the things that one can say at length.\nJones, a short note"),
        (f"<article><p>{LONG}</p><div class='ad-slot'><p>Buy the new thing now, it is cheap and good and here.</p></div><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<div><p>{LONG}</p><p>{LONG} b</p><div>Copyright 2024 The Site, all rights reserved.</div></div>", f"{LONG}\n{LONG} b"),
        (f"<div><p>{LONG}</p><p>{LONG} b</p></div><div>© The Site</div>", f"{LONG}\n{LONG} b"),
        (f"<article><p>{LONG}</p><p>Copyright law is a wide field.</p></article>", f"{LONG}\nCopyright law is a wide field."),
        (f"<form id='aspnetForm'><div class='menu'>{PLAIN_MENU}</div><div><h1>T</h1><p>{LONG}</p></div><div class='comments'>{MANY}</div></form>", f"T\n{LONG}"),
    ],
)
def test_links_adverts_and_rights(body, text):
    assert html.main_text(page(body, NAV)) == text


def test_nested_names_around_the_only_text():
    for depth in (3, 20, 90):
        assert html.main_text(page("<div class='sidebar'>" * depth + f"<p>{LONG}</p>" + "</div>" * depth, NAV)) == LONG
