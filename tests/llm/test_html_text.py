import html
import re

import pytest

from basketlens.llm import html_text as ht
from basketlens.llm import queries
from basketlens.sources.tables import read_table

from .util import SF, docs_frame

PARAGRAPH = "A paragraph of the article that is long enough to make the windows surge, &amp; more."
PLAIN = PARAGRAPH.replace("&amp;", "&")


def article_of(page):
    """The blocks between <article> and </article>, by a regular expression (the tables' pages are that plain)."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n\n".join(b for b in (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in blocks) if b)


def test_query_on_the_whole_table(spark):
    pages = {r.page_id: r.html for r in read_table(spark, SF, "pages").collect()}
    out = queries.QUERIES["op5_html_text"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


NOISE = [
    "<nav><ul><li><a href=x>Menu entry</a></li></ul></nav>",
    "<header><h1>The site</h1><p>Its motto, which is a sentence of its own and quite long.</p></header>",
    "<footer>&copy; The site, all rights reserved, in a long line of text that could be a paragraph</footer>",
    "<aside><p>Sidebar text that is as long as a paragraph of the article, or even longer than that.</p></aside>",
    '<div class="cookie-banner">We use cookies, and say so in a sentence that is as long as a paragraph, really.</div>',
    "<div id='ad-top' class=x>Buy this now! It is a long advert, longer than what stands around it on the page.</div>",
    "<form><label>Your name, please, and your address and your hopes for the future of the forms</label><input></form>",
    "<section class='comments'><p>First! A reader's comment that goes on and on and on, for some hundred characters.</p></section>",
    '<div role="complementary">Complementary text of some length, long enough to be taken for a paragraph of text.</div>',
    "<script>if (a < b) document.write('<p>not text, but long enough to be taken for a paragraph of text</p>')</script>",
    "<style>p > a { content: 'long enough to be taken for a paragraph of the article, if it were not a style' }</style>",
    "<!-- <p>a comment of the source that is long enough to be taken for a paragraph of the article</p> -->",
    "<div style='display:none'>Hidden text of some length, long enough to be taken for a paragraph of the text.</div>",
]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("marked", [True, False])
def test_noise_goes(noise, marked):
    article = f"<h1>Title</h1><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p>"
    wrapped = f"<article>{article}</article>" if marked else f"<div class='content'>{article}</div>"
    want = f"Title\n\n{PLAIN}\n\nShort.\n\n{PLAIN}"
    assert ht.extract(f"<html><head><title>T</title></head><body>{noise}{wrapped}{noise}</body></html>") == want
    inside = f"<article><h1>Title</h1><p>{PARAGRAPH}</p>{noise}<p>Short.</p></article>" if marked and not noise.startswith("<header") else None
    if inside:
        assert ht.extract(inside) == f"Title\n\n{PLAIN}\n\nShort."


def test_surges_and_dives_decide_on_marked_pages_too():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(5)) + "</ul>"
    card = "<article><p>A teaser.</p></article>"
    article = f"<article><h1>Title</h1><p>{PARAGRAPH}</p><p>Short.</p></article>"
    assert ht.extract(f"{article}{menu}{card}") == f"Title\n\n{PLAIN}\n\nShort."                      # a card doesn't surge
    assert ht.extract(f"{card}{menu}<div><p>{PARAGRAPH}</p><p>Short.</p></div>") == f"A teaser.\n\n{PLAIN}\n\nShort."  # nor is it the article
    assert ht.extract(f"<div>{PARAGRAPH}</div>{article}") == f"Title\n\n{PLAIN}\n\nShort."             # the marks are a prior


ADVERT = "<div class=ad><p>Buy</p><div>this</div><p>now</p><p>!</p></div>"
WHOLE = f"Title\n\n{PLAIN}\n\n{PLAIN}\n\n{PLAIN}\n\nShort."


@pytest.mark.parametrize("start,end", [("<div class='layout has-sidebar'>", "</div>"), ("<div class='with-comments'>", "</div>"), ("<div id=search-results>", "</div>"),
                                       ("<form action=x>", "</form>"), ("<div class='page comments'>", "</div>")])
@pytest.mark.parametrize("marked", [True, False])
def test_wrappers_of_the_article_are_no_noise(start, end, marked):
    article = f"<div class='entry-header'><h1>Title</h1></div><p>{PARAGRAPH}</p><p class=notice>{PARAGRAPH}</p><p>{PARAGRAPH}</p>{ADVERT}<p>Short.</p>"
    tag = "article" if marked else "div"
    menu = "<nav><ul><li><a href=x>Menu entry</a></li></ul></nav>"
    assert ht.extract(f"<body>{start}{menu}<{tag}>{article}</{tag}>{ADVERT}{end}</body>") == WHOLE
    assert ht.extract(f"<body>{menu}<{tag}>{start}{article}{end}</{tag}>{ADVERT}</body>") == WHOLE


def test_links_between_lines_of_text_are_kept():
    assert ht.extract(f"<div><p>{PARAGRAPH}</p><p><a href=x>The report</a></p><p>Short.</p></div>") == f"{PLAIN}\n\nThe report\n\nShort."


SMALL_AD = "<div class=ad><p>Buy this now</p></div>"


@pytest.mark.parametrize("page,want", [
    (f"<article><p>{PARAGRAPH}</p><section id='related-work'><p>Earlier work.</p></section><p>Short.</p></article>", [PLAIN, "Earlier work.", "Short."]),
    (f"<article><p>{PARAGRAPH}</p><section id='copyright-law'><p>Law of copies.</p></section></article>", [PLAIN, "Law of copies."]),
    (f"<article><p>{PARAGRAPH}</p><p class='share'>They share it.</p></article>", [PLAIN, "They share it."]),
    (f"<article><p>Press the <button>Start</button> key, <label>Name</label> it. {PARAGRAPH}</p><p><button>Go</button></p></article>", [f"Press the Start key, Name it. {PLAIN}"]),
    (f"<div><p>{PARAGRAPH}</p><p class='follow'>We follow the river.</p><p>Short.</p></div>", [PLAIN, "We follow the river.", "Short."]),
    (f"<div><p>{PARAGRAPH}</p><p class='ad-box'>Buy.</p><p>Short.</p></div>", [PLAIN, "Short."]),
    (f"<div><p>{PARAGRAPH}</p>{''.join(f'<p><a href={i}>Link {i}</a></p>' for i in range(5))}<p>Short.</p></div>", [PLAIN, *(f"Link {i}" for i in range(5)), "Short."]),
    (f"<div><p>{PARAGRAPH}</p>{SMALL_AD * 3}<p>The end.</p></div>", [PLAIN, "The end."]),
    (f"<p>{PARAGRAPH}</p>{SMALL_AD * 4}<p>The end.</p>", [PLAIN, "The end."]),
    (f"<div><div><p>{PARAGRAPH}</p></div>{SMALL_AD * 3}<div><p>The end.</p></div></div>", [PLAIN, "The end."]),
    (f"<article><p>{PARAGRAPH}</p><div class='related-posts'><p>Read on.</p></div><div id=comments-list><p>First!</p></div><p>Short.</p></article>", [PLAIN, "Short."]),
])
def test_names_and_neighbours_take_no_text_of_the_article(page, want):
    assert ht.extract(page) == "\n\n".join(want)


def test_noise_with_little_of_the_text_goes():
    comments = f"<div class=comments><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>"
    assert ht.extract(f"<div><p>{PARAGRAPH}</p></div>{comments}<div>Foot.</div>") == PLAIN
    assert ht.extract(f"<main><p>{PARAGRAPH}</p>{comments}</main>") == PLAIN


def test_link_lists_without_a_marked_article_go():
    links = "".join(f"<li><a href=/{i}>A headline of another article, number {i}, as a link</a></li>" for i in range(9))
    assert ht.extract(f"<ul>{links}</ul><p>{PARAGRAPH}</p><p>See <a href=x>this</a> too.</p><ul>{links}</ul>") == f"{PLAIN}\n\nSee this too."


def test_blocks_white_space_and_references():
    page = "<article><p>  a&nbsp;\n b<br>c <i>d</i>e &lt;p&gt; &eacute; &#233; &#x1F600; &amp;amp; AT&T &unknown; </p>text<div>x</div><ul><li>1<li>2</ul></article>"
    assert ht.extract(page) == "a b c de <p> é é 😀 &amp; AT&T &unknown;\n\ntext\n\nx\n\n1\n\n2"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</p></div>", "<!-- x", "<script>x", "<nav>only a menu</nav>", '<a href="', "<div class='ad'>x</div>"])
def test_no_text(page):
    assert ht.extract(page) in ("", "<", "<p", '<a href="')


def test_broken_markup_ends_and_long_pages_are_whole():
    assert ht.extract("<p>unclosed <b>bold <p>" + PARAGRAPH) == f"unclosed bold\n\n{PLAIN}"
    assert ht.extract(f"<div class=ad>advert<p>{PARAGRAPH}") == PLAIN     # noise that is never closed ends at the next block
    many = ht.extract("<article>" + "<p>word word</p>" * 50_000 + "</article>")
    assert many.count("word word") == 50_000
    ht.extract("<" * 100_000)
    ht.extract("<a b='" * 20_000)
    ht.extract("<div>" * 50_000)


def test_stretches_between_surge_and_dive():
    assert ht.stretches([0, 100, 5, 0, 7, 0, 0, 0, 3, 0, 0, 0, 90]) == [(1, 5), (12, 13)]
    assert ht.stretches([0, 5, 0, 0, 0, 9, 0]) == [(5, 6)] and ht.stretches([0, 0]) == [] and ht.stretches([]) == []


def test_frames(spark):
    df = docs_frame(spark, [(1, "<p>x</p>", "old"), (1, "<p>x</p>", "old"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in ht.extract_text(df).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert ht.extract_text(docs_frame(spark, [], "page_id long, html string")).count() == 0
