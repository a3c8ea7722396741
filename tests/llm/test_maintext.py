import html
import re
import time

import pytest

from affinis.llm.maintext import main_text, page_texts


def article_blocks(page):
    """The article of the table's pages, whose markup is known."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    body = re.sub(r"<!--.*?-->", "", found[1].replace("<br>", " "), flags=re.S)
    parts = [re.sub(r"</?b>", "", part) for part in re.split(r"</?(?:p|h1)>", body)]
    lines = [" ".join(html.unescape(part).split()) for part in parts]
    return "\n".join(line for line in lines if line)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in page_texts(pages, "html", ["page_id", "url"]).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article_blocks(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        assert got[r["page_id"]]["url"] == r["url"]


PROSE = "<p>A first paragraph, of some length, with commas in it.</p><p>A second one, with <b>bold</b> text &amp; more.</p>"
TEXT = "A first paragraph, of some length, with commas in it.\nA second one, with bold text & more."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("<html><body></body></html>", ""),
        ("just text", "just text"),
        ("a < b <b>c</b> &lt;d&gt;", "a < b c <d>"),
        (f"<div class='content no-sidebar'>{PROSE}</div>", TEXT),
        (f"<nav><a href=x>Menu, menu</a></nav><div>{PROSE}</div><footer>Foot, foot</footer>", TEXT),
        (f"<header><h1>Site</h1></header><main>{PROSE}</main><aside>Side, side, side</aside>", TEXT),
        (f"<article><header><h1>Title</h1></header>{PROSE}</article>", "Title\n" + TEXT),
        (f"<article>{PROSE}</article><section id='comments'><p>Reader, reader, reader, reader, reader.</p></section>", TEXT),
        (f"<article>{PROSE}<div class=\"cookie-notice\"><p>We use cookies, many, many.</p></div></article>", TEXT),
        (f"<article>{PROSE}<script>var t = '</p><p>x, y, z';</script><style>p, b{{}}</style></article>", TEXT),
        (f"<article>{PROSE}<form><p>Your name, please</p><input></form></article>", TEXT),
        (f"<article>{PROSE}<p hidden>No, no</p><div style='display: none'>No, no</div></article>", TEXT),
        (f"<article>{PROSE}<div class=\"advertBox\">Buy, buy</div><!-- <p>gone</p> --></article>", TEXT),
        (f"<article>{PROSE}<ul><li>one<li>two</ul><table><tr><td>three<td>four</table></article>", TEXT + "\none\ntwo\nthree\nfour"),
        (f"<article>{PROSE}<p>cut off in the mid", TEXT + "\ncut off in the mid"),
        (f"<article>{PROSE}<p>cut off<scr", TEXT + "\ncut off"),
        (f"<article>{PROSE}<p>cut off<!-- x", TEXT + "\ncut off"),
        ("<article><p>a\n\t b&nbsp;c<br>d</p></article>", "a b c d"),
        (f"<div><div>{PROSE}</div><div>{PROSE}</div></div>", TEXT + "\n" + TEXT),
        ("<ul><li><a href=1>One, two, three</a><li><a href=2>Four, five</a></ul><div><p>Text, plain, short.</p></div>", "Text, plain, short."),
        ("<article><p><b>Bold.<br><p>Next.<p>Last.</article>", "Bold.\nNext.\nLast."),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


SHORT = "<p>Short one, here.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><div>{SHORT * 4}</div><div>{SHORT * 2}</div></div>", "\n".join(["Short one, here."] * 6)),
        ("<div><p>Short lead.</p><div>" + "Long text, of one part. " * 20 + "</div><h2>Part</h2><p>Short end.</p></div>",
         "Short lead.\n" + ("Long text, of one part. " * 20).strip() + "\nPart\nShort end."),
        (f"<body><div><div>{SHORT * 20}</div></div><section><h2>Part</h2><div>{SHORT}</div></section><ul><li><a href=x>A link, a link</a></ul></body>",
         "\n".join(["Short one, here."] * 20 + ["Part", "Short one, here."])),
        (f"<div>Own words. <a href=x>One link</a><div>{SHORT * 4}</div><div>{SHORT}</div></div>",
         "\n".join(["Own words. One link"] + ["Short one, here."] * 5)),
        (f"<div><a href=x>Link, a link</a><div>{SHORT * 4}</div><table><tr><td>cell</table></div>", "\n".join(["Short one, here."] * 4 + ["cell"])),
    ],
)
def test_unequal_sections_without_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content-with-sidebar'><article>{PROSE}</article></div>", TEXT),
        (f"<div class='layout sidebar-right'><main>{PROSE}</main></div>", TEXT),
        (f"<div class='main-with-nav'>{PROSE}</div>", TEXT),
        (f"<div id='overlay'><article>{PROSE}</article></div>", TEXT),
        (f"<div class='modal'>{PROSE * 4}</div>", "\n".join([TEXT] * 4)),
        (f"<div class='ad'>{PROSE * 4}</div><article><p>Cut.", "Cut."),
        (f"<div class='page-notice'>{PROSE * 4}</div>", "\n".join([TEXT] * 4)),
        (f"<article><h2 id='related-work'>Related work</h2>{PROSE}</article>", "Related work\n" + TEXT),
        (f"<article>{PROSE}<section id='social-history'><p>Short.</p></section></article>", TEXT + "\nShort."),
        (f"<article>{PROSE}<p class='share-price'>It rose, then fell.</p></article>", TEXT + "\nIt rose, then fell."),
        (f"<article>{PROSE}<section id='menu-of-the-day'><p>Soup.</p></section></article>", TEXT + "\nSoup."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p></article>", "So x=2."),
        (f"<article><div aria-hidden='true'>{PROSE * 4}</div></article>", "\n".join([TEXT] * 4)),
        (f"<article>{PROSE}<div class='sidebar-box'><p>Short.</p></div><div class='share'>Share, share</div></article>", TEXT),
        (f"<article>{PROSE}</article><div class='comments'><article><p>Reader, reader, reader.</p></article></div>", TEXT),
    ],
)
def test_names_of_elements_that_hold_text(page, text):
    assert main_text(page) == text


def test_very_long_and_deep_pages():
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999
    deep = "<div>" * 3000 + "<p>deep, deep text.</p>" + "</div>" * 3000
    assert main_text(deep) == "deep, deep text."


def test_odd_rows(spark):
    rows = [(1, "u", None, "t", 3), (1, "u", None, "t", 3), (None, None, "<p>x</p>", "t", 3), (2, "v", "", "t", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"] or 0), r["url"], r["text"], r["n_chars"]) for r in page_texts(df, "html", ["page_id", "url"]).collect())
    assert got == [(0, None, "x", 1), (1, "u", "", 0), (1, "u", "", 0), (2, "v", "", 0)]
    assert page_texts(df.limit(0), "html", ["page_id", "url"]).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<p>" + "<span>x " * 100_000,
        "<b><div>" + "<span>" * 30_000 + "x</b>" * 30_000,
        "<div>" * 30_000 + "<tr>x" * 30_000,
        "<li><ul>" + "<span>" * 30_000 + "<li>x</li>" * 30_000,
        "<div>" + "<span>" * 30_000 + "<hr>x" * 30_000,
    ],
)
def test_unclosed_elements_take_linear_time(page):
    start = time.time()
    assert len(re.findall("x", main_text(page))) == page.count("x")
    assert time.time() - start < 5
