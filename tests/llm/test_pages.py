"""Main text of pages: layouts, markup and awkward tables."""

import time

import pytest

from attrloom.llm.pages import extract, main_text

LINE = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
ARTICLE = (f"<h1>Head &amp; line</h1><p>{LINE} {LINE}</p><p>Short.</p><p>{LINE}<a href=x>link</a> end</p>"
           "<ul><li>one item<li>two item</ul><blockquote>q</blockquote>")
TEXT = "\n\n".join(["Head & line", f"{LINE} {LINE}", "Short.", f"{LINE}link end", "one item", "two item", "q"])
LINKS = "".join(f"<a href=/{k}>Item {k}</a> " for k in range(9))


@pytest.mark.parametrize("page", [
    f"<html><body><div id=top>{LINKS}</div><div class=cookie-bar>We use cookies. {LINE}</div><div id=content><div class=post>{ARTICLE}</div></div>"
    f"<div class='sidebar'><p>{LINE}</p></div><div id=comments><p>{LINE * 5}</p></div><div class=footer>{LINE}</div></body></html>",
    f"<body><header><h1>Site</h1><p>{LINE}</p></header><main>{ARTICLE}</main><aside>{LINE * 3}</aside><footer>{LINE}</footer>",
    f"<body><table><tr><td>{LINKS}<td>{ARTICLE}<td>{LINKS}</table>",
    f"<article class='post comments-open has-sidebar'>{ARTICLE}<section id=comments><article class=comment><p>{LINE * 9}</p></article></section>"
    f"<footer>By me</footer></article><div>{LINE}</div>",
    f"<body><ul class=x1>{''.join(f'<li><a href={k}>Page {k}</a></li>' for k in range(30))}</ul><div class=x2>{ARTICLE}</div>"
    f"<form>Your name <input><p>{LINE * 4}</p></form><script>var x = '<p>{LINE}</p>';</script><style>p {{}}</style><!-- <p>{LINE}</p> -->",
])
def test_layouts(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just  text\n no markup &lt;b&gt;", "just text no markup <b>"), ("<script>never ends <p>x</p>", ""), ("a <!-- b", "a"),
    ("<p>a<p>b<div>c", "a\n\nb\n\nc"), ("<article><p>a&nbsp;b   c\n\td<br>e</p><p>x<b>y</b>z &#128512; &eacute;&bogus;</p></article>", "a b c d e\n\nxyz 😀 é&bogus;"),
    ("<nav>x</nav><div class=notice>A long notice to the reader of it</div><article><p>Hi.</p></article>", "Hi."),
    ("<P>Upper</P><p hidden>no</p><p style='display: none'>no</p>", "Upper"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<title>t</title><body>own text<p>more</p>", "own text\n\nmore"), ("<a title='a > b'>link</a> text", "link text"),
])
def test_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<i><p>" + "<b>" * 30_000 + "</i>" * 30_000, "<" * 300_000, '<a href="' * 50_000, "<!--" * 100_000,
                                  "<ul>" * 20_000 + "<li>" * 20_000, "<script>" * 50_000, "</div>" * 100_000, "<p>a</p>" * 50_000])
def test_time_is_linear(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 20


def test_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "own", 3), (1, "u", f"<article>{ARTICLE}</article>", "own", 3), (None, None, None, None, None), (2, None, "", "", 0),
            (3, "v", "<p>" + "long text " * 300_000, "", 0), (4, "w", "<p>&#xD800; &#x110000; x", "", 0)]
    got = extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted([tuple(r) for r in got.collect()], key=lambda r: (r[0] or 0, r[3]))
    assert found[:2] == [(None, None, "", 0), (1, "u", TEXT, len(TEXT))] and found[2] == found[1]
    assert found[3] == (2, None, "", 0) and found[4][3] == 10 * 300_000 - 1 and found[5][3] == len(found[5][2])
    assert extract(spark.createDataFrame([], schema)).count() == 0
