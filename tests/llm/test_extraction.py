import re

import pytest

from tidemark.llm.extraction import extract, main_text, regions

ART = ["A long opening sentence that any reader would call the article, with &amp; and &eacute;.",
       "Be.", "Another paragraph of the same piece, rather long as well, with <b>bold</b>ness and <a href='/x'>a link</a>.",
       "End."]
WANT = ("A long opening sentence that any reader would call the article, with & and é. Be. Another paragraph of the "
        "same piece, rather long as well, with boldness and a link. End.")
BODY = "".join(f"<p>{p}</p>\n" for p in ART)
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of a long and winding road</a></li></ul></nav>"
ADV = '<div class="ad">Buy this very long advert text now, for it is cheap and good and all people like it.</div>'
FOOT = "<footer>&copy; site, all rights and a very long notice that goes on and on for a hundred characters or so.</footer>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{NAV}{ADV}<article>{BODY}</article>{FOOT}</body></html>",
    f"<body>{NAV}<main>{BODY}</main><div id='comments'><p>Reader: what a long comment this is, about nothing at all, on and on.</p></div>{FOOT}",
    f"<body><header><h1>Site</h1></header><article>{BODY}<aside>See also a long list of other things to be read by you.</aside></article>",
    f"<body><article><div class='ad'>x</div>{BODY}<section class='comments'><article>I disagree with it all.</article></section></article>",
    f"<body>{NAV}<div class='post'>{BODY}</div>{FOOT}",
    f"<BODY><DIV CLASS=sidebar>long sidebar text that is in no way part of the article</DIV><ARTICLE>{BODY}</ARTICLE>",
    f"<body><div class=ad>unclosed advert<article>{BODY}</article>",
    f"<body><article><!-- <p>no</p> -->{BODY}<form><label>Mail</label><input name='a>b'></form>",
])
def test_article_without_boilerplate(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<div><br></div>", ""), ("plain words", "plain words"), ("a < b & c", "a < b & c"),
    ("<article>Hi.</article>", "Hi."), ("<article><p><b>x<br><p>y&nbsp;&nbsp;z</article>", "x y z"),
    ("<article>a&#x41;&#66;&lt;p&gt;</article>", "aAB<p>"), ("<script>x", ""), ("<article>a<!-- b", "a"),
    ("<article>" + "<p>w</p>" * 20_000, " ".join(["w"] * 20_000)), ("<article>" + "<" * 50_000 + "</article>", "<" * 50_000),
    ("<p " + "a='" * 3000, ""),
])
def test_edges(page, want):
    assert main_text(page) == want


def test_regions_lie_between_surge_and_dive():
    got = list(regions([0, 0, 5, 200, 0, 3, 0, 0, 0, 0, 10, 0], 86))
    kept = [k for a, b in got for k in range(a, b)]
    assert {2, 3, 5} <= set(kept) and 10 not in kept


def test_rows(spark):
    rows = [(1, "u", "<article>a b</article>", "x"), (1, "u", "<article>a b</article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3)]
    assert extract(df.limit(0)).count() == 0


def test_given_pages_equal_their_article(spark):
    """On the given pages the article element is the whole truth."""
    import html
    import os
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = {r.page_id: r.html for r in spark.read.parquet(path).collect()}
    for r in extract(spark.read.parquet(path)).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", body)]
        assert r.text == " ".join(b for b in blocks if b)


@pytest.mark.parametrize("wrap", ["<p>{}</p>", "<div><p>{}</p></div>", "<div><div><section><p>{}</p></section></div></div>"])
def test_short_lines_in_wrappers_stay_without_an_article_element(wrap):
    blocks = "".join(wrap.format(p) for p in ("A heading", *ART))
    page = f"<body>{NAV}{ADV}<div class='post'><div>{blocks}</div></div>{FOOT}</body>"
    assert main_text(page) == "A heading " + WANT


def test_lines_of_links_stay_inside_the_article_alone():
    link = "<p><a href='/x'>A source that is a link</a></p>"
    assert main_text(f"<body><article>{BODY}{link}</article>{link}</body>") == f"{WANT} A source that is a link"
    assert main_text(f"<body><div>{BODY}{link}</div></body>") == WANT
