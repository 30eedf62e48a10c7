import html
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from scriven.llm import html_text as H


def marked(page):
    text = " ".join(re.findall(rf"<!--{H.KEEP}-->(.*?)<!--{H.DROP}-->", page, re.S))
    return " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", text)).split())


def test_held_out_layouts():
    """Pages of other nestings, containers and junk than those learned from: nearly all words that are wanted, hardly another."""
    pages = H.labelled_pages(200, seed=77)
    wanted = missed = extra = same = 0
    for p in pages:
        got, want = Counter(H.main_text(p).split()), Counter(marked(p).split())
        wanted, missed, extra, same = wanted + want.total(), missed + (want - got).total(), extra + (got - want).total(), same + (got == want)
    assert missed < 0.005 * wanted and extra < 0.01 * wanted and same > 0.9 * len(pages)


SAID = " ".join(["word"] * 40) + "."


@pytest.mark.parametrize(
    ("before", "after"),
    [("<div><p>", ""), ("<body><div class='zone-x'><p>", ""), ("<div class=story><p>", "</div>"), ("<section><p>", ""), ("<div><div>", "</div></div>"), ("", ""), ("<p>", ""), ("<table><tr><td>", ""),
     ("<div id=qpx><ul><li><a href=x>one</a><li><a href=x>two</a></ul></div><div class=qq><p>", "</div><div class=vv><a href=x>more</a> <a href=x>again</a></div>"),
     ("<div class=mainmenu><a href=x>one</a></div><div class=u7><p>", "</p><div class=commentlist><p>I think that this is a fine page, thanks.</p></div></div>"),
     ("<span class=ad>Buy this now.</span><div><p>", "</p></div><div class='advert-box'><p>" + "Buy more of it now. " * 30 + "</p></div>")],
)
def test_unknown_containers(before, after):
    assert H.main_text(before + SAID + after) == SAID


WRAPPERS = [
    '<div class="has-sidebar">', '<div class="has-sidebar"><article>', '<div id="main" class="no-sidebar">', '<main class="with-sidebar">', '<article class="post comments-open">', '<div class="no-comments"><main><article class="post">',
    '<div class="header-fixed">', '<div class="sticky-header content">', '<div class="page share-enabled">', '<div class="contact-page">', '<section class="news-alert">', '<div class="popular-science"><article>',
    '<div class="search-result-page"><article>', '<div class="layout-sidebar-left">', '<div class="main content has-sidebar">', '<div class="widget-free">', '<div class="ad-free article">', '<div class="hasSidebar">', '<div class="header-image-post">',
]
MENU = "<nav class=menu><ul><li><a href=x>Home</a></li><li><a href=x>About us</a></li></ul></nav>"
ASIDE = "<aside class=sidebar><h3>Related</h3><p>You may like this other story about some things here.</p></aside>"
COMMENTS = "<section class=comments><h3>Comments</h3>" + "<div class=comment><p>I think this is a really good page and I liked reading it, thanks.</p></div>" * 6 + "</section><footer><p>All rights are reserved for ever and ever, dear reader.</p></footer>"


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_named_after_junk(wrapper):
    """No article is lost to a name on what holds it, whatever stands around."""
    paragraphs, ends = f"<p>{SAID}</p>" * 3, "</article></main></section></div>"
    for before, head, after in (("", "", ""), (MENU, "", ends), (MENU, "<h1>Head line</h1>", ends + COMMENTS), (MENU, "", ASIDE + ends + COMMENTS), (MENU, "", ends + COMMENTS)):
        assert H.main_text(before + wrapper + head + paragraphs + after) == " ".join(["Head line"] * bool(head) + [SAID] * 3)


@pytest.mark.parametrize("name", ["sidebar-left", "left-sidebar", "ad-right", "footer-main", "comments-area", "related-list", "cookie-box"])
def test_junk_of_several_words_goes(name):
    page = f"<div class=page><article><h1>Head line</h1><p>{SAID}</p></article><div class='{name}'><p>Something else that nobody asked for is here.</p></div></div>"
    assert H.main_text(page) == f"Head line {SAID}"


@pytest.mark.parametrize("unclosed", ["<b>x ", "<div>x ", "<b>x <h2>", "<div class=c{}>x ", "<li class=sidebar>x ", "</i></div><span>x "])
def test_time_is_linear_in_open_elements(unclosed):
    import time

    began = time.process_time()
    got = H.main_text("<article>" + "".join(unclosed.format(i) for i in range(100_000)))
    assert time.process_time() - began < 10 and isinstance(got, str)


def test_a_long_advert_does_not_cut_an_article_in_two():
    advert = "<div class=advert><p>" + "Buy more of it now. " * 300 + "</p></div>"
    assert H.main_text(f"<div><p>{SAID}</p>{advert}<p>{SAID}</p></div>") == f"{SAID} {SAID}"


def test_pages_of_the_table():
    """The whole article of each page, by a plain reading of its markup."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inside = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        text = html.unescape(re.sub("<[a-z/][^>]*>", lambda m: "" if re.fullmatch("</?(a|b|i|em|strong)", m[0][:-1].split()[0]) else " ", inside))
        assert H.main_text(page["html"]) == " ".join(text.split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>menu</a></nav>", ""),
        ("<article><p>a&amp;b &lt;i&gt; caf&eacute;\n\t x&nbsp;y</p><p>2<b>nd</b><br>line</p></article>", "a&b <i> café x y 2nd line"),
        ("<article><p>if 3 < 4 or x < y ok</p><script>var t='</p>';</script><style>p{}</style><!-- no --><p>end</article>", "if 3 < 4 or x < y ok end"),
        ("<article><p>one <a title='a>b'>two</a><div class=ad>buy</div><p>three</article><script>never closed", "one two three"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<html><head><title>no</title><meta charset=x><script>'<p>no'</script><body><article><p>one two</article>", "one two"),
        ("<head><title>no</title><article><p>one two</article>", "one two"), ("<head><style>p</style></head><body><article><p>one</article>", "one"),
        ("<head><title>no</title><body><article><p>one</p><p>say &lt;/head></p></head><p>two</article>", "one say </head> two"),
        ("<article><p>one</p><svg class=i/><p>two</p><math /><p>three</article>", "one two three"),
        ("<article><p>one</p><svg><path d=x></svg><p>two</p><select><option>no</select><p>three</article>", "one two three"),
        *((f"<article><p>one</p><{t}><p>two</article>", "one two") for t in ("select", "object", "canvas", "svg", "math")),
    ],
)
def test_cases(page, want):
    assert H.main_text(page) == want


def test_scan_finds_the_best_region():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 9))]
        best = max([0, *(sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2))])
        a, b = H.best_region(s)
        assert sum(s[a:b]) == best


def test_very_long_and_hostile_pages():
    assert H.main_text("<article>" + "<p>word " * 50_000) == " ".join(["word"] * 50_000)
    assert isinstance(H.main_text("<div " * 3000 + "\"'" * 100), str)
    assert H.main_text("<article>" + "<b>" * 3000 + "deep") == "deep"
    assert H.main_text("<article>" + "<svg>" * 3000 + "word " * 100_000).count("word") == 100_000


def test_query(spark, tmp_path):
    rows = [(1, "u", "<article><p>hi there</p></article>"), (1, "u", "<article><p>hi there</p></article>"), (None, None, None)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in H.op5_html_text(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "u", "hi there", 8)] * 2 + [(None, None, "", 0)]
