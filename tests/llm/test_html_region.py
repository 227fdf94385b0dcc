import random

import pytest

from paperloom.llm import html_region

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site name here</h2></header><nav><ul><li><a href="/a>b">Menu one</a></li><li><a>Menu two</a></li></ul></nav><div class="cookie-notice">We use cookies on this site</div>
<!-- <p>gone</p> --><article><h1>Head &amp; tail</h1><p>First   para&shy;graph with <b>bold</b>,<br>a break &#233; &amp more.
<div class="ad">Buy this now</div><p>Second &lt;one&gt;.</p><form>Name <input></form><aside>See also</aside><ul><li><a href=x>Listed</a></li></ul>
<section id="comments"><p>A reader says no</p></section></article><aside>Side</aside><footer>&copy; end words</footer></body></html>"""


def learned():
    counts = html_region.Counter()
    for _ in range(3):
        counts.update(html_region.count_page(PAGE))
    return html_region.weights(counts)


def test_article_without_the_rest():
    want = "Head & tail\nFirst para\xadgraph with bold, a break é & more.\nSecond <one>.\nListed"
    assert html_region.main_text(PAGE, learned()) == want
    assert html_region.main_text(PAGE, html_region.weights({})) == want


def test_page_without_main_element():
    page = "<body><div class=menu><a>Home</a> <a>News</a></div><div><p>Some long text of a page that has no article around it.</p><p>More of it, and more.</p></div><div id=footer>Imprint and so on</div>"
    assert html_region.main_text(page, html_region.weights({})) == "Some long text of a page that has no article around it.\nMore of it, and more."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<>>", "<p", "<!--", "<script>x", "</div></p>", "<a href=\"", "<br/>", "&amp;" * 3, "<div>" * 3000, "<p>a" * 2000])
def test_broken_pages_give_a_text(page):
    assert isinstance(html_region.main_text(page, html_region.weights({})), str)


def test_best_run_is_the_greatest_sum():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randint(-4, 4) for _ in range(rng.randrange(12))]
        a, b = html_region.best_run(x)
        sums = [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        assert sum(x[a:b]) == max([0, *sums])


def test_every_page_has_a_row(spark):
    rows = [(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (None, None, None, None), (3, "v", "", "z"), (2**60 + 1, "w", "<p>plain words of text</p>" * 500, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_region.extract(pages).collect()
    assert sorted((r["page_id"] or -1) for r in got) == sorted((r[0] or -1) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].startswith("Head & tail\n") for r in got) == 2
    assert [r["n_chars"] for r in got if r["page_id"] == 2**60 + 1] == [500 * len("plain words of text") + 499]
    assert html_region.extract(pages.limit(0)).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_region.extract(pages).collect():
        inside = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["n_chars"] > 0 and all(b.split()[0].replace("&", "&amp;").replace('"', "&quot;") in inside for b in r["text"].split("\n"))
