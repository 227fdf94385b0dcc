import re

from paperloom.llm import html_region
from test_html_region import PAGE, learned

BODY = "".join(f"<p>Sentence number {i} of the body says something long enough to be read by people.</p>" for i in range(8))
CARD = "<article><h3><a href=/x>Another story here</a></h3><p>Short words that lead to it.</p></article>"


def both():
    return learned(), html_region.weights({})


def test_bounds_without_any_container():
    want = html_region.main_text(PAGE, learned())
    for weight in both():
        assert html_region.main_text(re.sub(r"<(/?)article>", r"<\1div>", PAGE), weight) == want


def test_teaser_cards_are_not_the_body():
    want = "\n".join(re.findall(r"<p>(.*?)</p>", BODY))
    for weight in both():
        for page in (BODY + CARD * 3, CARD * 3 + BODY, CARD + BODY + CARD):
            assert html_region.main_text(f"<body><nav><a>Home</a></nav><div>{page}</div></body>".replace(BODY, f"<div>{BODY}</div>"), weight) == want


def test_words_beside_the_body_in_its_container_do_not_make_bounds():
    weight = html_region.weights({})
    page = f"<body><article><p>One card.</p></article><div>{BODY}</div></body>"
    assert html_region.main_text(page, weight).startswith("Sentence number 0")


def test_pages_of_cards_are_no_labels():
    assert not html_region.count_page(f"<body><div>{BODY}</div>{CARD}</body>")
    assert not html_region.count_page(f"<body>{CARD * 3}</body>")
    assert html_region.count_page(f"<body><article>{BODY}</article></body>")


def test_given_pages_without_containers_keep_their_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    counts = html_region.Counter()
    for r in pages:
        counts.update(html_region.count_page(r["html"]))
    weight = html_region.weights(counts)
    for r in pages:
        bare = re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", r["html"])
        assert html_region.main_text(bare, weight) == html_region.main_text(r["html"], weight) != ""
