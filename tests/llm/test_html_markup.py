import time

import pytest

from paperloom.llm import html_region
from test_html_bounds import BODY, both

LINES = BODY.replace("<p>", "").split("</p>")[:-1]
TEXT = "\n".join(LINES)


def texts(page):
    return {html_region.main_text(page, w) for w in both()}


@pytest.mark.parametrize(
    "page",
    [
        f"<div><p class=ad>Buy now<p>{'<p>'.join(LINES)}</div>",
        f"<div><p>{'<p>'.join(LINES)}<p class=ad>Buy now</div>",
        f"<dl><dt class=related>x<dd>{'<dd>'.join(LINES)}</dl>",
        f"<ul><li class=share>Share it<li>{'<li>'.join(LINES)}</ul>",
        f"<table><tr><td class=menu>Home<td>{'<td>'.join(LINES)}</table>",
        f"<table><tr class=menu><td>Home<tr><td>{'<tr><td>'.join(LINES)}</table>",
        f"<div class='comment-enabled post'>{BODY}</div>",
        f"<div class=has-sidebar><div class=sidebar>Links and more</div>{BODY}</div>",
        f"<article><section class=related-work>{BODY}</section></article>",
        f"<article>{BODY.replace('<p>', '<p class=print>')}</article>",
        f"<div class=overlay><h1></h1>{BODY}</div>",
        f"<div class=social>{BODY}</div>",
        f"<article>{BODY}<section class=comments>{BODY.replace('Sentence', 'Reply')}</section></article>",
        f"<article>{BODY}<div class='article-comments'><h3>Replies</h3>{BODY.replace('Sentence', 'Reply')}</div></article>",
        f"<article>{BODY}<div class='adSlot-3'>Buy this</div><div id=newsletter-offer>Join our list today</div></article>",
        f"<article title='a hidden class=\"ad\"'>{BODY}</article>",
        f"<article>{BODY.replace('</p>', '<button>Share</button></p>')}</article>",
        f"<article><div><table><tr><td>{BODY}</div></td></tr></table></div></article>",
        f"<nav><a href=/x>Home<a href=/y>News</nav><article>{BODY}</article>",
    ],
)
def test_whole_article_and_nothing_else(page):
    assert texts(f"<body>{page}</body>") == {TEXT}


def test_a_class_that_mentions_boilerplate_goes_where_few_words_stand():
    assert texts(f"<body><article>{BODY}<div class=banner-image>Picture of a thing</div></article>") == {TEXT}


def test_link_ends_where_its_element_ends():
    events, _, _ = html_region.parse("<a href=x><p>linked words</a><p>plain words")
    assert [f[2] for f, n, b in events if b >= 0] == [True, False]


def test_kind_of_words_does_not_depend_on_depth():
    for depth in (1, 50):
        events, _, _ = html_region.parse("<ul><li>" + "<b>" * depth + "words")
        assert [f[1] for f, n, b in events if b >= 0] == ["li"]


@pytest.mark.parametrize(
    "name, names",
    [("comments", True), ("comment-list", True), ("post-comments", True), ("adBox", True), ("ad-slot-3", True), ("related-articles", True), ("related-work", False), ("comment-enabled", False), ("has-sidebar", False), ("no-comments", False), ("newsletter-essay", False), ("post", None), ("shadow", None), ("", None), ("-", None)],
)
def test_class_names(name, names):
    assert html_region._names_boilerplate(name) is names


@pytest.mark.parametrize("piece", ["<a b=\"", "<a ", "<a\">\"", "<a b='>\"", "<!", "</a b=\"", "<p><section><dd>", "<span><div><b></span>", "<li><div class=ad>", "<b class='"])
def test_broken_markup_takes_linear_time(piece):
    begun = time.process_time()
    html_region.main_text(piece * 80_000, html_region.weights({}))
    assert time.process_time() - begun < 20
    assert texts(f"<body><article>{BODY}</article>{piece * 3}") == {TEXT}
