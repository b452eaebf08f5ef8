"""Names that also name an article's subjects, and readers' responses."""

import time

import pytest

from millrace.llm import html_text

P = "A paragraph of some words that tells readers what they want, at length, with commas, and ends."
NAMES = "legal side-effects notice tags forms search social alert reviews subscription ads notice-board-info".split()


def page(section, after=""):
    return f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{P}</p><p>{P}</p>{section}</article>{after}</body></html>"


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["section", "div"])
def test_sections_of_an_article_stay_whatever_their_name(name, tag):
    got = html_text.main_text(page(f'<{tag} class="{name}"><h2>About {name}</h2><p>{P}</p><p>{P}</p></{tag}>'))
    assert got.split("\n") == ["Title", P, P, f"About {name}", P, P]


@pytest.mark.parametrize("part", [
    '<div class="ads"><p>Buy our things, all of them, and soon.</p></div>', '<div class="notice"><p>We use things that you may want to know about.</p></div>',
    '<section class="social"><h3>Follow</h3><ul><li><a href=a>One of them</a></li><li><a href=b>Another</a></li></ul></section>',
    f'<div class="forms"><h2>Write to us</h2><p>{P}</p><input name=x><button>Go</button></div>', f'<div class="search-box"><h2>Search</h2><form><input></form></div>',
    f'<div class="comments"><h2>Comments</h2><p>{P}</p></div>', f'<section class="related-posts"><h2>More</h2><p>{P}</p></section>', '<div class="tags"><a href=x>one</a> <a href=y>two</a></div>',
])
def test_what_only_has_such_a_name_goes(part):
    assert html_text.main_text(page(part)).split("\n") == ["Title", P, P]


@pytest.mark.parametrize("name", ["reader-responses", "user-reviews", "responses", "comments", "visitor-feedback"])
def test_readers_responses_go(name):
    after = f'<section id="{name}"><h2>What readers say</h2><p>{P} One.</p><p>{P} Two.</p></section>'
    assert html_text.main_text(page("", after)).split("\n") == ["Title", P, P]
    assert html_text.main_text(page(after)).split("\n") == ["Title", P, P]


def test_deep_nesting_of_such_names_is_linear():
    text = "<article>" + '<div class="tag">' * 60_000 + f"<h2>x</h2><p>{P}</p>"
    began = time.perf_counter()
    html_text.main_text(text)
    assert time.perf_counter() - began < 20
