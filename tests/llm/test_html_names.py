"""Names that only look like menus or adverts, and markup that is deep or broken."""

import time
import tracemalloc

import pytest

from siteloom.llm.html_text import Page

WORDS = "The measured values of the survey are given in the table below and were taken over several years by the same people. "


def text(html):
    page = Page(html)
    best = page.best()
    return page.text(page.path_of(best) if best else None)


BODY = f"<p>{WORDS * 3}</p>"
KEPT = [
    '<h2 id="related-work">Related work of others</h2>', f'<section id="sharing-data"><p>{WORDS * 2}</p></section>', '<p class="share-price">The share price rose.</p>', '<div class="recipe-menu">Soup, bread and fish.</div>',
    '<ul class="social-history"><li>Guilds and unions</li></ul>', '<h2 id="notice">Notice of the court</h2>', '<div id="related"><p>Cases related to this one.</p></div>', '<p id="ads">Ads are studied here.</p>', f'<div class="notice"><p>{WORDS * 2}</p></div>',
    '<h3 id="comments">Comments on the method</h3>',
]
DROPPED = [
    '<div class="share-buttons"><a href="/f">Post it</a> <a href="/t">Send it</a></div>', '<div class="ad-slot">Buy now</div>', '<div class="related-posts"><ul><li><a href="/1">First other text</a></li><li><a href="/2">Second other text</a></li></ul></div>',
    f'<section id="comments"><p>Great text, thanks. {WORDS}</p></section>', '<div class="newsletter-signup">Get our letter every week</div>', '<div class="breadcrumbs"><a href="/">Home</a></div>', '<div class="social">Follow us</div>',
]


@pytest.mark.parametrize("part", KEPT)
@pytest.mark.parametrize("frame", ["<body><nav><a href='/'>Home</a></nav><article><h1>T</h1>{}</article></body>", "<body><main>{}</main><footer>Imprint</footer></body>"])
def test_kept(part, frame):
    import re

    expected = " ".join(re.sub("<[^>]*>", " ", part).split())
    got = text(frame.format(BODY + part + BODY))
    assert expected in got and got.count("measured values") == (BODY * 2 + part).count("measured values")


@pytest.mark.parametrize("part", DROPPED)
def test_dropped(part):
    got = text(f"<body><article><h1>T</h1>{BODY}{part}{BODY}</article></body>")
    assert got == " ".join(["T", *((WORDS * 6).split())])


@pytest.mark.parametrize("id", ["related-work", "share-prices", "ads-in-history"])
def test_headings_without_article(id):
    assert "A heading" in text(f'<body><div class="content"><h2 id="{id}">A heading</h2>{BODY}</div></body>')


@pytest.mark.parametrize(
    "page",
    ['<div class="row">' * 20_000 + "deep text", "<b>" * 20_000 + "x</p>" * 20_000, "<p>" + "<i>x" * 20_000, "<ul><li>x" * 10_000, "<table><tr><td>x" * 7_000, "<div>x" * 20_000, "<span>x</div>" * 20_000, "<li>x" * 20_000, ("<b>" * 50 + "<p>x") * 500],
    ids=["divs", "stray", "inline", "lists", "tables", "text", "spans", "items", "bold"],
)
def test_deep_and_broken(page):
    began = time.time()
    tracemalloc.start()
    text(page)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert time.time() - began < 20 and peak < 100 << 20, (time.time() - began, peak)
