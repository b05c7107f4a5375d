"""Main texts of pages as sites write them: twenty templates with a known article."""

import random
from collections import Counter

import pytest

from siteloom.llm import html_text

RNG = random.Random(41)


def prose(n):
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(n))


def paragraphs(k=5, n=60):
    return [prose(n) for _ in range(k)]


NAV = "<nav class='main-nav'><ul>" + "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(20)) + "</ul></nav>"
FOOT = "<footer><p>Imprint and all rights reserved of this site for ever</p></footer>"
SIDE = "<div class='sidebar'><h3>Latest</h3><ul>" + "".join(f"<li><a href='/s{k}'>sidebar story {k}</a></li>" for k in range(12)) + "</ul></div>"
TALK = lambda n=6: "<div id='comments' class='comments-area'><h2>Thoughts</h2><ol class='comment-list'>" + "".join(f"<li><article class='comment'><p>{prose(40)}</p></article></li>" for _ in range(n)) + "</ol></div>"


def block(ps):
    return "".join(f"<p>{p}</p>" for p in ps)


def case(name):
    """The page's markup and its article."""
    ps = paragraphs()
    t, body = prose(6), block(ps)
    whole = [t, *ps]
    pages = {
        "bare": (f"<h1>{t}</h1>{body}", whole),
        "has_sidebar": (f"{NAV}<div class='site has-sidebar'><article><h1>{t}</h1>{body}</article>{SIDE}</div>{FOOT}", whole),
        "ad_free": (f"<div class='content ad-free'><h1>{t}</h1>{body}</div>{FOOT}", whole),
        "share_enabled": (f"{NAV}<div class='post share-enabled'><h1>{t}</h1>{body}<div class='share'>Send this on</div></div>", whole),
        "comments_open": (f"<div class='post comments-open'><h1>{t}</h1>{body}</div>{TALK()}{FOOT}", whole),
        "aspnet_form": (f"<form id='aspnetForm' method='post'><input type='hidden'>{NAV}<div class='main'><h1>{t}</h1>{body}</div>{FOOT}</form>", whole),
        "header_in_article": (f"<header class='site-header'><a href='/'>Name of the site</a></header><article><header class='entry-header'><h1>{t}</h1></header>{body}<footer>Filed under news</footer></article>", whole),
        "math": (f"<article><h1>{t}</h1>{body}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", [*whole, "so x=2 holds"]),
        "table_layout": (f"<table><tr><td class='menu'>{NAV}</td><td><h1>{t}</h1>{body}</td></tr></table>", whole),
        "loud_readers": (f"{NAV}<main><article><h1>{t}</h1>{body}</article>{TALK(30)}</main>{FOOT}", whole),
        "cookie_notice": (f"<div class='cookie-notice'><p>{prose(60)}</p></div>{NAV}<article><h1>{t}</h1>{body}</article>", whole),
        "role_main": (f"{NAV}<div role='main' id='page'><h1>{t}</h1>{body}</div><div role='complementary'>{prose(80)}</div>", whole),
        "sections": (f"<main><h1>{t}</h1>" + "".join(f"<section><p>{p}</p></section>" for p in ps) + f"</main>{FOOT}", whole),
        "lists": (f"<article><h1>{t}</h1><ul>" + "".join(f"<li>{p}" for p in ps) + "</ul></article>", whole),
        "nested": (f"<div id='wrap'><div id='page-wrapper'><div class='row'>{NAV}<div class='col content'><h1>{t}</h1><div class='body'>{body}</div></div>{SIDE}</div></div></div>", whole),
        "unclosed": (f"{NAV}<article><h1>{t}</h1>" + "".join(f"<p>{p}" for p in ps), whole),
        "inline_advert": (f"<article><h1>{t}</h1>{block(ps[:2])}<div class='ad-slot advert'>Buy this now</div>{block(ps[2:])}</article>", whole),
        "newsletter": (f"<article><h1>{t}</h1>{block(ps[:3])}<form class='newsletter'>Get our letter <input><button>Go</button></form>{block(ps[3:])}</article>", whole),
        "sidebar_page": (f"<body class='sidebar-left menu-open'><div class='no-sidebar'><h1>{t}</h1>{body}</div>{FOOT}", whole),
        "related": (f"<article><h1>{t}</h1>{body}</article><section class='related-posts'><h2>More</h2><p>{prose(40)}</p></section><aside>{prose(50)}</aside>", whole),
        "hidden": (f"<article><h1>{t}</h1>{body}<div style='display: none'>{prose(50)}</div><div hidden>{prose(20)}</div></article>", whole),
        "link_list": (f"<div class='links'>" + "".join(f"<a href='/{k}'>{prose(5)}</a>" for k in range(60)) + f"</div><div class='text'><h1>{t}</h1>{body}</div>", whole),
    }
    return pages if name is None else pages[name]


NAMES = sorted(case(None))


@pytest.mark.parametrize("name", NAMES)
def test_template(name):
    html, expected = case(name)
    page = html_text.Page(html if "<body" in html else f"<html><head><title>t</title></head><body>{html}</body></html>")
    best = page.best()
    got, want = Counter(page.text(best.path if best else None).split()), Counter(" ".join(expected).split())
    both = sum((got & want).values())
    assert both >= 0.95 * sum(want.values()) and both >= 0.95 * sum(got.values())


def test_templates_by_host(spark):
    """The same pages through Spark, five of each template on a host of its own; equal votes, repeated rows and other columns."""
    rows = [(10 * k + j, f"http://h{k}/x", f"<html><body>{html}</body></html>", " ".join(expected)) for k, n in enumerate(NAMES) for j in range(5) for html, expected in [case(n)]]
    rows += rows[:3]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, expected string")).collect()
    assert len(got) == len(rows)
    for r in got:
        have, want = Counter(r.text.split()), Counter(r.expected.split())
        both = sum((have & want).values())
        assert both >= 0.95 * sum(want.values()) and both >= 0.95 * sum(have.values())


def test_tie_goes_to_the_first_path(spark):
    a, b = "<div class='b'>same words here</div>", "<div class='a'>same words here</div>"
    votes = html_text.host_votes(spark.createDataFrame([("http://h/1", a), ("http://h/2", b)], "url string, html string"))
    assert html_text.winning_paths(votes).first().path == ">div.a"
