"""XPath over tolerant trees: axes, predicates, functions, malformed and very deep markup."""

import time

import pytest

from siteloom.sources import html as H, xpath

PAGE = """<html lang=en><head><title>T &amp; t<link rel=next href=/2></head><body class="a b">
<div id=top><p>One<p class=x>Two <b>bold</b><ul><li>1<li>2<ul><li>2a</ul><li id=three>3</ul><br>
<table><tr><td>a<td>b<tr><td colspan=2>c</table></div>
<div><p>Price: <span class="price now">12.50</span></p><a href="/x?a=1&amp;b=2">x</a><a>no target</a><A HREF='/y'>y</A></div></span></body>"""
CASES = {
    "//p": ["One", "Two bold", "Price: 12.50"], "//div[1]/p[2]": ["Two bold"], "//p[@class]": ["Two bold"], "//p[@class='x']/b": ["bold"], "//li": ["1", "22a", "2a", "3"], "/html/body/div/ul/li": ["1", "22a", "3"],
    "//ul/li[last()]": ["2a", "3"], "(//li)[last()]": ["3"], "//li[position() < 3]": ["1", "22a", "2a"], "//td": ["a", "b", "c"], "//tr[2]/td/@colspan": ["2"], "//a/@href": ["/x?a=1&b=2", "/y"], "//a[not(@href)]": ["no target"],
    "//*[contains(concat(' ', normalize-space(@class), ' '), ' price ')]": ["12.50"], "number(//span) * 2": ["25"], "count(//li)": ["4"], "string(//title)": ["T & t"], "//li[@id='three']/preceding-sibling::li[1]": ["22a"],
    "//li[1]/following-sibling::li": ["22a", "3"], "//b/..": ["Two bold"], "//b/ancestor::div/@id": ["top"], "//b/parent::p/@class": ["x"], "//p/text()": ["One", "Two", "Price:"], "//td[.='b' or . = 'c']": ["b", "c"],
    "//p | //td[1]": ["One", "Two bold", "a", "c", "Price: 12.50"], "//a[starts-with(@href, '/y')]": ["y"], "//div[span]": [], "//div[.//span > 12]/a[1]": ["x"], "//li[li]": [], "//li[descendant::li]": ["22a"], "/html/@lang": ["en"],
    "name(//div/*[last()])": ["table"], "//link[@rel = 'next']/@href": ["/2"], "boolean(//nosuch)": ["false"], "//body/div[2]/a[position() mod 2 = 1]": ["x", "y"], "substring-after(//a/@href, '?')": ["a=1&b=2"], "translate(//b, 'bo', 'B')": ["Bld"],
    "//p[2][@class='x']": ["Two bold"], "//p[@class='x'][2]": [], "-1 + 3": ["2"], "//@id": ["top", "three"], "./html//b": ["bold"], "//div[count(p) = 1]/p": ["Price: 12.50"], "//p[string-length() < 4]": ["One"], "//li/self::li[1]/text()": ["1", "2", "2a", "3"],
}


@pytest.mark.parametrize("expression", CASES)
def test_cases(expression):
    assert xpath.evaluate(xpath.compiled(expression), xpath.Tree(PAGE), most=9) == CASES[expression]


def test_kinds_of_values():
    tree = xpath.Tree('<p id="a">x &lt; <b>y</b><br></p><script>if (a<b) {}</script>')
    assert xpath.evaluate(xpath.compiled("//p"), tree, "html") == ['<p id="a">x &lt; <b>y</b><br></p>']
    assert xpath.evaluate(xpath.compiled("//p"), tree, "attribute", "id") == ["a"] and xpath.evaluate(xpath.compiled("//b"), tree, "attribute", "id") == []
    assert xpath.evaluate(xpath.compiled("//script"), tree) == ["if (a<b) {}"]


@pytest.mark.parametrize("bad", ["//a[", "//a]", "foo::a", "nosuch(1)", "//", "a b", "", "//a[@]", "#", "'"])
def test_refused(bad):
    with pytest.raises(ValueError):
        xpath.compiled(bad)


@pytest.mark.parametrize("page", ["<div>" * 20_000, "<b>" * 20_000 + "</p>" * 20_000, "<p>" * 20_000, "<ul><li>" * 10_000, "<a" * 10_000, "</div>" * 20_000, "<table><tr><td>" * 5_000, "<i>" * 10_000 + "<p>" * 10_000])
def test_deep_and_broken_pages(page):
    began = time.time()
    tree = xpath.Tree(page)
    for e in ("count(//*)", "//li[last()]", "string(/)", "count(//*[not(*)]/ancestor::*)", "count(//*//*)", "//div//p//b"):
        xpath.evaluate(xpath.compiled(e), tree)
    assert time.time() - began < 20


def test_rules_on_malformed_pages(spark):
    """A page that is no XML, null and empty pages, quotes and backslashes in expressions: no job fails."""
    rows = [(1, "<p>a<br>b<img src=x>"), (2, None), (3, ""), (4, "<a href='it\\'s'>q</a>"), (5, "<p>ok</p>")]
    rules = [("t", "//p"), ("q", "//a[@href=\"it\\\"]"), ("slash", "//p[.='\\']"), ("n", "count(//p) div 0"), ("step", "count(//p)/a"), ("src", "//img/@src")]
    out = H.custom_extract(spark.createDataFrame(rows, "page_id long, html string"), [{"name": n, "type": "xpath", "expression": e} for n, e in rules]).orderBy("page_id").collect()
    assert [(r.t, r.q, r.slash, r.step, r.src) for r in out] == [("ab", "", "", "", "x"), ("", "", "", "", ""), ("", "", "", "", ""), ("", "q", "", "", ""), ("ok", "", "", "", "")]
