"""L6's selector automaton and P1's subtree removal."""

import pytest

from linkloom.functions.html import EXCLUDED_TAGS, drop_elements, drop_flat, drop_subtrees
from linkloom.operators.extract import Automaton, Page, SelectorError, extract_from_html, extract_records

HTML = ('<ul><li class="a x">1</li><li>2<b>z</b></li><li id=k>3</li></ul><p>q</p><a href="http://x.com/en/a.pdf">f</a><p lang="en-US">r</p>'
        '<div title="say &quot;hi&quot; there"><em>e1</em>t<em>e2</em><i>i1</i><em>e3</em></div>')


def texts(selector, html=HTML):
    return [r["t"] for r in extract_from_html(html, {"baseSelector": selector, "fields": [{"name": "t", "selector": "", "type": "text"}]})]


@pytest.mark.parametrize("selector, expected", [
    ("li:first-child", ["1"]), ("li, p", ["1", "2 z", "3", "q", "r"]), ("p ,li", ["1", "2 z", "3", "q", "r"]), ("li + li", ["2 z", "3"]), ("li ~ li", ["2 z", "3"]),
    ("li+li+li", ["3"]), ("ul > li:nth-child(odd)", ["1", "3"]), ("li:nth-child(-n+2)", ["1", "2 z"]), ("li:nth-child(2n)", ["2 z"]), ("li:last-child", ["3"]),
    ("a[href^='http'][href$=\".pdf\"][href*=en]", ["f"]), ("a[href^='https']", []), ("p[lang|=en]", ["r"]), ("li[class~=x]", ["1"]), ("li[class='a x']", ["1"]),
    ("a[href^='']", []), ("ul + p", ["q"]), ("p ~ p", ["r"]), (".a.x, #k", ["1", "3"]), ("li b", ["2 z"[2:]]), ("p:first-of-type", ["q"]), ("p:nth-of-type(2n)", ["r"]),
    ("em:nth-of-type(2)", ["e2"]), ("em:nth-child(2)", ["e2"]), ("em:nth-child(4)", ["e3"]), ("i ~ em", ["e3"]), ("ul ~ a + p", ["r"]), ("*:only-child", ["z"]),
    ("[title*='\"hi\"']", ["e1 t e2 i1 e3"]), ("LI.a", ["1"]), ("> li", []), ("> ul > li:first-child", ["1"]), ("ul li, ul > li b, li", ["1", "2 z", "z", "3"])])
def test_selectors(selector, expected):
    assert texts(selector) == expected


@pytest.mark.parametrize("selector", ["li:hover", "a >", "a,,b", "a[href", "li:nth-child(x)", "li:nth-child", "a:not(b)", "a || b", "", "a,", "::before", "a!b", "a[x=y i]", "#a#b", "> > a"])
def test_unknown_selectors_are_refused(spark, selector):
    with pytest.raises(SelectorError):
        Automaton(selector)
    with pytest.raises(SelectorError):  # before any page is read
        extract_records(spark.createDataFrame([], "page_id long, html string"), {"baseSelector": selector, "fields": []})


def test_field_scope_and_nested_records():
    html = "<div><p>a</p><div><p>b</p><span><p>c</p></span></div></div>"
    schema = {"baseSelector": "div", "fields": [{"name": "p", "selector": "p", "type": "text"}, {"name": "kid", "selector": "> span p", "type": "text"},
                                               {"name": "html", "selector": "span", "type": "html"}, {"name": "none", "selector": "q", "type": "attribute", "attribute": "x"}]}
    assert extract_from_html(html, schema) == [{"p": "a", "kid": None, "html": "<p>c</p>", "none": None}, {"p": "b", "kid": "c", "html": "<p>c</p>", "none": None}]


def test_ten_thousand_levels():
    n = 10_000
    html = "<div>" * n + "<p>deep</p>" + "</div>" * n
    assert texts("div > p", html) == ["deep"] and texts("div div p:only-child", html) == ["deep"]
    assert len(extract_from_html("<div>" * n + "x", {"baseSelector": "div", "fields": []})) == n
    assert Page(html).inner_html(n - 1) == "<p>deep</p>"


def test_odd_pages():
    assert texts("p", None) == texts("p", "") == texts("p", "</p>no<") == []
    assert texts("p", "<p>a<p>b</p>c") == ["a b c", "b"]  # an end tag closes the nearest; the rest ends with the page
    assert texts("b", "<i><b>x</i>y</b>") == ["x"]
    assert texts("p", "<br><p>a<img>b</p>") == ["a b"]


# ── P1 ──────────────────────────────────────────────────────────────────────

CASES = [("<nav>a<nav>b</nav>c</nav>d", " d"), ("x<div><nav>a</div>b", "x<div> </div>b"), ("x<nav>a", "x "), ("a<NAV x=1>q<p>r</NAV >s", "a s"),
         ("<nav>a<header>b</nav>c</header>d", " c</header>d"), ("</nav>a<nav>b</nav>", "</nav>a "), ("<nav>1</nav>t<footer>2</footer>u", " t u"),
         ("<nav><br><p>z</nav>y<aside>u<aside>v", " y "), ("<section><aside>a<p>b</section><p>c</p>", "<section> </section><p>c</p>"),
         ("<aside><aside></aside><aside></aside>x</aside>y<aside>z</aside>", " y "), ("", ""), ("no tags < >", "no tags < >"), (None, None), ("<navy>k</navy>", "<navy>k</navy>")]


def test_subtrees_end_where_they_end(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, html string")
    got = df.select("i", drop_elements("html").alias("a"), drop_subtrees("html").alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [e for _, e in CASES] == [r.b for r in got]


def test_both_ways_agree_on_flat_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    flat, fold = drop_flat("html", EXCLUDED_TAGS), drop_subtrees("html")
    assert pages.filter(~flat.eqNullSafe(fold)).count() == 0
