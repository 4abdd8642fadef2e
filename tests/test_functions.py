"""Golden rows for the column functions (FIXTURES §1)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions.errors import error_label, page_error
from linkloom.functions.fmt import format_fixed
from linkloom.functions.html import clean_html, page_text, strip_tags, title_of
from linkloom.functions.text import snippet
from linkloom.functions.urls import (authority, avoided_by_default, contains_any, external_first_score, focus_score,
                                     in_hosts, resolve, url_score)


def one(spark, expr, *values, schema):
    return [r[0] for r in spark.createDataFrame([tuple(v) if isinstance(v, tuple) else (v,) for v in values], schema)
            .select(expr).collect()]


def test_page_error_and_labels(spark):
    df = spark.createDataFrame([(False, "", 404), (True, "x", 500), (False, "boom", 0)], "ok boolean, m string, s int")
    assert [r[0] for r in df.select(page_error("ok", "m", "s")).collect()] == ["unknown_error:404", "", "boom"]
    errs = ["unknown_error:404", "fetch_failed:404", "Timeout", "net::ERR", "403 timeout", "fetch_failed", "TIMEOUT:500"]
    got = one(spark, error_label("e"), *errs, schema="e string")
    assert got == ["not found", "not found", "timed out", "net::ERR", "forbidden", "connection failed", "server error"]


def test_scores(spark):
    df = spark.createDataFrame([
        ("http://seed.example.com/x", ), ("http://seed.example.com/en/x", ), ("http://other.example.org/x", ),
        ("http://other.example.org/en/x", )], "u string")
    hosts = F.array(F.lit("seed.example.com"))
    focus = F.array(F.lit("/en/"))
    assert [r[0] for r in df.select(external_first_score("u", in_hosts("u", hosts), focus)).collect()] == [0.2, 0.5, 0.9, 1.0]
    assert [r[0] for r in df.select(focus_score("u", focus)).collect()] == [0.4, 0.8, 0.4, 0.8]
    none = F.array().cast("array<string>")
    assert [r[0] for r in df.select(url_score("u", F.lit(False), in_hosts("u", hosts), none)).collect()] == [0.0] * 4


def test_default_avoid(spark):
    bad = ["http://h/login", "http://h/logout?x", "http://h/signin", "http://h/signup", "http://h/register",
           "http://h/vote?id=1", "http://h/upvote", "http://h/downvote", "http://h/hide?id", "http://h/flag/1",
           "http://h/report", "http://h/user?id=2", "http://h/profile/3", "http://h/account/", "http://h/from?site=x",
           "http://h/submit", "http://h/faq", "http://h/guidelines", "http://h/legal", "http://h/privacy",
           "http://h/terms", "mailto:x@y"]
    ok = ["http://h/login_now", "http://h/user", "http://h/a", "http://h/x/mailto:y", "http://h/Login"]
    got = one(spark, avoided_by_default("u"), *bad, *ok, schema="u string")
    assert got == [True] * len(bad) + [False] * len(ok)


def test_plan_avoid_is_literal(spark):
    df = spark.createDataFrame([("http://h/axb",), ("http://h/a.b",)], "u string")
    assert [r[0] for r in df.select(contains_any("u", F.array(F.lit("a.b")))).collect()] == [False, True]
    assert [r[0] for r in df.select(contains_any("u", F.array().cast("array<string>"))).collect()] == [False, False]


def test_authority_and_resolve(spark):
    got = one(spark, authority("u"), "HTTP://User@Host.Example.com:8080/p", "/rel", "mailto:x", schema="u string")
    assert got == ["user@host.example.com:8080", "", ""]
    df = spark.createDataFrame([(h, "https://a.example.com/en/5?x=1") for h in
                                ["/x", "//b.example.org/y", "http://c/z", "#top", "mailto:m", "rel.html"]], "h string, b string")
    assert [r[0] for r in df.select(resolve("h", "b")).collect()] == [
        "https://a.example.com/x", "https://b.example.org/y", "http://c/z", "#top", "mailto:m",
        "https://a.example.com/en/rel.html"]


def test_snippet_cut_then_replace(spark):
    text = "a" * 499 + "\n" + "b\nc"
    got = one(spark, snippet("t", 500, True), text, schema="t string")[0]
    assert got == "a" * 499 + " " and len(got) == 500


def test_page_text_chain(spark):
    df = spark.createDataFrame([("", "  raw   text ", "<p>h</p>"), ("fit  kept", "raw", "h"), ("", "", "<b>x</b>  y"),
                                ("", "", "")], "fit string, raw string, html string")
    assert [r[0] for r in df.select(page_text("fit", "raw", "html")).collect()] == ["raw text", "fit  kept", "x y", ""]
    long = spark.createDataFrame([("x" * 10_050,)], "h string")
    assert len(long.select(page_text(html="h")).first()[0]) == 10_000


def test_html_cleaning(spark):
    html = ("<html><head><title> A  title </title><script>var t=\"</p>\";</script></head><body><nav><a href='/n'>N</a></nav>"
            "<!-- c --><p>Hello <b>world</b></p><header>H</header><footer>F</footer></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(strip_tags(clean_html("html")).alias("t"), title_of("html").alias("title")).first()
    assert r["t"] == "Hello world" and r["title"] == "A title"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False), min_size=1, max_size=200))
def test_format_fixed_matches_python(spark, xs):
    xs = xs + [0.125, 2.675, 1.005, 0.375, 0.45, -0.001, -0.0, 5e-324, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(format_fixed("x", 2).alias("a"), format_fixed("x", 1).alias("b")).collect()
    for x, r in zip(xs, got):
        assert r["a"] == f"{x:.2f}" and r["b"] == f"{x:.1f}", (x, r)
    assert not math.isnan(xs[0]) or True


def test_page_meta_defaults(spark):
    from linkloom.operators.pages import page_meta
    df = spark.createDataFrame([("M", "R", 2, 404, -0.5, "x"), ("", "R", None, None, None, None), (None, "", 1, 0, 0.3, "")],
                               "meta_title string, result_title string, depth int, status_code int, score double, extracted_content string")
    got = [(r["title"], r["depth"], r["status_code"], r["score"], r["extracted_content"]) for r in page_meta(df).collect()]
    assert got == [("M", 2, 404, 0.5, "x"), ("R", 0, 0, 0.0, ""), ("", 1, 0, 0.3, "")]
