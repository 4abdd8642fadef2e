"""CSS-schema extraction and the summarize seam."""

from linkloom.operators.extract import extract_from_html, extract_records, parse_extracted
from linkloom.operators.inference import extractive_summaries, summarize

HTML = """<div class="item" id="i1"><h2>One</h2><a href="/1" class="go">Go &amp; see</a><span>x</span></div>
<div class="item"><h2>Two</h2><p><a href="/2">Two link</a></p></div><div class="other"><h2>No</h2></div>"""


def test_selectors():
    schema = {"baseSelector": "div.item", "fields": [
        {"name": "title", "selector": "h2", "type": "text"},
        {"name": "href", "selector": "a", "type": "attribute", "attribute": "href"},
        {"name": "direct", "selector": "> a", "type": "text"},
        {"name": "inner", "selector": "p", "type": "html"}]}
    recs = extract_from_html(HTML, schema)
    assert [r["title"] for r in recs] == ["One", "Two"]
    assert [r["href"] for r in recs] == ["/1", "/2"]
    assert recs[0]["direct"] == "Go & see" and recs[1]["direct"] is None
    assert recs[1]["inner"] == '<a href="/2">Two link</a>'
    assert len(extract_from_html(HTML, {"baseSelector": "#i1", "fields": []})) == 1
    assert len(extract_from_html(HTML, {"baseSelector": "div[class=other] h2", "fields": []})) == 1


def test_extract_records_rows(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<ul><li>a</li></ul>")], "page_id long, html string")
    got = extract_records(pages, {"baseSelector": "li, div.item".split(",")[0], "fields": [
        {"name": "t", "selector": "", "type": "text"}]}).collect()
    assert [(r["page_id"], r["rec_no"], r["record"]["t"]) for r in got] == [(2, 0, "a")]


def test_parse_extracted(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("raw text " + "y" * 3000,), ('{"k": 1} tail',)], "extracted_content string")
    got = parse_extracted(df).collect()
    assert [r["is_json"] for r in got] == [True, False, False]
    assert got[0]["k"] == 3 and len(got[1]["shown"]) == 2000


def test_summarize_errors_become_empty(spark):
    rows = spark.createDataFrame([("u1", "text one", ""), ("u2", "", ""), ("u3", "t3", "kept")], "url string, text string, summary string")

    def make_ok():
        return lambda goals, urls, texts: [f" {u}: {t[:4]} " for u, t in zip(urls, texts)]

    def make_bad():
        def fn(goals, urls, texts):
            raise RuntimeError("provider down")
        return fn

    ok = {r["url"]: (r["summary"], r["had_summary"]) for r in summarize(rows, make_ok, "g").collect()}
    assert ok == {"u1": ("u1: text", False), "u2": ("", True), "u3": ("kept", True)}
    bad = {r["url"]: r["summary"] for r in summarize(rows, make_bad, "g").collect()}
    assert bad == {"u1": "", "u2": "", "u3": "kept"}


def test_extractive_summary(spark):
    rows = spark.createDataFrame([("Cats sleep. Pricing pages list plans. Dogs bark. Our pricing is simple and pricing is fair.",)], "text string")
    s = extractive_summaries(rows, "pricing plans", n=2).first()["summary_text"]
    assert s == "Pricing pages list plans. Our pricing is simple and pricing is fair."
