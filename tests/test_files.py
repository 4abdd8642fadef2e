"""Sources and sinks: results JSONL round trip, exports."""

import glob
import json
import os

import pytest

from linkloom.sinks.files import append_results, export, export_csv, export_json, export_markdown
from linkloom.sources.files import read_results

COLS = "seq long, job_id long, url string, depth int, text string, links array<string>, score double, error string, summary string, extracted_content string, title string, status_code int"


def results(spark):
    return spark.createDataFrame([
        (0, 1, "http://a/", 0, "x" * 499 + "\nrest", ["l1", "l2"], 0.5, "", "", '{"k": 1}', "A", 200),
        (1, 1, "http://b/", 1, "für \"q\"", [], 0.2, "fetch_failed:404", "", "", "", 0),
        (2, 1, "http://c/", 1, "text", ["l"], 1.0, "", "sum", "not json", "", 200)], COLS)


def test_read_results_tolerant(spark, tmp):
    p = os.path.join(tmp, "r.jsonl")
    with open(p, "w") as f:
        f.write('{"url": "http://a/", "depth": 1, "score": 0.5, "links_count": 3, "text_snippet": "t"}\n\n')
        f.write("{broken\n")
        f.write('{"url": "http://only/"}\n')
    got = read_results(spark, p).orderBy("seq").collect()
    assert [(r["seq"], r["url"], r["depth"], r["text"], r["links"], r["score"], r["error"]) for r in got] == [
        (0, "http://a/", 1, "t", [], 0.5, ""), (1, "http://only/", 0, "", [], 0.0, "")]
    assert read_results(spark, os.path.join(tmp, "missing.jsonl")).count() == 0


def test_append_and_reload(spark, tmp):
    p = os.path.join(tmp, "results")
    append_results(results(spark), p)
    append_results(results(spark).limit(1), p)
    back = read_results(spark, p).collect()
    assert len(back) == 4 and sum(r["error"] != "" for r in back) == 1
    assert any(r["text"] == "für \"q\"" for r in back)


def test_exports(spark, tmp):
    df = results(spark)
    export_csv(df, os.path.join(tmp, "o.csv"))
    lines = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(tmp, "o.csv", "part-*"))))
    assert lines.splitlines()[0] == "url,depth,score,links_count,title,summary,text_snippet"
    assert "x" * 499 + " " in lines and "fetch_failed" not in lines
    export_json(df, os.path.join(tmp, "o.json"))
    objs = [json.loads(line) for f in sorted(glob.glob(os.path.join(tmp, "o.json", "part-*"))) for line in open(f)]
    assert [o["url"] for o in objs] == ["http://a/", "http://c/"]
    assert objs[0]["extracted_content"] == {"k": 1} and objs[1]["extracted_content"] == "not json"
    export_markdown(df, os.path.join(tmp, "o.md"), goal="g")
    md = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.join(tmp, "o.md", "part-*"))))
    assert md.startswith("# Crawl Results\n\n**Goal:** g\n\n**Total pages:** 2\n\n---\n\n## 1. A\n\n- **URL:** http://a/\n- **Score:** 0.50")
    assert "## 2. http://c/" in md and "\nsum\n" in md
    with pytest.raises(Exception):
        export_csv(df, os.path.join(tmp, "o.csv"))
    assert export(df, os.path.join(tmp, "o.csv"), overwrite=True) == "csv"
    with pytest.raises(ValueError):
        export(df.filter("error <> ''"), os.path.join(tmp, "none.csv"))
