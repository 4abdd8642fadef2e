"""Plan parsing: the three outcomes, against Python's own json semantics."""

import json

from pyspark.sql import functions as F

from linkloom.plans.plan import parse_plans, plan_prompts, plan_view

GIVEN = ["https://g.example.com/"]
CASES = {
    "valid": '{"summary": "S", "prioritized_seeds": [{"url": "https://a/", "score": 0.9, "reason": "r"}, {"url": "https://b/"}], "avoid_patterns": ["/cart"], "focus_patterns": ["/p"], "prefer_external": true}',
    "not_json": "I cannot do that",
    "no_url": '{"prioritized_seeds": [{"score": 0.5}]}',
    "num_string": '{"prioritized_seeds": [{"url": "https://a/", "score": "0.7"}]}',
    "bad_string": '{"prioritized_seeds": [{"url": "https://a/", "score": "high"}]}',
    "null_score": '{"prioritized_seeds": [{"url": "https://a/", "score": null}]}',
    "array": '[{"url": "https://a/"}]',
    "trailing": '{"summary": "t"} and more',
    "pe_one": '{"prefer_external": 1}',
    "pe_false_string": '{"prefer_external": "false"}',
    "pe_absent": '{"summary": "x"}',
    "pe_zero": '{"prefer_external": 0}',
    "pe_empty_list": '{"prefer_external": []}',
}


def python_plan(raw):
    """The reference's parse, restated with the standard library."""
    try:
        data = json.loads(raw)
    except json.JSONDecodeError:
        return ("fallback", "AI plan unavailable", [(u, 0.5, "") for u in GIVEN], [], [], False)
    try:
        seeds = [(s["url"], float(s.get("score", 0.5)), s.get("reason", "")) for s in data.get("prioritized_seeds", [])]
        return ("ok", data.get("summary", ""), seeds, data.get("avoid_patterns", []), data.get("focus_patterns", []),
                bool(data.get("prefer_external", False)))
    except Exception:
        return ("plan_error", None, None, None, None, None)


def test_three_outcomes(spark):
    df = spark.createDataFrame([(k, GIVEN, v) for k, v in CASES.items()], "job_id string, seed_urls array<string>, raw string")
    got = {r["job_id"]: r for r in parse_plans(df).collect()}
    for k, raw in CASES.items():
        exp = python_plan(raw)
        r = got[k]
        seeds = None if r["prioritized_seeds"] is None else [(s["url"], s["score"], s["reason"]) for s in r["prioritized_seeds"]]
        assert (r["outcome"], r["summary"], seeds, r["avoid_patterns"], r["focus_patterns"], r["prefer_external"]) == exp, k


def test_prompt_and_view(spark):
    jobs = spark.createDataFrame([("j", "find saas", ["https://a/", "https://b/"], 2)],
                                 "job_id string, goal string, seed_urls array<string>, max_depth int")
    p = plan_prompts(jobs).first()["prompt"]
    assert p == 'Goal: find saas\nSeed URLs: ["https://a/", "https://b/"]\nMax depth: 2\n\nProduce the crawl plan JSON.'
    df = spark.createDataFrame([("j", GIVEN, CASES["valid"])], "job_id string, seed_urls array<string>, raw string")
    v = plan_view(parse_plans(df)).first()["view"]
    assert v == ("Summary: S\nFocus: /p\nAvoid: /cart\nMode: external-first (aggregator site)\nSeeds:\n"
                 "  0.9  https://a/  r\n  0.5  https://b/")


def test_job_requests_from_json(spark):
    from linkloom.operators.jobs import read_job_requests, requests_from_json
    bodies = spark.createDataFrame([
        ('{"job_id": "a", "goal": "g", "seed_urls": ["https://x/"], "max_depth": 5, "extra": 1}',),
        ('{"job_id": "b", "seed_urls": []}',), ("not json",), ('{"job_id": "c", "seed_urls": ["https://y/"]}',)], "body string")
    acc, rej = read_job_requests(requests_from_json(bodies))
    got = {r["job_id"]: (r["goal"], r["max_depth"], r["max_pages"], r["strategy"], r["include_external"], r["status"])
           for r in acc.collect()}
    assert got == {"a": ("g", 5, 500, "bfs", True, "pending"), "c": ("", 3, 500, "bfs", True, "pending")}
    assert sorted((r["job_id"] or "", r["error"]) for r in rej.collect()) == [("", "seed_urls required"),
                                                                             ("b", "seed_urls required")]


def test_seed_list_json_like_python(spark):
    from pyspark.sql import functions as F

    from linkloom.plans.plan import json_string_list
    vals = [["https://a.example.com/für", "plain"], ["中文"], ["emoji😀x", 'q"u\\t\tz'], []]
    df = spark.createDataFrame([(v,) for v in vals], "s array<string>")
    assert [r[0] for r in df.select(json_string_list(F.col("s"))).collect()] == [json.dumps(v) for v in vals]


def test_strict_json_agrees_with_the_standard_parser(spark):
    import json as std

    from linkloom.functions.json import json_value

    texts = ['{"summary":"x"} Confidence: 9', '{"k":1}\n{"k":2}', '{"k":1} {"k":2}', '{"k":1}]', '{"k":1} note 5', '"a} bc"', '{"k": [1, 2]}', ' {"k": null} ',
             "", " ", "null", "12", "1, 2", '1}, {"v": 2', "[1]", "[1],", "]", '{"a": "}"}', '{"a": 1', "true false", '"x" "y"', "{} x", "[] []"]

    def standard(t):
        try:
            std.loads(t)
            return True
        except ValueError:
            return False

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_value(F.col("t")).isNotNull().alias("ok")).collect()
    assert {texts[r.i]: r.ok for r in got} == {t: standard(t) for t in texts}
