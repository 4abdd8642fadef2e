"""The request table, planning and scraping as one flow, raw settings, the crawl's event log and its runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom.operators.crawl import KEY, Frontier, KeyRuns, co_located
from linkloom.operators.event_log import crawl_event_log, job_records, log_state
from linkloom.operators.jobs import done_events, job_stats, read_job_requests
from linkloom.operators.requests import answered, planned, scraped, stored_answers
from linkloom.operators.settings import session_config, settings_outcomes
from linkloom.session import co_partitioned, cut_lineage


def counting(folder, fn):
    """A caller that notes every prompt it is asked, from whichever task."""
    def make():
        def call(prompts):
            for p in prompts:
                with open(os.path.join(folder, "asked"), "a") as f:
                    f.write(json.dumps(p) + "\n")
            return [fn(p) for p in prompts]
        return call
    return make


def asked(folder):
    path = os.path.join(folder, "asked")
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [json.loads(x) for x in f]


def test_equal_prompts_are_asked_once_and_answers_are_kept(spark, tmp):
    prompts = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)] + [(99, None)], "id int, prompt string").repartition(5)
    store = f"{tmp}/answers"
    got = answered(prompts, counting(tmp, str.upper), store).collect()
    assert sorted((r.id, r.response, r.error) for r in got if r.id != 99) == sorted((i, f"P{i % 3}", None) for i in range(30))
    assert sorted(asked(tmp)) == ["p0", "p1", "p2"]
    assert [(r.response, r.error) for r in got if r.id == 99] == [(None, "no prompt")]
    more = prompts.unionByName(spark.createDataFrame([(100, "p9")], prompts.schema)).filter("id <> 99")
    n = len(asked(tmp))
    again = answered(more, counting(tmp, str.lower), store).collect()
    assert asked(tmp)[n:] == ["p9"] and {r.response for r in again} == {"P0", "P1", "P2", "p9"}


def test_failures_are_outcomes_of_their_own_prompt(spark, tmp):
    def fn(p):
        if "bad" in p:
            raise RuntimeError(f"no {p}")
        return "ok"

    prompts = spark.createDataFrame([(0, "a"), (1, "bad1"), (2, "b"), (3, "bad2")], "id int, prompt string").coalesce(1)
    rows = {r.id: (r.response, r.error) for r in answered(prompts, counting(tmp, fn), f"{tmp}/s", tasks=1).collect()}
    assert rows == {0: ("ok", None), 1: (None, "no bad1"), 2: ("ok", None), 3: (None, "no bad2")}
    n = len(asked(tmp))
    answered(prompts, counting(tmp, fn), f"{tmp}/s").collect()
    assert len(asked(tmp)) == n  # a stored failure is an answer
    rows = {r.id: (r.response, r.error) for r in answered(prompts, counting(tmp, lambda p: "late"), f"{tmp}/s", retry_failed=True).collect()}
    assert sorted(asked(tmp)[n:]) == ["bad1", "bad2"] and rows[1] == ("late", None) and rows[0] == ("ok", None)
    assert stored_answers(spark, f"{tmp}/s").count() == 4 and stored_answers(spark, f"{tmp}/nowhere").count() == 0


def test_plan_flow_outcomes(spark, tmp):
    jobs = spark.createDataFrame([("a", "good", ["http://x/"], 2), ("b", "text", ["http://x/", "http://y/"], 2), ("c", "list", ["http://x/"], 2), ("d", "down", ["http://x/"], 2),
                                  ("e", "good", ["http://x/"], 2)], "job_id string, goal string, seed_urls array<string>, max_depth int")

    def fn(p):
        goal = p.split("\n")[0][6:]
        if goal == "down":
            raise RuntimeError("provider down")
        return {"good": '{"summary": "S", "focus_patterns": ["/f"]}', "text": "no plan", "list": "[1]"}[goal]

    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # else the failing prompt has its batch asked one by one
    got = {r.job_id: r for r in planned(jobs, counting(tmp, fn), f"{tmp}/s").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {j: (r.outcome, r.error) for j, r in got.items()} == {"a": ("ok", None), "b": ("fallback", None), "c": ("plan_error", "unusable plan"),
                                                                "d": ("plan_error", "provider down"), "e": ("ok", None)}
    assert got["a"].view == "Summary: S\nFocus: /f" and got["d"].view is None and len(got["b"].prioritized_seeds) == 2
    assert sum("Goal: good" in p for p in asked(tmp)) == 1  # a and e are the same request


def test_scraped_with_the_schema_of_each_page(spark, tmp):
    pages = spark.createDataFrame([(1, "http://a/", "<ul><li>x</li><li>y</li></ul>"), (2, "http://b/", "<h1>T</h1>"), (3, "http://c/", "<p>none</p>"), (4, "http://d/", "<p>q</p>")],
                                  "page_id long, url string, html string")
    li = {"baseSelector": "li", "fields": [{"name": "t", "selector": "", "type": "text"}]}

    def fn(p):
        if "http://c/" in p:
            raise RuntimeError("down")
        return json.dumps(li) if "http://a/" in p else json.dumps({"baseSelector": "h1:hover"}) if "http://b/" in p else "sorry"

    got = sorted(scraped(pages, counting(tmp, fn), f"{tmp}/s", "goal", "items").collect(), key=lambda r: (r.page_id, r.rec_no))
    assert [(r.page_id, r.rec_no, r.record and r.record["t"]) for r in got] == [(1, 0, "x"), (1, 1, "y"), (2, 0, None), (3, 0, None), (4, 0, None)]
    assert [r.error for r in got] == [None, None, "unknown selector 'h1:hover': :hover", "down", "the answer is no JSON"]


# ── F7 on raw text ──────────────────────────────────────────────────────────

def test_settings_are_checked_in_order(spark):
    rows = [("s", 1, "max-delay", "0.5", "max_delay must be >= min_delay"), ("s", 2, "min-delay", "0.2", ""), ("s", 3, "max-delay", "0.5", ""),
            ("s", 4, "min-delay", "2", "min_delay must be <= max_delay"), ("s", 5, "Max-Pages", " 1_000 ", ""), ("s", 6, "max-pages", "1.5", "Invalid value for 'max-pages': invalid literal for int() with base 10: '1.5'"),
            ("s", 7, "stealth", "YES", ""), ("s", 8, "headless", "maybe", "Invalid value for 'headless': expected true/false, got 'maybe'"),
            ("s", 9, "score-threshold", "it's", "Invalid value for 'score-threshold': could not convert string to float: \"it's\""), ("s", 10, "max-depth", "11", "max_depth must be between 0 and 10"),
            ("s", 11, "min-delay", "inf", "min_delay must be between 0 and 60"), ("s", 12, "cache", "off", "cache must be one of: enabled, bypass"), ("s", 13, "max-pages", "7", ""),
            ("s", 14, "bm25-threshold", "0", "bm25_threshold must be > 0"), ("s", 15, "score-threshold", "1e-1", ""), ("t", 1, "max-delay", "0.5", "max_delay must be >= min_delay")]
    got = settings_outcomes(spark.createDataFrame([r[:4] for r in rows], "session_id string, seq long, key string, raw string"))
    assert sorted((r.session_id, r.seq, r.message) for r in got.collect()) == sorted((r[0], r[1], r[4]) for r in rows)
    assert {(r.session_id, r.field): r.raw for r in session_config(got).collect()} == {
        ("s", "min_delay"): "0.2", ("s", "max_delay"): "0.5", ("s", "max_pages"): "7", ("s", "stealth"): "YES", ("s", "score_threshold"): "1e-1"}
    unknown = settings_outcomes(spark.createDataFrame([("s", 1, "color", "red"), ("s", 2, None, None)], "session_id string, seq long, key string, raw string")).collect()
    assert [r for r in unknown if r.seq == 1][0].message.startswith("Unknown key 'color'.  Valid keys: provider, max-pages")


# ── the event log ───────────────────────────────────────────────────────────

def test_event_log_in_one_order(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    crawled = spark.createDataFrame([("a", "u1", 0, 1, "cancelled", ""), ("a", "u2", 1, 4, "cancelled", "fetch_failed"), ("b", "u3", 0, 1, "completed", "")],
                                    "job_id string, url string, depth int, pages_done long, status string, error string")
    plans = spark.createDataFrame([("a", "ok", "S", None), ("b", "plan_error", None, "boom")], "job_id string, outcome string, summary string, error string")
    log = crawl_event_log(jobs, crawled, plans)
    rows = [(r.job_id, r.seq, r.event, r.status, r.url, r.pages_done) for r in log.orderBy("job_id", "seq").collect()]
    assert rows == [("a", 1, "status", "planning", None, None), ("a", 2, "plan", None, None, None), ("a", 3, "status", "running", None, None), ("a", 4, "page", None, "u1", 1),
                    ("a", 5, "page", None, "u2", 4), ("a", 6, "status", "cancelled", None, None), ("b", 1, "status", "planning", None, None), ("b", 2, "plan_error", None, None, None),
                    ("b", 3, "status", "running", None, None), ("b", 4, "page", None, "u3", 1), ("b", 5, "status", "completed", None, None), ("c", 1, "status", "planning", None, None),
                    ("c", 2, "status", "running", None, None), ("c", 3, "status", "completed", None, None)]
    assert {tuple(r) for r in log_state(log).collect()} == {("a", "cancelled", True, 1, 1), ("b", "completed", True, 1, 0), ("c", "completed", True, 0, 0)}
    assert {r.job_id for r in done_events(log).collect()} == {"a", "b", "c"}


def test_job_records_keep_arrays_small(spark):
    jobs, _ = read_job_requests(spark.createDataFrame([("a", ["http://x/"]), ("b", ["http://y/"])], "job_id string, seed_urls array<string>").selectExpr(
        "job_id", "'' as goal", "seed_urls", "cast(null as int) max_depth", "cast(null as int) max_pages", "cast(null as double) min_delay_seconds", "cast(null as double) max_delay_seconds",
        "cast(null as string) ai_provider", "cast(null as string) strategy", "cast(null as string) content_filter", "cast(null as double) bm25_threshold", "cast(null as string) cache_mode",
        "cast(null as boolean) stealth", "cast(null as boolean) headless", "cast(null as double) score_threshold", "cast(null as boolean) include_external"))
    results = spark.createDataFrame([("a", i, f"u{i}", "") for i in range(7)], "job_id string, seq long, url string, error string")
    events = spark.createDataFrame([("a", 1, 10, "status", "planning", None), ("a", 2, 20, "status", "error", "boom"), ("b", 1, 5, "status", "running", None)],
                                   "job_id string, seq long, t long, event string, status string, error string").withColumn("ts", F.timestamp_seconds("t"))
    got = job_records(jobs, job_stats(results), events, results.select("job_id", "seq", "url"), size=3).orderBy("job_id", "chunk").collect()
    assert [(r.job_id, r.chunk, [x.url for x in r.results], r.status, r.error) for r in got] == [
        ("a", 0, ["u0", "u1", "u2"], "error", "boom"), ("a", 1, ["u3", "u4", "u5"], "error", "boom"), ("a", 2, ["u6"], "error", "boom"), ("b", 0, [], "running", "")]
    assert got[0].created_at == 10 and got[0].updated_at == 20 and got[0].stats.results_count == 7


# ── runs of doubling length ─────────────────────────────────────────────────

def keyed(spark, level, n=5):
    return spark.range(level * n, level * n + n).select(F.lit("j").alias("job_id"), F.lit(0).alias("seed_pos"), F.concat(F.lit("u"), "id").alias("url"))


def test_ten_levels_are_joined_as_at_most_three_runs(spark):
    with co_partitioned(spark, 2):
        runs = KeyRuns(2)
        for level in range(10):
            runs.add(cut_lineage(co_located(keyed(spark, level), 2)))
            assert len(runs.runs) == bin(level + 1).count("1") <= 3
        probe = keyed(spark, 0, 60)
        left = runs.without(probe)
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftAnti") == 2  # ten levels: runs of eight and two
        assert sorted(r.url for r in left.collect()) == sorted(f"u{i}" for i in range(50, 60))


def test_frontier_runs_lose_what_was_emitted(spark):
    with co_partitioned(spark, 2):
        frontier = Frontier(2)
        for level in range(6):
            frontier.add(cut_lineage(co_located(keyed(spark, level), 2)), 5)
            frontier.emit(cut_lineage(co_located(keyed(spark, level, 5).filter("url like '%0' or url like '%5'"), 2)), 1)
        assert len(frontier.runs) <= 3 and frontier.rows == 24
        assert sorted(r.url for r in frontier.pending().select(*KEY).collect()) == sorted(f"u{i}" for i in range(30) if i % 5)


def test_seeds_grow_with_the_pages(spark):
    from linkloom.catalog import crawl_inputs
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        seeds = crawl_inputs(spark, d)[0]
        assert seeds.count() == spark.read.parquet(f"{d}/pages.parquet").count()


@pytest.mark.parametrize("setting", ["", "file:///tmp/linkloom-elsewhere"])
def test_checkpoint_dir_without_setting(setting, tmp):
    """In local mode without ``spark.checkpoint.dir`` a folder is made once and kept; a set one is used."""
    import subprocess
    import sys

    code = ("from linkloom.session import checkpoint_dir, cut_lineage\nfrom pyspark.sql import SparkSession\n"
            f"b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\nb = b.config('spark.checkpoint.dir', '{setting}') if '{setting}' else b\n"
            "s = b.getOrCreate()\na = checkpoint_dir(s)\nassert a == checkpoint_dir(s) and a\n"
            f"assert not '{setting}' or a == '{setting}'\nassert cut_lineage(s.range(3)).count() == 3\nprint('kept')")
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": tmp, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200)
    assert "kept" in out.stdout, out.stderr[-2000:]
