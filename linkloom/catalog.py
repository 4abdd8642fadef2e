"""Named queries over the driver's tables: name → fn(spark, sf_dir) -> DataFrame.

Each entry reads the given tables (or stand-ins Spark derives from them) in
full; ``oracle.SQL`` holds the DuckDB twin of each entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.errors import error_label, page_error
from .functions.text import snippet
from .operators import pages as P
from .operators import results as R
from .sources.derived import results_v
from .session import spread
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def pages_table(spark, d):
    """The page store, spread over the cores when it has fewer splits (html
    work is CPU-heavy per row)."""
    return spread(table(spark, d, "pages"))


# ── pages → rows (P1-P5, P8, C1) ────────────────────────────────────────────

@query
def page_rows(spark, d):
    return P.page_rows(pages_table(spark, d))


@query
def page_text(spark, d):
    t = P.page_text_only(pages_table(spark, d))
    return t.select("page_id", F.substring("text", 1, 10_000).alias("text"),
                    F.length("text").cast("long").alias("full_len"))


@query
def page_title(spark, d):
    return P.page_rows(pages_table(spark, d)).select("page_id", "title")


@query
def page_links(spark, d):
    return P.page_links(pages_table(spark, d))


@query
def links_resolved(spark, d):
    return P.link_counts(pages_table(spark, d)).filter("links_count > 0")


@query
def doc_snippets(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", snippet("text", 500, True).alias("s500"), snippet("text", 200, True).alias("s200"),
        snippet("text", 120, True).alias("s120"),
        F.length(snippet("text", 10_000)).cast("long").alias("kept_len"))


# ── results (P6, P7, P9-P13, F4, F5, W1-W3, O1, O2, A1, A5, K1, K2, K4) ────

@query
def error_labels(spark, d):
    r = R.errors_only(results_v(spark, d))
    return r.select("seq", "error", error_label("error").alias("label"))


@query
def error_breakdown(spark, d):
    return R.error_breakdown(results_v(spark, d))


@query
def page_error_codes(spark, d):
    r = results_v(spark, d)
    msg = (F.when(F.col("seq") % 3 == 0, F.lit("")).when(F.col("seq") % 3 == 1, F.lit("net::ERR_FAILED"))
           .otherwise(F.lit("Timeout")))
    status = F.when(F.col("seq") % 2 == 0, (F.col("seq") % 600).cast("int")).otherwise(F.lit(0))
    err = page_error(F.col("error") == "", msg, status)
    return r.select("seq", err.alias("page_error"), error_label(err).alias("label"))


@query
def progress_lines(spark, d):
    return R.progress_lines(results_v(spark, d))


@query
def top_results_score(spark, d):
    t = R.top_results(results_v(spark, d), n=10, sort="score", columns=["url"])
    return t.select("rank", "seq", "url", "score", "depth")


@query
def top_results_depth(spark, d):
    t = R.top_results(results_v(spark, d), n=25, sort="depth", columns=["url"])
    return t.select("rank", "seq", "url", "score", "depth")


@query
def min_score_results(spark, d):
    t = R.top_results(results_v(spark, d), n=50, min_score_value=0.8, sort="score", columns=["url"])
    return t.select("rank", "seq", "url", "score", "depth")


@query
def top_results_per_job(spark, d):
    t = R.top_results(results_v(spark, d), n=3, sort="score", by="job_id", columns=["url"])
    return t.select("job_id", "rank", "seq", "url", "score")


@query
def dedupe_first(spark, d):
    return R.dedupe_first(results_v(spark, d), columns=["job_id", "score", "depth"]).select(
        "url", "seq", "job_id", "score", "depth")


@query
def pages_done(spark, d):
    return R.pages_done(results_v(spark, d)).select("job_id", "seq", "pages_done")


@query
def paginate_results(spark, d):
    rows = R.job_result_rows(results_v(spark, d))
    return R.paginate(rows, page=2, per_page=5).select(
        "job_id", "position", "seq", "url", "depth", "text_snippet", "links_count", "score", "total", "page", "per_page")


@query
def needs_summary_rows(spark, d):
    t = R.top_results(results_v(spark, d), n=20, sort="score", columns=["url", "summary", "text"])
    return R.needs_summary(t).select("rank", "seq", "url")


@query
def result_view(spark, d):
    return R.result_view(R.top_results(results_v(spark, d), n=10, sort="score",
                                       columns=["url", "links", "summary", "text"]))


@query
def results_jsonl_rows(spark, d):
    return R.jsonl_rows(results_v(spark, d))


@query
def export_csv_rows(spark, d):
    return R.csv_rows(results_v(spark, d))


@query
def export_md_rows(spark, d):
    return R.markdown_rows(results_v(spark, d))


@query
def crawl_summary(spark, d):
    return R.crawl_summary(results_v(spark, d))


@query
def job_stats(spark, d):
    from .operators.jobs import job_stats as js
    return js(results_v(spark, d))


# ── flagship: pages → rows → focus score → top 10 (minimum slice) ──────────

@query
def page_top_focus(spark, d):
    from .functions.urls import focus_score
    pages = pages_table(spark, d)
    # One top ten that carries the page: its html is parsed for the ten that are shown.
    from pyspark.sql import Window
    score = focus_score("url", F.array(F.lit("/en/")))
    top = pages.select("page_id", "url", "html").orderBy(score.desc(), "page_id").limit(10)
    rows = P.page_rows(top).withColumn("score", score)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("score"), "page_id")).cast("long").alias("rank"),
                       "page_id", "url", "title", "score", "links_count", F.substring("text", 1, 120).alias("snippet"))


# ── relevance (B1-B4) ───────────────────────────────────────────────────────

ORACLE_GOAL = "the of thand reheed thention"


@query
def page_blocks(spark, d):
    from .operators.relevance import block_rows
    return block_rows(pages_table(spark, d)).select("page_id", "pos", "text")


@query
def bm25_blocks(spark, d):
    from .operators.relevance import bm25_block_rows
    return bm25_block_rows(pages_table(spark, d), ORACLE_GOAL)


@query
def bm25_fit_text(spark, d):
    from .operators.relevance import bm25_filter
    return bm25_filter(pages_table(spark, d), ORACLE_GOAL).select("page_id", "fit_text", "text")


@query
def pruned_blocks(spark, d):
    from .functions.html import CLEANED_TAGS
    from .operators.relevance import prune_block_rows
    return prune_block_rows(pages_table(spark, d), excluded=CLEANED_TAGS)


@query
def pruned_text(spark, d):
    from .functions.html import CLEANED_TAGS
    from .operators.relevance import pruning_filter
    return pruning_filter(pages_table(spark, d), excluded=CLEANED_TAGS).select(
        "page_id", "fit_text", "text", "kept_blocks", "blocks")


@query
def content_none_text(spark, d):
    from .operators.relevance import content_text
    return content_text(pages_table(spark, d), "none").select("page_id", "text")


# ── crawl (J1-J8, J10, F3, F6, S2, T6) over the derived link graph ──────────

def _site_job(url):
    """The job of a url: one per site."""
    from .functions.urls import authority
    return F.concat(F.lit("job-"), authority(url))


def crawl_inputs(spark, d, prefer_external=False, focus=("/en/",), avoid=("/de/",)):
    """Seeds: every stored page, in the job of its site, in page order; plan
    per job: focus /en/, avoid /de/."""
    from .operators.ordinal import ordinal
    from .sources.derived import link_graph
    pages = table(spark, d, "pages")
    seeds = ordinal(pages.select(_site_job("url").alias("job_id"), "page_id", "url"), ["page_id"], by=["job_id"], name="n")
    seeds = seeds.select("job_id", (F.col("n") - 1).cast("int").alias("seed_pos"), "url")
    plans = seeds.select("job_id").distinct().select(
        "job_id", F.array(*[F.lit(x) for x in focus]).alias("focus_patterns"),
        F.array(*[F.lit(x) for x in avoid]).alias("avoid_patterns"), F.lit(prefer_external).alias("prefer_external"))
    return seeds, link_graph(spark, d), pages.select("url"), plans


def _crawl_rows(df):
    from .operators.crawl import path_text
    return df.select("job_id", "seed_pos", "url", "depth", path_text(F.col("path")).alias("path"), "ok", "error",
                     "score", "pages_done", "budget_hit", "status")


def _run_crawl(spark, d, prefer_external=False, **cfg):
    from .operators.crawl import CrawlConfig, crawl
    seeds, links, store, plans = crawl_inputs(spark, d, prefer_external)
    return _crawl_rows(crawl(seeds, links, store, plans, CrawlConfig(**cfg)))


@query
def crawl_bfs(spark, d):
    return _run_crawl(spark, d, max_depth=3)


@query
def crawl_external_first(spark, d):
    return _run_crawl(spark, d, prefer_external=True, max_depth=3)


@query
def crawl_dfs(spark, d):
    return _run_crawl(spark, d, strategy="dfs", max_depth=3)


@query
def crawl_internal_only(spark, d):
    return _run_crawl(spark, d, max_depth=3, include_external=False)


@query
def crawl_budget(spark, d):
    return _run_crawl(spark, d, max_depth=3, max_pages=20)


@query
def crawl_score_threshold(spark, d):
    return _run_crawl(spark, d, max_depth=3, max_pages=30, score_threshold=0.5)


@query
def crawl_bestfirst(spark, d):
    from .operators.crawl import CrawlConfig, crawl, path_text
    seeds, links, store, plans = crawl_inputs(spark, d)
    out = crawl(seeds, links, store, plans, CrawlConfig(strategy="bestfirst", max_depth=3, batch=10))
    return out.select("job_id", "seed_pos", "url", "depth", path_text(F.col("path")).alias("path"), "ok", "score",
                      "round", "pages_done")


@query
def crawl_jobs(spark, d):
    """One plan over jobs with settings of their own: breadth-first, two deep
    and within the site, beside depth-first with a threshold."""
    from .operators.crawl import crawl_jobs as cj
    from .operators.crawl import path_text
    seeds, links, store, plans = crawl_inputs(spark, d)
    first = F.length("job_id") % 2 == 0
    jobs = seeds.select("job_id").distinct().select(
        "job_id", F.when(first, "bfs").otherwise("dfs").alias("strategy"), F.when(first, 2).otherwise(3).alias("max_depth"),
        F.when(first, 30).otherwise(25).alias("max_pages"), F.when(first, 0.0).otherwise(0.5).alias("score_threshold"), (~first).alias("include_external"))
    out = cj(jobs, seeds, links, store, plans)
    return out.select("job_id", "strategy", "seed_pos", "url", "depth", path_text(F.col("path")).alias("path"), "ok", "error", "score", "pages_done",
                      "budget_hit", "status")


@query
def crawl_result_rows(spark, d):
    from .operators.crawl import CrawlConfig, crawl
    from .operators.crawl import crawl_result_rows as crr
    seeds, links, store, plans = crawl_inputs(spark, d)
    rows = crr(crawl(seeds, links, store, plans, CrawlConfig(max_depth=3, max_pages=20)), pages_table(spark, d), latest="page_id")
    return rows.select("job_id", "pages_done", "url", "depth", "score", "title", "text", "links_count", "error", "status_code")


@query
def default_avoid(spark, d):
    """F1 on every page's url with each word that a pattern looks for, in
    endings that it takes and endings that it narrowly doesn't."""
    from .functions.urls import avoided_by_default
    words = ("login logout signin signup register vote upvote downvote hide flag report user profile account "
             "from submit faq guidelines legal privacy terms").split()
    lits = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    pages = table(spark, d, "pages").select("page_id", "url")
    inside = (pages.withColumn("word", lits(words)).withColumn("tail", lits(["", "?a=1", "/x", "s", "_x", "-x", ".html"]))
              .select("page_id", F.concat(F.rtrim("url", F.lit("/")), F.lit("/"), "word", "tail").alias("url")))
    before = pages.withColumn("head", lits(["mailto:", "x-mailto:", "/mailto:"])).select("page_id", F.concat("head", "url").alias("url"))
    return inside.unionByName(before).withColumn("avoided", avoided_by_default("url"))


@query
def links_from_pages(spark, d):
    return P.links_from_pages(pages_table(spark, d))


@query
def page_events(spark, d):
    from .operators.crawl import CrawlConfig, crawl
    from .operators.crawl import page_events as pe
    seeds, links, store, plans = crawl_inputs(spark, d)
    return pe(crawl(seeds, links, store, plans, CrawlConfig(max_depth=3, max_pages=40, score_threshold=0.5)))


@query
def frontier_hop(spark, d):
    """J1 with every stored page as a depth-0 frontier of its own run."""
    from .operators.crawl import expand_frontier
    from .sources.derived import link_graph
    pages = table(spark, d, "pages")
    frontier = pages.select(F.lit("all").alias("job_id"), F.col("page_id").cast("int").alias("seed_pos"), "url",
                            F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    hop = expand_frontier(frontier, link_graph(spark, d), include_external=True)
    return hop.select("seed_pos", "url", "depth", F.col("path")[0].alias("pos"))


@query
def fetch_from_store(spark, d):
    """S2 over every link target of the graph."""
    from .operators.crawl import fetch
    from .sources.derived import link_graph
    pages = table(spark, d, "pages")
    urls = link_graph(spark, d).select("src_id", "pos", F.col("dst_url").alias("url"))
    got = fetch(urls, pages.select("url", "page_id"))
    return got.select("src_id", "pos", "url", F.col("page_id").alias("dst_page_id"), "error")


@query
def cache_misses(spark, d):
    """J8 (enabled): link targets not in the cache (the https pages of the store)."""
    from .operators.crawl import cached_fetch
    from .sources.derived import link_graph
    pages = table(spark, d, "pages")
    cache = pages.filter(F.col("url").startswith("https://")).select("url")
    urls = link_graph(spark, d).select("src_id", "pos", F.col("dst_url").alias("url"))
    hits, misses = cached_fetch(urls, cache, "enabled")
    return misses.select("src_id", "pos", "url")


@query
def fetch_schedule(spark, d):
    """J10 over every resolved page link (score: focus /en/)."""
    from .functions.urls import focus_score
    from .operators.crawl import fetch_schedule as fs
    links = P.page_links(pages_table(spark, d))
    urls = links.select(F.col("dst_url").alias("url"), "page_id", "pos", focus_score(F.col("dst_url"), F.array(F.lit("/en/"))).alias("score"))
    return fs(urls, 1.0, 3.0, [F.desc("score"), "page_id", "pos"]).select("url", "page_id", "pos", "host", "host_rank", "planned_s", "earliest_s", "latest_s")


@query
def seed_hosts(spark, d):
    """A6 over job requests: distinct seed authorities per job."""
    from .operators.crawl import resolve_seeds
    from .operators.crawl import seed_hosts as sh
    from .sources.derived import job_requests_v
    seeds = resolve_seeds(job_requests_v(spark, d))
    return sh(seeds).select("job_id", F.array_join("seed_hosts", ",").alias("hosts"))


# ── jobs (S3, F7, A2, A3, A7, P12, T3-T5 batch twins) ───────────────────────

def _jobs(spark, d):
    from .operators.jobs import read_job_requests
    from .sources.derived import job_requests_v
    return read_job_requests(job_requests_v(spark, d))


@query
def job_defaults(spark, d):
    accepted, _ = _jobs(spark, d)
    return accepted.select("job_id", "goal", F.array_join("seed_urls", ",").alias("seeds"), "max_depth", "max_pages",
                           "min_delay_seconds", "max_delay_seconds", "ai_provider", "strategy", "content_filter",
                           "bm25_threshold", "cache_mode", "stealth", "headless", "score_threshold", "include_external",
                           "status")


@query
def job_rejects(spark, d):
    _, rejected = _jobs(spark, d)
    return rejected


@query
def config_violations(spark, d):
    from .operators.jobs import config_violations as cv
    accepted, _ = _jobs(spark, d)
    return cv(accepted)


def _events(spark, d):
    from .sources.derived import crawl_events_v
    return crawl_events_v(spark, d)


@query
def job_status(spark, d):
    from .operators.jobs import job_status as js
    return js(_events(spark, d))


@query
def done_events(spark, d):
    from .operators.jobs import done_events as de
    return de(_events(spark, d))


@query
def running_stats(spark, d):
    from .operators.jobs import running_stats as rs
    return rs(_events(spark, d))


@query
def job_elapsed(spark, d):
    from .operators.jobs import job_elapsed as je
    return je(_events(spark, d))


@query
def job_list(spark, d):
    """A3: requests (job-<custkey>) with stats from results and status from
    events of user <custkey>."""
    from .operators.jobs import job_stats as js
    from .operators.jobs import job_status as st
    from .operators.jobs import list_jobs
    accepted, _ = _jobs(spark, d)
    key = F.concat(F.lit("job-"), F.col("job_id").cast("string"))
    stats = js(results_v(spark, d).withColumn("job_id", key))
    status = st(_events(spark, d).withColumn("job_id", key))
    return list_jobs(accepted, stats, status)


@query
def job_view(spark, d):
    """Every job's record with its results in chunks of ten."""
    from .operators.event_log import job_records
    from .operators.jobs import JOB_DEFAULTS
    from .operators.jobs import job_stats as js
    from .plans.plan import parse_plans, usable_plans
    from .sources.derived import plan_responses_v
    accepted, _ = _jobs(spark, d)
    key = F.concat(F.lit("job-"), F.col("job_id").cast("string"))
    results = results_v(spark, d).withColumn("job_id", key)
    plans = usable_plans(parse_plans(plan_responses_v(spark, d)))
    view = job_records(accepted, js(results), _events(spark, d).withColumn("job_id", key), R.job_result_rows(results), plans, size=10)
    shown = F.transform("results", lambda r: F.concat_ws(" ", r["position"], r["url"], r["depth"], F.format_string("%.1f", r["score"]), r["links_count"]))
    return view.select("job_id", "goal", F.array_join("seed_urls", ",").alias("seeds"), "status", "error", "created_at", "updated_at",
                       *[F.col(f"config.{k}").alias(k) for k, _, _ in JOB_DEFAULTS if k not in ("stealth", "headless")],
                       "stats.pages_crawled", "stats.pages_error", "stats.results_count", F.col("ai_plan.summary").alias("plan_summary"),
                       "chunk", F.size("results").cast("long").alias("n"), F.array_join(shown, "; ").alias("results"))


def _log_inputs(spark, d):
    """The budgeted crawl of every site, its jobs and their plans (a third of the sites have none that is usable)."""
    from .operators.crawl import CrawlConfig, crawl
    seeds, links, store, plans = crawl_inputs(spark, d)
    bad = F.length("job_id") % 3 == 0
    crawled = crawl(seeds, links, store, plans.filter(~bad), CrawlConfig(max_depth=2, max_pages=15))
    jobs = seeds.select("job_id").distinct()
    outcomes = jobs.select("job_id", F.when(bad, "plan_error").otherwise("ok").alias("outcome"),
                           F.when(~bad, F.concat(F.lit("Crawl of "), F.substring("job_id", 5, 200))).alias("summary"), F.when(bad, F.lit("'url'")).alias("error"))
    return jobs, crawled, outcomes


@query
def crawl_event_log(spark, d):
    """The whole event log of a crawl."""
    from .operators.event_log import crawl_event_log as log
    return log(*_log_inputs(spark, d)).drop("ts")


@query
def crawl_log_state(spark, d):
    """T3 to T5 read from that log."""
    from .operators.event_log import crawl_event_log as log
    from .operators.event_log import log_state
    return log_state(log(*_log_inputs(spark, d)))


@query
def settings_checked(spark, d):
    """F7 on raw text: every customer types one setting in the session of its nation."""
    from .operators.settings import settings_outcomes
    from .sources.derived import raw_settings_v
    return settings_outcomes(raw_settings_v(spark, d)).select("session_id", "seq", "key", "raw", "field", "message", "flag")


@query
def session_settings(spark, d):
    """The settings that hold at the end of each session."""
    from .operators.settings import session_config, settings_outcomes
    from .sources.derived import raw_settings_v
    return session_config(settings_outcomes(raw_settings_v(spark, d)))


# ── plans and model-call prompts (J6, L1-L5, L7, L8) ────────────────────────

@query
def plan_prompts(spark, d):
    from .plans.plan import plan_prompts as pp
    accepted, _ = _jobs(spark, d)
    return pp(accepted)


def _parsed(spark, d):
    from .plans.plan import parse_plans
    from .sources.derived import plan_responses_v
    return parse_plans(plan_responses_v(spark, d))


@query
def plans_parsed(spark, d):
    p = _parsed(spark, d)
    seeds = F.array_join(F.transform("prioritized_seeds", lambda s: F.concat_ws(
        "|", s["url"], F.format_string("%.4f", s["score"]), s["reason"])), ";")
    return p.select("job_id", "outcome", "summary", seeds.alias("seeds"),
                    F.array_join("avoid_patterns", ",").alias("avoid"), F.array_join("focus_patterns", ",").alias("focus"),
                    "prefer_external")


@query
def seeds_resolved(spark, d):
    from .operators.crawl import resolve_seeds
    from .plans.plan import usable_plans
    accepted, _ = _jobs(spark, d)
    return resolve_seeds(accepted, usable_plans(_parsed(spark, d)))


@query
def plan_view(spark, d):
    from .plans.plan import plan_view as pv
    from .plans.plan import usable_plans
    return pv(usable_plans(_parsed(spark, d)))


def stub_planner():
    """A stand-in for a model: its answer, or failure, follows from the prompt's goal."""
    import json

    def answer(prompt):
        goal = prompt.split("\n", 1)[0][6:]
        if goal == "MACHINERY":
            raise RuntimeError("provider down")
        if goal == "AUTOMOBILE":
            return "I can't plan this."
        if goal == "BUILDING":
            return json.dumps({"summary": "s", "prioritized_seeds": [{"score": 1}]})
        seeds = json.loads(prompt.split("\n")[1][len("Seed URLs: "):])
        return json.dumps({"summary": f"Plan for {goal}", "prioritized_seeds": [{"url": seeds[0], "score": 0.9, "reason": "given"}], "focus_patterns": [f"/{goal.lower()}/"],
                           "prefer_external": goal == "FURNITURE"})

    return lambda prompts: [answer(p) for p in prompts]


@query
def plan_flow(spark, d):
    """L8 as one flow (prompt, call, parse, view), with a stand-in for the model."""
    from .operators.requests import planned
    from .session import checkpoint_dir
    accepted, _ = _jobs(spark, d)
    import uuid
    out = planned(accepted, stub_planner, f"{checkpoint_dir(spark).rstrip('/')}/linkloom-answers-{uuid.uuid4().hex}")
    return out.select("job_id", "outcome", "error", "summary", F.array_join("focus_patterns", ",").alias("focus"), "prefer_external", "view")


@query
def extraction_prompts(spark, d):
    from .operators.inference import extraction_prompts as ep
    pages = pages_table(spark, d)
    return ep(pages, goal="find pricing pages", description="navigation links with their targets")


@query
def summary_prompts(spark, d):
    from .operators.inference import summary_prompts as sp
    from .operators.relevance import content_text
    rows = content_text(pages_table(spark, d), "none")
    return sp(rows, goal="find pricing pages")


@query
def extracted_parsed(spark, d):
    from .operators.extract import parse_extracted
    r = results_v(spark, d).filter(F.col("extracted_content") != "")
    return parse_extracted(r).select("seq", "is_json", "shown", F.col("k").alias("k"))


@query
def nav_records(spark, d):
    from .operators.extract import extract_records
    schema = {"name": "nav", "baseSelector": "li",
              "fields": [{"name": "text", "selector": "", "type": "text"},
                         {"name": "href", "selector": "a", "type": "attribute", "attribute": "href"}]}
    recs = extract_records(pages_table(spark, d), schema)
    return recs.select("page_id", "rec_no", F.col("record")["text"].alias("text"), F.col("record")["href"].alias("href"))


@query
def listing_records(spark, d):
    """L6 with a selector list, sibling and position steps and attribute tests."""
    from .operators.extract import extract_records
    schema = {"name": "listing", "baseSelector": "div.ad ~ article > h1, nav > ul > li:nth-child(odd), nav li + li:nth-child(2)", "fields": [
        {"name": "text", "selector": "", "type": "text"},
        {"name": "href", "selector": "a[href^='/']:first-child", "type": "attribute", "attribute": "href"},
        {"name": "with_e", "selector": "a[href*=\"e\"], h2", "type": "text"}]}
    r = F.col("record")
    return extract_records(pages_table(spark, d), schema).select("page_id", "rec_no", *[r[k].alias(k) for k in ("text", "href", "with_e")])


@query
def nested_exclusion(spark, d):
    """P1 on pages whose excluded elements are nested in their own kind, unclosed, or closed by what holds them."""
    from .functions.html import drop_elements, strip_tags
    from .sources.derived import tangled_pages_v
    return tangled_pages_v(spark, d).select("page_id", strip_tags(drop_elements("html")).alias("text"))


# ── URL filters and scorers on the link graph (F1, F2, F8, C2, C3) ─────────

def _graph_candidates(spark, d):
    """Every link target as a candidate of the job of its source's site."""
    from .sources.derived import link_graph
    g = link_graph(spark, d)
    return g.select(_site_job("src_url").alias("job_id"), "src_id", "pos", F.col("dst_url").alias("url"), "is_internal")


@query
def avoid_default(spark, d):
    from .functions.urls import avoided_by_default
    return _graph_candidates(spark, d).select("src_id", "pos", "url", avoided_by_default("url").alias("avoided"))


@query
def avoid_plan(spark, d):
    from .functions.urls import contains_any
    pats = F.array(F.lit("/de/"), F.lit("example.org/1"), F.lit("a.b"))
    return _graph_candidates(spark, d).select("src_id", "pos", "url", contains_any("url", pats).alias("avoided"))


@query
def filter_stats(spark, d):
    from .operators.crawl import filter_stats as fs
    from .operators.crawl import plan_columns
    seeds, _, _, plans = crawl_inputs(spark, d)
    return fs(_graph_candidates(spark, d), plan_columns(seeds, plans))


@query
def focus_scores(spark, d):
    from .functions.urls import focus_score
    return _graph_candidates(spark, d).select("src_id", "pos", "url",
                                              focus_score("url", F.array(F.lit("/en/"))).alias("score"))


@query
def external_first_scores(spark, d):
    from .operators.crawl import plan_columns, score_rows
    seeds, _, _, plans = crawl_inputs(spark, d, prefer_external=True)
    c = _graph_candidates(spark, d)
    return score_rows(c, seeds, plan_columns(seeds, plans)).select("src_id", "pos", "url", "score")


@query
def job_result_rows(spark, d):
    return R.job_result_rows(results_v(spark, d))


@query
def session_append(spark, d):
    """The results of a second session (the error rows of the stand-in,
    re-fetched) appended after the first."""
    from .operators.crawl import append_session
    r = results_v(spark, d).select("seq", "url", "error")
    again = r.filter(F.col("error") != "").select("seq", "url", F.lit("").alias("error"))
    return append_session(r, again)


# ── documents: BM25 over paragraphs (B2), offline summaries (L4) ───────────

@query
def doc_bm25(spark, d):
    from .operators.relevance import text_bm25
    return text_bm25(spread(table(spark, d, "documents")), ORACLE_GOAL)


@query
def doc_summaries(spark, d):
    from .operators.inference import extractive_summaries
    docs = spread(table(spark, d, "documents")).select("doc_id", "text")
    return extractive_summaries(docs, "find pricing pages for software plans", n=3).select("doc_id", "summary_text")


@query
def job_from_payloads(spark, d):
    """S3 through JSON request bodies: each request written as a JSON body,
    parsed back with the request schema, then defaulted (equals job_defaults)."""
    from .operators.jobs import read_job_requests, requests_from_json
    from .sources.derived import job_requests_v
    bodies = job_requests_v(spark, d).select(F.to_json(F.struct("*")).alias("body"))
    accepted, _ = read_job_requests(requests_from_json(bodies))
    return accepted.select("job_id", "goal", F.array_join("seed_urls", ",").alias("seeds"), "max_depth", "max_pages",
                           "min_delay_seconds", "max_delay_seconds", "ai_provider", "strategy", "content_filter",
                           "bm25_threshold", "cache_mode", "stealth", "headless", "score_threshold", "include_external",
                           "status")
