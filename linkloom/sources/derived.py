"""Stand-in tables derived from the driver's tables (FIXTURES §3).

The reference keeps results, events, jobs and links as in-memory Python
lists; here they are DataFrames computed from the given parquet tables, so
every query's work grows with the data. The same definitions are written as
SQL in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import authority
from .tables import table

# Fixed values of the stand-ins (FIXTURES §3).
SCORE_GRID = (0.0, 0.2, 0.4, 0.5, 0.8, 0.9, 1.0)
ERROR_CODES = ("403", "fetch_failed:404", "timeout:429", "unknown_error:500", "503 x", "Timeout", "net::ERR")
STRATEGIES = ("bfs", "dfs", "bestfirst", "random")
LINKS_PER_PAGE = 4
MISSING_HOST = "http://missing.example.org/"


def _pick(values, idx):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx % len(values)).cast("int") + 1)


def results_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl results stand-in from ``events`` (one row per event)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    is_err = F.col("event_type") == "error"
    return e.select(
        eid.alias("seq"),
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("http://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com/p/"),
                 (eid % 499).cast("string")).alias("url"),
        (eid % 4).cast("int").alias("depth"),
        _pick(SCORE_GRID, eid).alias("score"),
        F.when(is_err, _pick(ERROR_CODES, eid)).otherwise(F.lit("")).alias("error"),
        F.when(eid % 3 == 0, F.lit("s")).otherwise(F.lit("")).alias("summary"),
        F.coalesce(F.col("props"), F.lit("")).alias("text"),
        F.when(eid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Page "), (eid % 499).cast("string"))).alias("title"),
        F.array_repeat(F.concat(F.lit("http://x.example.net/"), (eid % 13).cast("string")),
                       (eid % 5).cast("int")).alias("links"),
        F.when(is_err, F.lit(0)).otherwise(F.lit(200)).alias("status_code"),
        F.when(eid % 11 == 0, F.col("props"))
         .when(eid % 11 == 1, F.concat(F.lit("raw: "), F.col("props")))
         .otherwise(F.lit("")).alias("extracted_content"),
        F.col("ts"),
    )


def crawl_events_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl event log stand-in from ``events``."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    event = F.when(et.isin("signup", "purchase"), F.lit("status")).otherwise(F.lit("page"))
    status = (F.when(et == "signup", F.lit("planning"))
              .when(et == "purchase", F.lit("completed")))
    return e.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        event.alias("event"),
        status.alias("status"),
        F.when(et == "error", F.lit("fetch_failed:404")).otherwise(F.lit("")).alias("error"),
        F.when(event == "page", F.concat(F.lit("http://h"), (F.col("user_id") % 7).cast("string"),
                                         F.lit(".example.com/p/"), (F.col("event_id") % 499).cast("string")))
         .alias("url"),
    )


def job_requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job request stand-in from ``customer`` (nullable config fields)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seed = F.concat(F.lit("https://"), F.lower(F.regexp_replace(F.col("c_name"), "#", "-")), F.lit(".example.com/"))
    return c.select(
        F.concat(F.lit("job-"), k.cast("string")).alias("job_id"),
        F.col("c_mktsegment").alias("goal"),
        F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(seed)).alias("seed_urls"),
        (k % 14).cast("int").alias("max_depth"),
        F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise(((k * 37) % 12000).cast("int")).alias("max_pages"),
        F.when(k % 6 == 0, F.lit(None).cast("double")).otherwise((F.col("c_acctbal") % 70) / 10).alias("min_delay_seconds"),
        F.when(k % 6 == 0, F.lit(None).cast("double")).otherwise((k % 50).cast("double")).alias("max_delay_seconds"),
        F.when(k % 9 == 0, F.lit("gemini")).when(k % 9 == 1, F.lit(None)).otherwise(F.lit("claude")).alias("ai_provider"),
        _pick(STRATEGIES, k).alias("strategy"),
        F.when(k % 5 == 0, F.lit("pruning")).when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, F.lit("none"))
         .otherwise(F.lit("bm25")).alias("content_filter"),
        F.when(k % 8 == 0, F.lit(0.0)).otherwise(F.lit(None).cast("double")).alias("bm25_threshold"),
        F.when(k % 3 == 0, F.lit("enabled")).otherwise(F.lit(None)).alias("cache_mode"),
        F.lit(None).cast("boolean").alias("stealth"),
        F.lit(None).cast("boolean").alias("headless"),
        F.when(k % 7 == 0, F.lit(1.5)).when(k % 7 == 1, F.lit(0.5)).otherwise(F.lit(None).cast("double")).alias("score_threshold"),
        F.when(k % 2 == 0, F.lit(False)).otherwise(F.lit(None).cast("boolean")).alias("include_external"),
        F.col("c_nationkey").alias("nation"),
    )


def page_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of stored pages (a parquet footer count)."""
    return table(spark, sf_dir, "pages").count()


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic out-links over ``pages`` (FIXTURES §3): four per page.

    k = (page_id*3 + j*j) % (N+5); dst is page k's url (or a missing host
    when k >= N); the 4th link gets '/login' appended when k % 5 = 0.
    One equi-join of the edge list with the page table.
    """
    n = page_count(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    edges = (pages.select(F.col("page_id").alias("src_id"), F.col("url").alias("src_url"),
                          F.explode(F.sequence(F.lit(1), F.lit(LINKS_PER_PAGE))).alias("j"))
             .withColumn("k", (F.col("src_id") * 3 + F.col("j") * F.col("j")) % (n + 5)))
    dst = pages.select(F.col("page_id").alias("k"), F.col("url").alias("k_url"))
    g = edges.join(dst, "k", "left")
    base = F.coalesce(F.col("k_url"), F.concat(F.lit(MISSING_HOST), F.col("k").cast("string")))
    dst_url = F.when((F.col("j") == LINKS_PER_PAGE) & (F.col("k") % 5 == 0), F.concat(base, F.lit("/login"))).otherwise(base)
    g = g.select("src_id", "src_url", dst_url.alias("dst_url"), (F.col("j") - 1).cast("int").alias("pos"))
    return g.withColumn("is_internal", authority("dst_url") == authority("src_url"))


def plan_responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-response stand-in from ``customer``: one raw response per job,
    cycling through the shapes the parser must tell apart (valid, not JSON,
    seed without url, numeric-string score, bad score, null score, JSON
    array, trailing text, truthy string flag, empty object)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ks = k.cast("string")
    seg = F.lower(F.col("c_mktsegment"))
    given = F.concat(F.lit("https://"), F.lower(F.regexp_replace(F.col("c_name"), "#", "-")), F.lit(".example.com/"))
    shape = (k + 5) % 10
    raw = (F.when(shape == 0, F.concat(
                F.lit('{"summary": "Plan for '), seg, F.lit('", "prioritized_seeds": [{"url": "https://c'), ks,
                F.lit('.example.com/", "score": 0.9, "reason": "main site"}, {"url": "https://d'), ks,
                F.lit('.example.org/", "score": 0.45}], "avoid_patterns": ["/cart", "/de/"], "focus_patterns": ["/pricing", "/'),
                seg, F.lit('"], "prefer_external": false}')))
           .when(shape == 1, F.concat(F.lit("Sorry, no plan for "), F.col("c_name")))
           .when(shape == 2, F.lit('{"summary": "s", "prioritized_seeds": [{"score": 0.5}]}'))
           .when(shape == 3, F.concat(F.lit('{"summary": "n'), ks, F.lit('", "prioritized_seeds": [{"url": "https://e'), ks,
                                      F.lit('.example.net/", "score": "0.7"}], "prefer_external": 1}')))
           .when(shape == 4, F.lit('{"summary": "x", "prioritized_seeds": [{"url": "https://x.example.com/", "score": "high"}]}'))
           .when(shape == 5, F.lit('{"prioritized_seeds": [{"url": "https://y.example.com/", "score": null}]}'))
           .when(shape == 6, F.lit('[{"url": "https://z.example.com/"}]'))
           .when(shape == 7, F.concat(F.lit('{"summary": "t'), ks, F.lit('"} trailing words')))
           .when(shape == 8, F.concat(F.lit('{"summary": "y", "focus_patterns": ["/'), F.col("c_nationkey").cast("string"),
                                      F.lit('/"], "prefer_external": "false"}')))
           .otherwise(F.lit("{}")))
    return c.select(F.concat(F.lit("job-"), ks).alias("job_id"), F.array(given).alias("seed_urls"), raw.alias("raw"))


# Keys and texts of the raw settings' stand-in.
RAW_KEYS = ("provider", "Max-Pages", "max-depth", "min-delay", "max-delay", "strategy", "filter", "bm25-threshold", "cache", "stealth", "headless",
            "score-threshold", "include-external", "color", "min-delay", "max-delay")
RAW_TEXTS = ("claude", "5", "0.5", "TRUE", "dfs", "none", "abc", "-1", " 12 ", "no", "2.5", "1_000", "it's", "enabled", "", "61", "1e1", "nan", "4")


def raw_settings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed settings stand-in from ``customer``: one (key, raw text) a row, a session for each nation."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("session_id"), k.cast("long").alias("seq"), _pick(RAW_KEYS, k * 7 + F.floor(k / 16)).alias("key"),
        _pick(RAW_TEXTS, k * 5 + F.floor(k / 19)).alias("raw"))


def tangled_pages_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand-in: the stored html with its excluded elements nested in their own kind (page_id % 4 = 1),
    never closed (2) or closed by the element around them (3)."""
    n, html = F.col("page_id") % 4, F.col("html")
    nested = F.replace(html, F.lit("<ul><li>"), F.lit("<nav>inner</nav><ul><li>"))
    unclosed = F.replace(html, F.lit("</footer>"), F.lit(""))
    around = F.replace(F.replace(html, F.lit("<article>"), F.lit("<article><section><aside>note <p>more</section><p>after ")), F.lit("</nav>"), F.lit("<nav></nav></nav>"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(n == 1, nested).when(n == 2, unclosed).when(n == 3, around).otherwise(html).alias("html"))
