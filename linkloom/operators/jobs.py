"""Job tables: request defaults, config rules, stats, listing, status
(S3, F7, A2, A3, A7, P12, and batch twins of T3-T5).

A job request is a row with a nullable field per config key; NULL means
"not given" and takes the default. Events are rows (job_id, seq, ts, event,
status, error, url); status is decided by the last status event in
(ts, seq) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# REST job defaults (key, default, Spark type).
JOB_DEFAULTS = (
    ("max_depth", 3, "int"),
    ("max_pages", 500, "int"),
    ("min_delay_seconds", 1.0, "double"),
    ("max_delay_seconds", 3.0, "double"),
    ("ai_provider", "claude", "string"),
    ("strategy", "bfs", "string"),
    ("content_filter", "bm25", "string"),
    ("bm25_threshold", 1.2, "double"),
    ("cache_mode", "bypass", "string"),
    ("stealth", False, "boolean"),
    ("headless", True, "boolean"),
    ("score_threshold", 0.0, "double"),
    ("include_external", True, "boolean"),
)
SEEDS_REQUIRED = "seed_urls required"
TERMINAL = ("completed", "cancelled", "error")

# Allowed choices and messages of the config rules.
VALID_PROVIDERS = ("claude", "gemini")
VALID_STRATEGIES = ("bfs", "bestfirst", "dfs")
VALID_FILTERS = ("bm25", "pruning", "none")
VALID_CACHE = ("enabled", "bypass")
BOOL_TRUE = ("true", "1", "yes")
BOOL_FALSE = ("false", "0", "no")


def read_job_requests(requests: DataFrame, new_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted jobs with defaults applied and status 'pending',
    rejected requests with error 'seed_urls required'). ``new_ids`` gives
    every request a fresh uuid (the reference's behaviour); by default a
    supplied ``job_id`` is kept, for reproducible runs."""
    seeds = F.coalesce(F.col("seed_urls"), F.array().cast("array<string>"))
    cfg = [F.coalesce(F.col(k), F.lit(v).cast(t)).alias(k) for k, v, t in JOB_DEFAULTS]
    if new_ids or "job_id" not in requests.columns:
        from ..session import cut_lineage

        # uuid() is not reproducible: materialise so a recomputed partition
        # after an executor loss cannot give a job a second id
        requests = cut_lineage(requests.withColumn("job_id", F.expr("uuid()")))
    jobs = requests.select("job_id", F.coalesce(F.col("goal"), F.lit("")).alias("goal"), seeds.alias("seed_urls"), *cfg)
    has_seeds = F.size("seed_urls") > 0
    accepted = jobs.filter(has_seeds).withColumn("status", F.lit("pending"))
    rejected = jobs.filter(~has_seeds).select("job_id", F.lit(SEEDS_REQUIRED).alias("error"))
    return accepted, rejected


REQUEST_SCHEMA = ("job_id string, goal string, seed_urls array<string>, "
                  + ", ".join(f"{k} {t}" for k, _, t in JOB_DEFAULTS))


def requests_from_json(bodies: DataFrame, col: str = "body") -> DataFrame:
    """S3 input from raw JSON request bodies: one typed request row per body
    (unknown keys ignored; an unparsable body is a request without seeds and
    is rejected by ``read_job_requests``)."""
    parsed = F.from_json(F.col(col), REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    return bodies.select(parsed.alias("_r")).select("_r.*")


def job_config(jobs: DataFrame) -> Column:
    """The 13 config values as one struct column."""
    return F.struct(*[F.col(k) for k, _, _ in JOB_DEFAULTS])


def parse_bool(raw: Column) -> Column:
    """'true'/'1'/'yes' → true, 'false'/'0'/'no' → false, else NULL (invalid)."""
    low = F.lower(raw)
    return F.when(low.isin(*BOOL_TRUE), F.lit(True)).when(low.isin(*BOOL_FALSE), F.lit(False))


def config_rules(provider="ai_provider", strategy="strategy", content_filter="content_filter",
                 cache="cache_mode", max_depth="max_depth", max_pages="max_pages",
                 min_delay="min_delay_seconds", max_delay="max_delay_seconds",
                 bm25_threshold="bm25_threshold", score_threshold="score_threshold") -> list[tuple[str, Column]]:
    """F7 rules as (field, message-or-NULL) pairs; the first failing rule of a
    field is its message. Column names are parameters."""
    c = F.col

    def one_of(col, name, valid):
        return F.when(~c(col).isin(*valid), F.lit(f"{name} must be one of: {', '.join(valid)}"))

    return [
        ("provider", one_of(provider, "provider", VALID_PROVIDERS)),
        ("strategy", one_of(strategy, "strategy", VALID_STRATEGIES)),
        ("filter", one_of(content_filter, "filter", VALID_FILTERS)),
        ("cache", one_of(cache, "cache", VALID_CACHE)),
        ("max_depth", F.when((c(max_depth) < 0) | (c(max_depth) > 10), F.lit("max_depth must be between 0 and 10"))),
        ("max_pages", F.when((c(max_pages) < 1) | (c(max_pages) > 10000), F.lit("max_pages must be between 1 and 10000"))),
        ("min_delay", F.when((c(min_delay) < 0) | (c(min_delay) > 60), F.lit("min_delay must be between 0 and 60"))
            .when(c(min_delay) > c(max_delay), F.lit("min_delay must be <= max_delay"))),
        ("max_delay", F.when((c(max_delay) < 0) | (c(max_delay) > 60), F.lit("max_delay must be between 0 and 60"))
            .when(c(max_delay) < c(min_delay), F.lit("max_delay must be >= min_delay"))),
        ("bm25_threshold", F.when(c(bm25_threshold) <= 0, F.lit("bm25_threshold must be > 0"))),
        ("score_threshold", F.when((c(score_threshold) < 0.0) | (c(score_threshold) > 1.0),
                                   F.lit("score_threshold must be between 0.0 and 1.0"))),
    ]


def config_violations(jobs: DataFrame, **names) -> DataFrame:
    """one row per (job, field) whose value breaks a rule, with the message."""
    rules = config_rules(**names)
    arr = F.array(*[F.struct(F.lit(f).alias("field"), m.alias("message")) for f, m in rules])
    broken = F.filter(arr, lambda r: r["message"].isNotNull())
    return jobs.select("job_id", F.explode(broken).alias("r")).select("job_id", "r.field", "r.message")


def job_stats(results: DataFrame, by: str = "job_id") -> DataFrame:
    """A2: per job pages_crawled (ok), pages_error, results_count (ok rows kept)."""
    ok = F.col("error") == ""
    return results.groupBy(by).agg(
        F.count_if(ok).alias("pages_crawled"), F.count_if(~ok).alias("pages_error"),
        F.count_if(ok).alias("results_count"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ (wall clock as UTC);
    independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")).cast("double") / 1e6


def job_status(events: DataFrame) -> DataFrame:
    """T4 (batch twin): last status per job by (ts, seq); updated_at = its time."""
    st = events.filter(F.col("event") == "status")
    last = st.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("_l"))
    return last.select("job_id", F.col("_l.status").alias("status"), epoch_seconds(F.col("_l.ts")).alias("updated_at"))


def done_events(events: DataFrame) -> DataFrame:
    """T3 (batch twin): one 'done' event per job whose last status is terminal."""
    s = job_status(events)
    return s.filter(F.col("status").isin(*TERMINAL)).select("job_id", F.lit("done").alias("event"), "status")


def running_stats(events: DataFrame) -> DataFrame:
    """T5 (batch twin): page events per job, ok and with error."""
    pages = events.filter(F.col("event") == "page")
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return pages.groupBy("job_id").agg(F.count_if(ok).alias("pages_crawled"), F.count_if(~ok).alias("pages_error"))


def job_elapsed(events: DataFrame) -> DataFrame:
    """Seconds from a job's first to its last event."""
    return events.groupBy("job_id").agg(
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).cast("double") / 1e6).alias("elapsed_s"))


def list_jobs(jobs: DataFrame, stats: DataFrame, status: DataFrame) -> DataFrame:
    """A3: every job with its stats (0 when none yet) and current status
    (the request's 'pending' until a status event arrives)."""
    j = jobs.join(stats, "job_id", "left").join(status.withColumnRenamed("status", "_st"), "job_id", "left")
    return j.select(
        "job_id", "goal", F.coalesce(F.col("_st"), F.col("status")).alias("status"),
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("pages_crawled", "pages_error", "results_count")],
        "updated_at")


def job_view(jobs: DataFrame, stats: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Nested job record (config struct, stats struct, plan struct).
    Result rows are served by ``results.paginate``, never gathered into one
    array per job."""
    j = jobs.join(stats, "job_id", "left")
    cols = ["job_id", "goal", "seed_urls", job_config(j).alias("config"), "status",
            F.struct(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
                       for c in ("pages_crawled", "pages_error", "results_count")]).alias("stats")]
    if plans is not None:
        j = j.join(plans.select("job_id", F.struct("summary", "prioritized_seeds", "avoid_patterns", "focus_patterns",
                                                   "prefer_external").alias("ai_plan")), "job_id", "left")
        cols.append("ai_plan")
    return j.select(*cols)
