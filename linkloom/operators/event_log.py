"""A crawl's own event log (T1, T6): every event of a job in one order.

A job's events are: status planning, then its plan (``plan`` with the summary,
or ``plan_error`` with the message), status running, a ``page`` event for each
emitted row, and the final status. ``seq`` numbers them from 1 without a gap,
so the log can be read by T3 to T5 like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import TERMINAL, epoch_seconds, job_status
from .ordinal import ordinal

#: Places of the events around the pages; a page's place is between them.
PLANNING, PLAN, RUNNING, PAGES, FINAL = range(1, 6)
COLUMNS = ("job_id", "seq", "event", "status", "summary", "error", "url", "depth", "pages_done", "ts")


def _event(df: DataFrame, place: int, event, status=None, summary=None, error=None, page: bool = False) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x if isinstance(x, Column) else F.lit(x)
    own = lambda c, t: F.col(c).cast(t) if page else F.lit(None).cast(t)
    return df.select("job_id", F.lit(place).alias("_place"), F.coalesce(own("pages_done", "long"), F.lit(0)).alias("_nth"), text(event).alias("event"),
                     text(status).alias("status"), text(summary).alias("summary"), text(error).alias("error"), own("url", "string").alias("url"),
                     own("depth", "int").alias("depth"), own("pages_done", "long").alias("pages_done"))


def crawl_event_log(jobs: DataFrame, crawled: DataFrame, plans: DataFrame | None = None, started: str | None = None) -> DataFrame:
    """The events of every job of ``jobs`` (job_id; ``started``: a timestamp column, if there is one).

    ``crawled``: the emitted rows of ``crawl`` (job_id, url, depth, pages_done,
    status, error). ``plans``: job_id, outcome, summary and, if there is one,
    error; a job without a plan row has no plan event. A job that emitted
    nothing is completed. ``ts`` is the job's start for all its events (no
    clock ran), null without ``started``: ``seq`` is the order.
    """
    own = jobs.select("job_id").distinct()
    parts = [_event(own, PLANNING, "status", "planning"), _event(own, RUNNING, "status", "running")]
    if plans is not None:
        bad = F.col("outcome") == "plan_error"
        message = F.coalesce(F.col("error"), F.lit("unusable plan")) if "error" in plans.columns else F.lit("unusable plan")
        known = plans.join(own, "job_id", "left_semi")
        parts.append(_event(known, PLAN, F.when(bad, "plan_error").otherwise("plan"), summary=F.when(~bad, F.col("summary")), error=F.when(bad, message)))
    parts.append(_event(crawled, PAGES, "page", error=F.col("error"), page=True))
    ended = crawled.groupBy("job_id").agg(F.max("status").alias("_end"))  # one status a job
    parts.append(_event(own.join(ended, "job_id", "left"), FINAL, "status", F.coalesce("_end", F.lit("completed"))))
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    log = ordinal(log, ["_place", "_nth"], by=["job_id"], name="seq")
    if started is None:
        return log.withColumn("ts", F.lit(None).cast("timestamp")).select(*COLUMNS)
    times = jobs.groupBy("job_id").agg(F.min(started).alias("ts"))
    return log.join(times, "job_id", "left").select(*COLUMNS)


def job_times(events: DataFrame) -> DataFrame:
    """Per job: created_at (first event), updated_at (last status), both in epoch seconds, status, and the
    error of the last status when that is 'error' (else '')."""
    first = events.groupBy("job_id").agg(epoch_seconds(F.min("ts")).alias("created_at"))
    last = events.filter(F.col("event") == "status").groupBy("job_id").agg(
        F.max_by(F.struct("status", "error"), F.struct("ts", "seq")).alias("_l"))
    error = F.when(F.col("_l.status") == "error", F.coalesce(F.col("_l.error"), F.lit(""))).otherwise(F.lit(""))
    return first.join(last, "job_id", "left").join(job_status(events).select("job_id", "updated_at"), "job_id", "left").select(
        "job_id", "created_at", "updated_at", F.col("_l.status").alias("last_status"), F.coalesce(error, F.lit("")).alias("error"))


def result_chunks(results: DataFrame, size: int = 100, by: str = "job_id", order: str = "seq") -> DataFrame:
    """P12's results: (job_id, chunk, results) with at most ``size`` rows in an
    array, chunks numbered from 0 in result order. No array grows with its job."""
    if size < 1:
        raise ValueError("size must be >= 1")
    fields = [c for c in results.columns if c not in (by, order)]
    numbered = ordinal(results, [order], by=[by], name="_pos")
    rows = numbered.select(by, F.floor((F.col("_pos") - 1) / size).cast("long").alias("chunk"), F.struct(F.col("_pos").alias("position"), *fields).alias("_row"))
    return rows.groupBy(by, "chunk").agg(F.array_sort(F.collect_list("_row")).alias("results"))


def job_records(jobs: DataFrame, stats: DataFrame, events: DataFrame, results: DataFrame, plans: DataFrame | None = None, size: int = 100) -> DataFrame:
    """P12 whole: one row for each chunk of a job's results (chunk 0 with an
    empty array for a job without any), each with the job's record: config,
    status, stats, plan, error, created_at, updated_at."""
    from .jobs import job_view

    view = job_view(jobs, stats, plans).withColumnRenamed("status", "_asked").join(job_times(events), "job_id", "left")
    view = view.withColumn("status", F.coalesce("last_status", "_asked")).withColumn("error", F.coalesce("error", F.lit(""))).drop("_asked", "last_status")
    chunks = result_chunks(results, size)
    empty = F.array().cast(chunks.schema["results"].dataType)
    return view.join(chunks, "job_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long"))).withColumn("results", F.coalesce("results", empty))


def log_state(log: DataFrame) -> DataFrame:
    """What T3 to T5 read from a log: per job its status, whether it is over, and its page counts."""
    from .jobs import running_stats

    status = job_status(log).select("job_id", "status", F.col("status").isin(*TERMINAL).alias("done"))
    zero = F.lit(0).cast("long")
    return status.join(running_stats(log), "job_id", "left").select(
        "job_id", "status", "done", F.coalesce("pages_crawled", zero).alias("pages_crawled"), F.coalesce("pages_error", zero).alias("pages_error"))
