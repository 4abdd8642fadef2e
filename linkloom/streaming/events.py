"""Crawl events as Structured Streaming.

The reference keeps events in a list and has each subscriber poll it with a
cursor every 0.5 s; here the event log is a file stream, the checkpoint's
offsets are the cursor, and status, stats and the terminal 'done' event are
stateful streaming aggregates keyed by job_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL
from ..operators.results import dedupe_first

POLL = "500 milliseconds"


def _trigger(writer, available_now: bool, interval: str = POLL):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def append_events(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stamp events with their arrival time (when they have none) and
    append them to the JSON event log."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.current_timestamp())
    w = events.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(w, available_now).start(path)


def follow(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool = False, interval: str = POLL) -> StreamingQuery:
    """Deliver each poll's new events (only those after the cursor) to
    ``on_batch``; the checkpoint offsets are the cursor."""
    w = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def job_status_stream(events: DataFrame) -> DataFrame:
    """T4: last status per job by (ts, seq); emit in 'update' mode."""
    st = events.filter(F.col("event") == "status")
    agg = st.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("_l"))
    return agg.select("job_id", F.col("_l.status").alias("status"), F.col("_l.ts").alias("updated_at"))


def running_stats_stream(events: DataFrame) -> DataFrame:
    """T5: page counters per job, incrementally ('update' mode)."""
    pages = events.filter(F.col("event") == "page")
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return pages.groupBy("job_id").agg(F.count_if(ok).alias("pages_crawled"), F.count_if(~ok).alias("pages_error"))


DONE_SCHEMA = "job_id string, event string, status string"
DONE_STATE = "status string, ts timestamp, seq long, done boolean"


def _done(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        status, ts, seq, done = state.get
    else:
        status, ts, seq, done = None, None, None, False
    for pdf in batches:
        st = pdf[pdf["event"] == "status"]
        if len(st):
            last = st.sort_values(["ts", "seq"]).iloc[-1]
            if ts is None or (last["ts"], last["seq"]) > (ts, seq):
                status, ts, seq = last["status"], last["ts"], int(last["seq"])
    if status in TERMINAL and not done:
        done = True
        state.update((status, ts, seq, done))
        yield pd.DataFrame({"job_id": [key[0]], "event": ["done"], "status": [status]})
    else:
        state.update((status, ts, seq, done))


def terminal_events(events: DataFrame) -> DataFrame:
    """One 'done' event per job once its latest status is terminal
    (state per job: last status and a done flag; append mode). Only status
    events reach the per-job function (a handful per job, however many page
    events a hot job has), and it reads its group in Arrow-sized chunks."""
    from ..session import ship_package

    ship_package(events.sparkSession)
    status = events.filter(F.col("event") == "status").select("job_id", "event", "status", "ts", "seq")
    return status.groupBy("job_id").applyInPandasWithState(
        _done, DONE_SCHEMA, DONE_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_dedupe(results: DataFrame, out_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the first non-error row per URL across micro-batches. Each
    batch writes only its own first (min-seq) row per URL (a partial
    aggregate, so the stored table holds at most one row per URL and batch),
    to a folder of its epoch: one that is run again replaces what it wrote.
    ``deduped(spark, out_path)`` takes the min-seq row per URL on read, so the
    answer does not depend on the order in which batches arrive.
    ``state.stream_first_rows`` keeps the least seq as state instead and
    stores corrections only."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        dedupe_first(batch).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")

    w = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()


def compact_deduped(spark, out_path: str, compacted_path: str) -> DataFrame:
    """The stored candidates of ``stream_dedupe`` reduced to the first row per
    URL, written to a new folder: run it between streams (or on a copy of a
    finished batch's files) so that candidates don't pile up, and let the next
    stream write there."""
    deduped(spark, out_path).write.mode("errorifexists").parquet(compacted_path)
    return spark.read.parquet(compacted_path)


def deduped(spark, out_path: str) -> DataFrame:
    """The T7 result: first row per URL over all stored candidates."""
    return dedupe_first(spark.read.option("basePath", out_path).parquet(out_path).drop("epoch"))


def stream_dedupe_watermarked(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T7, bounded-state form: duplicates within the watermark delay are
    dropped (first seen wins; state is bounded by the delay)."""
    ok = results.filter(F.col("error") == "")
    return ok.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def on_page(results: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str,
            available_now: bool = False) -> StreamingQuery:
    """Per-page callback sink (persist + count) as foreachBatch."""
    w = results.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()


def event_stream(events: DataFrame) -> DataFrame:
    """T2 + T3 as one stream: every event once, plus one 'done' event per job
    when its latest status is terminal (the reference's event stream, whose
    subscriber stops at 'done'). Append mode."""
    done = terminal_events(events)
    cols = events.columns
    done_rows = done.select(*[F.col(c) if c in ("job_id", "event", "status") else
                              F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols])
    return events.unionByName(done_rows)
