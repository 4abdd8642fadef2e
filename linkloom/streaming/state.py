"""Streaming state that ends (T3, T7), with ``transformWithState``.

``terminal_events_ending``: a job's state is its latest status; once the job
is over its 'done' event is sent and only a mark is kept, for as long as late
events may still come (``keep``). ``first_rows``: the first row of a URL, and
a correction when an earlier one arrives; a URL that was silent for ``keep``
is forgotten. ``stream_first_rows`` writes each epoch to a folder of its own,
so an epoch that is run again replaces what it wrote.

The query's session needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import TERMINAL
from ..operators.results import dedupe_first

# The process in which Spark asks a processor for its state's schema doesn't get the session's
# Python files: the processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With this on, a query with processing time runs empty batches for as long as it lives, so 'available now' never ends.
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
DONE_SCHEMA = "job_id string, event string, status string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_available_now(writer, path: str | None = None) -> StreamingQuery:
    """Start ``writer`` (a DataStreamWriter) for what is there now. State that
    is due to end goes with the next batch that has rows."""
    spark = SparkSession.getActiveSession()
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")  # a query keeps the settings it was started with
    try:
        return writer.trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


class _Terminal(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # ttl 0: a running job is never forgotten.
        self.latest = handle.getValueState("latest", "status string, at long, seq long")
        self.over = handle.getValueState("over", "status string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            return
        held = self.latest.get() if self.latest.exists() else None
        for pdf in rows:
            best = pdf.sort_values(["at", "seq"]).iloc[-1]
            if held is None or (int(best["at"]), int(best["seq"])) > (held[1], held[2]):
                held = (best["status"], int(best["at"]), int(best["seq"]))
        if held is None:
            return
        if held[0] in TERMINAL:
            self.latest.clear()
            self.over.update((held[0],))
            yield pd.DataFrame({"job_id": [key[0]], "event": ["done"], "status": [held[0]]})
        else:
            self.latest.update(held)

    def close(self) -> None:
        pass


def terminal_events_ending(events: DataFrame, keep: float = 3600.0) -> DataFrame:
    """One 'done' event per job when its latest status, by (ts, seq), is
    terminal. ``keep``: seconds (of processing time) for which a finished job
    is remembered, so that late events don't send it again; after that it has
    no state. Only status events reach the state; null times come first."""
    status = events.filter((F.col("event") == "status") & F.col("job_id").isNotNull()).select(
        "job_id", "status", F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("at"), F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"))
    return status.groupBy("job_id").transformWithStateInPandas(_Terminal(max(1, int(keep * 1000))), DONE_SCHEMA, "Append", "ProcessingTime")


class _First(StatefulProcessor):
    def __init__(self, keep_ms: int, columns: list[str]):
        self.keep_ms, self.columns = keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "seq long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.least.get()[0] if self.least.exists() else None
        best = None
        for pdf in rows:
            row = pdf.loc[[pdf["seq"].idxmin()]]
            if best is None or row["seq"].iloc[0] < best["seq"].iloc[0]:
                best = row
        if best is None or (before is not None and int(best["seq"].iloc[0]) >= before):
            return
        self.least.update((int(best["seq"].iloc[0]),))
        out = best[self.columns].copy()
        out["replaces"] = pd.Series([before], index=out.index, dtype="Int64")
        yield out

    def close(self) -> None:
        pass


def first_rows(results: DataFrame, keep: float = 86_400.0) -> DataFrame:
    """For each URL the row of least ``seq`` that is no error, and a
    correction (``replaces``: the seq it takes the place of) when an earlier
    one arrives later. State is one number a URL, dropped ``keep`` seconds (of
    processing time) after the last change. Rows without url or seq take no part."""
    ok = results.filter((F.coalesce(F.col("error"), F.lit("")) == "") & F.col("url").isNotNull() & F.col("seq").isNotNull())
    ok = ok.withColumn("seq", F.col("seq").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ok.schema) + ", replaces long"
    return ok.groupBy("url").transformWithStateInPandas(_First(max(1, int(keep * 1000)), ok.columns), schema, "Update", "ProcessingTime")


def stream_first_rows(results: DataFrame, out_path: str, checkpoint: str, keep: float = 86_400.0, available_now: bool = False) -> StreamingQuery:
    """``first_rows`` written as Parquet, a folder for each epoch: one that is
    run again after a failure replaces its folder and adds nothing."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")

    w = first_rows(results, keep).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return start_available_now(w) if available_now else w.trigger(processingTime="500 milliseconds").start()


def first_rows_table(spark: SparkSession, out_path: str) -> DataFrame:
    """What ``stream_first_rows`` wrote, with the corrections made: one row per URL."""
    return dedupe_first(spark.read.option("basePath", out_path).parquet(out_path)).drop("epoch", "replaces")
