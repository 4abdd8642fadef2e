"""Streams equal their batch twins (availableNow over split files)."""

import json
import os

from pyspark.sql import functions as F

from linkloom.operators.jobs import done_events, job_status, running_stats
from linkloom.schemas import CRAWL_EVENTS
from linkloom.sources.files import read_events
from linkloom.streaming.events import (deduped, follow, job_status_stream, on_page, running_stats_stream,
                                       stream_dedupe, terminal_events)


def write_events(tmp, spark, sf):
    from linkloom.sources.derived import crawl_events_v
    ev = crawl_events_v(spark, sf).withColumn("job_id", F.col("job_id").cast("string"))
    ev = ev.select(*[F.col(f.name) if f.name in ev.columns else F.lit(None).cast(f.dataType).alias(f.name)
                     for f in CRAWL_EVENTS.fields])
    src = os.path.join(tmp, "events")
    # three files, the later ones first in name order: arrival order is not file order
    for i, cond in enumerate(["seq % 3 = 2", "seq % 3 = 1", "seq % 3 = 0"]):
        ev.filter(cond).coalesce(1).write.json(os.path.join(src, f"part{i}"))
    return ev, src


def run_to_memory(df, name, mode, tmp):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", os.path.join(tmp, "ck_" + name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_stream_equals_batch(spark, tmp, sf):
    ev, src = write_events(tmp, spark, sf)
    stream = spark.readStream.schema(CRAWL_EVENTS).json(os.path.join(src, "*"))
    run_to_memory(job_status_stream(stream), "st", "update", tmp)
    got = {r["job_id"]: r["status"] for r in spark.table("st").collect()}
    exp = {r["job_id"]: r["status"] for r in job_status(ev).collect()}
    assert got == exp
    run_to_memory(running_stats_stream(stream), "rs", "update", tmp)
    latest = spark.table("rs").groupBy("job_id").agg(F.max("pages_crawled").alias("c"), F.max("pages_error").alias("e"))
    assert {tuple(r) for r in latest.collect()} == {tuple(r) for r in running_stats(ev).collect()}
    run_to_memory(terminal_events(stream), "done", "append", tmp)
    assert sorted(tuple(r) for r in spark.table("done").collect()) == sorted(tuple(r) for r in done_events(ev).collect())


def test_follow_and_on_page(spark, tmp, sf):
    ev, src = write_events(tmp, spark, sf)
    stream = read_events(spark, os.path.join(src, "*"), stream=True)
    seen = []
    q = follow(stream, lambda b, i: seen.append(b.count()), os.path.join(tmp, "ck_f"), available_now=True)
    q.awaitTermination()
    assert sum(seen) == ev.count()
    counts = []
    q = on_page(stream.filter("event = 'page'"), lambda b, i: counts.append(b.filter("error = ''").count()),
                os.path.join(tmp, "ck_p"), available_now=True)
    q.awaitTermination()
    assert sum(counts) == ev.filter("event = 'page' and error = ''").count()


def test_stream_dedupe(spark, tmp):
    rows = [{"seq": i, "url": f"u{i % 4}", "error": "x" if i == 0 else "", "score": 0.5} for i in range(12)]
    src = os.path.join(tmp, "res")
    os.makedirs(src)
    for part in range(3):
        with open(os.path.join(src, f"p{part}.json"), "w") as f:
            for r in rows[part * 4:(part + 1) * 4]:
                f.write(json.dumps(r) + "\n")
    stream = spark.readStream.schema("seq long, url string, error string, score double").option("maxFilesPerTrigger", 1).json(src)
    out = os.path.join(tmp, "dedup")
    stream_dedupe(stream, out, os.path.join(tmp, "ck_d"), available_now=True).awaitTermination()
    got = sorted((r["url"], r["seq"]) for r in deduped(spark, out).collect())
    assert got == [("u0", 4), ("u1", 1), ("u2", 2), ("u3", 3)]


def test_append_events_log(spark, tmp, sf):
    """Events appended to the JSON log read back (S4) as they went in."""
    from linkloom.streaming.events import append_events
    ev, src = write_events(tmp, spark, sf)
    stream = spark.readStream.schema(CRAWL_EVENTS).json(os.path.join(src, "*"))
    log = os.path.join(tmp, "log")
    append_events(stream, log, os.path.join(tmp, "ck_log"), available_now=True).awaitTermination()
    back = read_events(spark, log)
    cols = ["job_id", "seq", "event", "status", "error", "url"]
    assert sorted(tuple(r) for r in back.select(*cols).collect()) == sorted(tuple(r) for r in ev.select(*cols).collect())
    stamped = spark.readStream.schema(CRAWL_EVENTS).json(os.path.join(src, "*")).drop("ts")
    log2 = os.path.join(tmp, "log2")
    append_events(stamped, log2, os.path.join(tmp, "ck_log2"), available_now=True).awaitTermination()
    assert read_events(spark, log2).filter("ts is null").count() == 0


def test_event_stream_appends_done(spark, tmp, sf):
    from linkloom.streaming.events import event_stream
    ev, src = write_events(tmp, spark, sf)
    stream = spark.readStream.schema(CRAWL_EVENTS).json(os.path.join(src, "*"))
    run_to_memory(event_stream(stream), "es", "append", tmp)
    out = spark.table("es")
    assert out.filter("event <> 'done'").count() == ev.count()
    got = sorted((r["job_id"], r["status"]) for r in out.filter("event = 'done'").collect())
    assert got == sorted((r["job_id"], r["status"]) for r in done_events(ev).collect())
