"""State that ends (T3, T7) and the replayable event source."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from linkloom.operators.jobs import done_events
from linkloom.operators.results import dedupe_first
from linkloom.schemas import CRAWL_EVENTS
from linkloom.sources.event_log import event_log
from linkloom.streaming.state import ROCKSDB, first_rows_table, start_available_now, stream_first_rows, terminal_events_ending, use_rocksdb

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    old = spark.conf.get(PROVIDER)
    use_rocksdb(spark)
    assert spark.conf.get(PROVIDER) == ROCKSDB
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(PROVIDER, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    time.sleep(0.01)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def status(job, seq, what, **more):
    return {"job_id": job, "seq": seq, "ts": f"2026-01-01T00:00:{seq:02d}Z", "event": "status", "status": what, **more}


def drain(query):
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def run_terminal(spark, tmp, keep):
    events = spark.readStream.schema(CRAWL_EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp}/log")
    return drain(start_available_now(terminal_events_ending(events, keep=keep).writeStream.format("parquet").option("checkpointLocation", f"{tmp}/ck"), f"{tmp}/out"))


def test_terminal_events_equal_the_batch_and_end_their_state(spark, tmp):
    log = f"{tmp}/log"
    put(log, "a.json", [status(f"j{i}", 1, "planning") for i in range(20)] + [{"job_id": "j0", "seq": 9, "event": "page"}])
    put(log, "b.json", [status(f"j{i}", 3, "completed") for i in range(15)] + [status("j19", 2, "running"), status("late", 5, "running")])
    put(log, "c.json", [status("late", 2, "completed")])  # an older end
    run_terminal(spark, tmp, 0.5)
    time.sleep(1.0)  # beyond keep: finished jobs are forgotten with the next batch
    put(log, "d.json", [status("j19", 4, "error")])
    rows = run_terminal(spark, tmp, 0.5)
    # Left: the running j15 to j18 and late, and j19's mark.
    assert rows[-1] <= 6
    out = spark.read.parquet(f"{tmp}/out")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, done_events(spark.read.schema(CRAWL_EVENTS).json(log)).collect()))


def test_an_end_is_sent_once_while_it_is_remembered(spark, tmp):
    put(f"{tmp}/log", "a.json", [status("j", 1, "completed"), status("k", 1, "running")])
    run_terminal(spark, tmp, 600)
    put(f"{tmp}/log", "b.json", [status("j", 2, "cancelled")])
    assert run_terminal(spark, tmp, 600)[-1] == 2
    assert [tuple(r) for r in spark.read.parquet(f"{tmp}/out").collect()] == [("j", "done", "completed")]


def test_first_rows_with_corrections_and_replayed_epochs(spark, tmp):
    src, out, schema = f"{tmp}/res", f"{tmp}/first", "seq long, url string, error string, job_id string, score double, depth int"
    rows = [{"seq": (i * 7) % 24, "url": f"u{i % 5}", "error": "x" if i == 3 else "", "job_id": "j", "score": 0.5, "depth": 1} for i in range(24)]
    for n in range(4):
        put(src, f"p{n}.json", rows[n * 6:(n + 1) * 6])
    put(src, "q.json", [{"seq": 1, "url": None, "error": ""}, {"seq": None, "url": "u0", "error": ""}])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    states = drain(stream_first_rows(stream, out, f"{tmp}/ck", available_now=True))
    assert states[-1] == 5  # one number for each URL
    expected = {r.url: r.seq for r in dedupe_first(spark.read.schema(schema).json(src).filter("url is not null and seq is not null")).collect()}
    table = lambda: {r.url: r.seq for r in first_rows_table(spark, out).collect()}
    assert table() == expected
    stored = spark.read.option("basePath", out).parquet(out)
    assert stored.filter("replaces is not null").count() > 0 and stored.filter("replaces <= seq").count() == 0
    # The last epoch that wrote rows runs again: its commit is taken back, its offsets stay.
    n = stored.count()
    commits = f"{tmp}/ck/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    os.rename(f"{commits}/{last}", f"{tmp}/taken-back")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.rename(f"{commits}/.{last}.crc", f"{tmp}/taken-back.crc")
    drain(stream_first_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src), out, f"{tmp}/ck", available_now=True))
    assert spark.read.option("basePath", out).parquet(out).count() == n and table() == expected


def test_first_rows_forgets_silent_urls(spark, tmp):
    src, schema = f"{tmp}/res", "seq long, url string, error string"
    put(src, "a.json", [{"seq": i, "url": f"u{i}", "error": ""} for i in range(30)])

    def run_to(out):
        return drain(stream_first_rows(spark.readStream.schema(schema).json(src), out, f"{tmp}/ck2", keep=1.0, available_now=True))

    assert run_to(f"{tmp}/o")[-1] == 30
    time.sleep(1.5)
    put(src, "b.json", [{"seq": 50, "url": "u50", "error": ""}])
    assert run_to(f"{tmp}/o")[-1] == 1


# ── the event source ────────────────────────────────────────────────────────

def collect(spark, stream, tmp, name):
    got = []
    q = (stream.writeStream.foreachBatch(lambda b, i: got.extend((r.job_id, r.seq, r.log_file, r.log_line) for r in b.collect()))
         .option("checkpointLocation", f"{tmp}/ck-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    return got


def test_subscribers_at_their_own_places(spark, tmp):
    log = f"{tmp}/log"
    put(log, "a.json", [status(f"j{i}", i, "planning") for i in range(5)])
    put(log, "b.json", [status(f"j{i}", i, "running") for i in range(5, 9)])
    first = collect(spark, event_log(spark, log), tmp, "one")
    assert [x[1] for x in sorted(first, key=lambda x: x[2:])] == list(range(9))
    # A second one starts in the middle of the first file.
    second = collect(spark, event_log(spark, log, start="a.json:3"), tmp, "two")
    assert sorted(x[1] for x in second) == [3, 4, 5, 6, 7, 8]
    put(log, "c.json", [status("j9", 9, "completed")])
    # Both go on from their own place, a late one replays all, and one that wants only news begins at the end.
    assert [x[1] for x in collect(spark, event_log(spark, log, start="a.json:3"), tmp, "two")] == [9]
    assert [x[1] for x in collect(spark, event_log(spark, log), tmp, "one")] == [9]
    assert len(collect(spark, event_log(spark, log), tmp, "late")) == 10
    assert collect(spark, event_log(spark, log, start="last"), tmp, "news") == []
    put(log, "d.json", [status("j10", 10, "running")])
    assert [x[1] for x in collect(spark, event_log(spark, log, start="last"), tmp, "news")] == [10]


def test_event_log_reads_what_the_batch_reader_reads(spark, tmp):
    log = f"{tmp}/log"
    rows = [status("j", 1, "planning", url="http://x/", depth=2, pages_done=3), {"job_id": "k", "event": "page", "error": "é"}, {"seq": 4}]
    put(log, "a.json", rows)
    with open(f"{log}/b.json", "w") as f:
        f.write('\n{"job_id": "m", "seq": 7}\nno json\n[1]\n')
    cols = [f.name for f in CRAWL_EVENTS.fields]
    mine = event_log(spark, log, stream=False)
    theirs = spark.read.schema(CRAWL_EVENTS).option("mode", "DROPMALFORMED").json(log)
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert [x for x in key(mine)] == [x for x in key(theirs.filter("job_id is not null or seq is not null"))]
    assert event_log(spark, f"{tmp}/absent", stream=False).count() == 0
    assert collect(spark, event_log(spark, log, start="b.json:2"), tmp, "x") == []
