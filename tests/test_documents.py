"""Exports as one document (K2, K3, K5), the page index (O2), result chunks."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom.operators.event_log import result_chunks
from linkloom.operators.page_index import build_page_index, page_of
from linkloom.operators.results import csv_rows, job_result_rows, ok_only, paginate
from linkloom.sinks.files import export_document
from linkloom.sinks.ordered import open_export, save_export, write_document
from linkloom.sources.derived import results_v


@pytest.fixture(autouse=True)
def several_tasks(spark):
    """Small tables in several tasks too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def expected_json(results):
    out = []
    for r in sorted(ok_only(results).collect(), key=lambda r: r.seq):
        row = {"url": r.url, "depth": r.depth, "score": r.score, "title": r.title, "links_count": len(r.links), "links": r.links,
               "summary": r.summary, "text": r.text, "status_code": r.status_code}
        if r.extracted_content:
            try:
                row["extracted_content"] = json.loads(r.extracted_content)
            except ValueError:
                row["extracted_content"] = r.extracted_content
        out.append(row)
    return out


def test_json_document_loads_in_order(spark, sf, tmp):
    results = results_v(spark, sf).repartition(5)
    assert export_document(results, f"{tmp}/all.json") == "json"
    assert len(glob.glob(f"{tmp}/all.json/*rows")) > 1  # several tasks wrote it
    assert json.load(open_export(f"{tmp}/all.json")) == expected_json(results)
    save_export(f"{tmp}/all.json", f"{tmp}/one.json")
    with open(f"{tmp}/one.json", encoding="utf-8") as f:
        assert json.load(f) == expected_json(results)
    assert sorted(os.listdir(tmp)) == ["all.json", "one.json"]


def test_csv_document_has_one_header(spark, sf, tmp):
    results = results_v(spark, sf).repartition(5)
    assert export_document(results, f"{tmp}/all.csv") == "csv"
    got = list(csv.DictReader(io.TextIOWrapper(open_export(f"{tmp}/all.csv"), encoding="utf-8", newline="")))
    rows = csv_rows(results).orderBy("seq").drop("seq")
    assert got == [{k: "" if v is None else str(v) for k, v in r.asDict().items()} for r in rows.collect()]
    assert list(got[0]) == ["url", "depth", "score", "links_count", "title", "summary", "text_snippet"]


def test_documents_with_odd_rows(spark, tmp):
    rows = [(3, 'a"b,\n', None), (1, "é ", '{"k": [1, 2.50]}'), (2, None, None)]
    df = spark.createDataFrame(rows, "n int, text string, raw string")
    write_document(df, f"{tmp}/x", "json", ["n"], raw=("raw",))
    assert json.load(open_export(f"{tmp}/x")) == [{"text": "é ", "raw": {"k": [1, 2.5]}}, {"text": None}, {"text": 'a"b,\n'}]
    write_document(df.limit(0), f"{tmp}/none", "json", ["n"])
    assert json.load(open_export(f"{tmp}/none")) == []
    with pytest.raises(FileExistsError):
        write_document(df, f"{tmp}/x", "json", ["n"])
    write_document(df.filter("n = 2"), f"{tmp}/x", "json", ["n"], raw=("raw",), overwrite=True)
    assert json.load(open_export(f"{tmp}/x")) == [{"text": None}]


def test_a_failed_write_leaves_nothing(spark, tmp):
    df = spark.range(0, 40, 1, 4).withColumn("x", F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.lit("ok")))
    with pytest.raises(Exception, match="broken row"):
        write_document(df.withColumn("n", F.col("id")), f"{tmp}/y", "json", ["n"])
    assert os.listdir(tmp) == []


def test_export_document_refuses_nothing_and_existing(spark, sf, tmp):
    with pytest.raises(ValueError, match="No results"):
        export_document(results_v(spark, sf).filter("error <> ''"), f"{tmp}/z.json")
    assert os.listdir(tmp) == []


# ── O2 with an index ────────────────────────────────────────────────────────

def test_indexed_pages_equal_paginate(spark, sf, tmp):
    rows = job_result_rows(results_v(spark, sf))
    index = build_page_index(rows, f"{tmp}/index", ranges=7)
    for page, per_page in ((1, 3), (2, 5), (40, 5)):
        expected = paginate(rows, page, per_page)
        got = page_of(spark, index, page, per_page).select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_one_page_reads_the_ranges_it_touches(spark, tmp):
    """A job of 6,000 rows over ten ranges of 1,000: a page of it reads one range, or two across a border."""
    rows = spark.range(10_000).select(F.when(F.col("id") < 6000, "big").otherwise(F.concat(F.lit("small"), F.col("id") % 40)).alias("job_id"), F.col("id").alias("seq"))
    index = build_page_index(rows, f"{tmp}/index", ranges=10)
    sizes = {r["range"]: r["count"] for r in index.rows(spark).groupBy("range").count().collect()}
    assert len(sizes) > 5

    def read(df):
        files = {os.path.dirname(f) for f in df.inputFiles() if "/rows/" in f}
        return df.filter("true"), files

    for page in (1, 31, 60):
        df = page_of(spark, index, page, 100, job="big")
        assert [r.seq for r in df.orderBy("position").collect()] == list(range((page - 1) * 100, page * 100))
        assert {r.total for r in df.collect()} == {6000}
        touched = index.ranges(spark).filter((F.col("job_id") == "big") & (F.col("first") <= page * 100) & (F.col("last") > (page - 1) * 100)).count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert touched <= 2 and "PartitionFilters" in plan
        # Rows that the scan of the chosen folders holds.
        chosen = [r["range"] for r in index.ranges(spark).filter((F.col("job_id") == "big") & (F.col("first") <= page * 100) & (F.col("last") > (page - 1) * 100)).collect()]
        assert sum(sizes[c] for c in chosen) <= 2 * max(sizes.values()) < 10_000 / 2
    assert page_of(spark, index, 1, 10, job="absent").collect() == []
    with pytest.raises(ValueError):
        page_of(spark, index, 0, 10)


# ── P12's chunks ────────────────────────────────────────────────────────────

def test_result_chunks_are_bounded(spark, sf):
    rows = job_result_rows(results_v(spark, sf))
    got = result_chunks(rows, size=4).collect()
    assert max(len(r.results) for r in got) <= 4
    whole = {}
    for r in sorted(got, key=lambda r: (r.job_id, r.chunk)):
        whole.setdefault(r.job_id, []).extend(x.url for x in r.results)
        assert [x.position for x in r.results] == list(range(r.chunk * 4 + 1, r.chunk * 4 + 1 + len(r.results)))
    expected = {}
    for r in rows.orderBy("job_id", "seq").collect():
        expected.setdefault(r.job_id, []).append(r.url)
    assert whole == expected
