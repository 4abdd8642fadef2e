"""Result queries: dedupe, top-n, paging, ordinal (golden rows + properties)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import results as R
from linkloom.operators.ordinal import ordinal

COLS = "seq long, job_id long, url string, depth int, text string, links array<string>, score double, error string, summary string, extracted_content string, title string, status_code int"


def mk(spark, rows):
    full = [(s, j, u, d, t, [], sc, e, sm, "", "", 200) for (s, j, u, d, t, sc, e, sm) in rows]
    return spark.createDataFrame(full, COLS)


def test_first_ok_row_wins(spark):
    df = mk(spark, [(1, 1, "u", 0, "a", 0.9, "403", ""), (2, 1, "u", 1, "b", 0.2, "", ""), (3, 1, "u", 2, "c", 0.8, "", "")])
    got = R.dedupe_first(df).collect()
    assert len(got) == 1 and got[0]["seq"] == 2


def test_top_results_stable(spark):
    df = mk(spark, [(i, 1, f"u{i}", i % 3, "t", [0.5, 0.9, 0.5, 0.2][i % 4], "", "") for i in range(12)])
    top = R.top_results(df, n=5, sort="score").orderBy("rank").collect()
    assert [r["seq"] for r in top] == [1, 5, 9, 0, 2]
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    dep = R.top_results(df, n=4, sort="depth").orderBy("rank").collect()
    assert [r["seq"] for r in dep] == [0, 3, 6, 9]


def test_needs_summary(spark):
    df = mk(spark, [(1, 1, "a", 0, "x", 0.5, "", ""), (2, 1, "b", 0, "", 0.5, "", ""), (3, 1, "c", 0, "x", 0.5, "", "s")])
    assert [r["seq"] for r in R.needs_summary(df).collect()] == [1]


def test_negative_n_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        R.top_results(mk(spark, []), n=-1)


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=7), st.lists(st.integers(min_value=0, max_value=3), min_size=1, max_size=40))
def test_pages_concatenate_to_whole(spark, per_page, jobs):
    df = mk(spark, [(i, j, f"u{i}", 0, "t", 0.5, "", "") for i, j in enumerate(jobs)])
    seen = []
    for page in range(1, len(jobs) // per_page + 3):
        seen += [(r["job_id"], r["seq"]) for r in R.paginate(df, page, per_page).collect()]
    assert sorted(seen) == sorted((j, i) for i, j in enumerate(jobs))


def test_dedupe_idempotent(spark):
    df = mk(spark, [(i, 1, f"u{i % 5}", 0, "t", 0.1 * (i % 4), "" if i % 3 else "x", "") for i in range(30)])
    once = R.dedupe_first(df)
    twice = R.dedupe_first(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_ordinal_range_path_equals_window(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k"),
                                     (F.col("id") % 2).alias("w"))
    w = Window.partitionBy("k").orderBy("seq")
    expect = df.withColumn("rn", F.row_number().over(w)).withColumn("run", F.sum("w").over(w))
    for bound in (0, 10 ** 9):  # forced range path, then the window path
        got = ordinal(df, ["seq"], by=["k"], name="rn", running=F.col("w"), running_name="run", max_group_rows=bound)
        a = {(r["seq"], r["rn"], r["run"]) for r in got.collect()}
        b = {(r["seq"], r["rn"], r["run"]) for r in expect.collect()}
        assert a == b
    glob = ordinal(df, ["seq"], name="g", max_group_rows=0)
    assert {(r["seq"], r["g"]) for r in glob.collect()} == {(i, i + 1) for i in range(2000)}


def test_summary_report(spark):
    shown = spark.createDataFrame([(False, ""), (False, "ok"), (True, "x")], "had_summary boolean, summary string")
    r = R.summary_report(shown).first()
    assert (r["wanted"], r["failed"], r["all_failed"]) == (2, 1, False)
