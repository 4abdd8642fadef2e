"""Result-table queries: filters, dedupe, top-n, paging, views, counts
(F3-F5, W1-W3, O1-O3, A1, A4, A5, P9-P11, P13, K1/K2/K4 row shapes).

``results`` has the page-result columns plus ``seq`` (arrival order) and
``job_id``; see ``schemas.RESULTS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import error_label
from ..functions.fmt import format_fixed
from ..functions.text import snippet
from .ordinal import ordinal


def ok_only(df: DataFrame) -> DataFrame:
    """rows without error."""
    return df.filter(F.col("error") == "")


def errors_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error") != "")


def min_score(df: DataFrame, m: float) -> DataFrame:
    """only when m > 0, keep score >= m."""
    return df.filter(F.col("score") >= F.lit(m)) if m > 0 else df


def score_threshold(df: DataFrame, t: float) -> DataFrame:
    """only when t > 0, drop score < t (applied to emitted pages)."""
    return df.filter(F.col("score") >= F.lit(t)) if t > 0 else df


def dedupe_first(df: DataFrame, key: str = "url", order: str = "seq", columns: list[str] | None = None) -> DataFrame:
    """First non-error row per ``key`` by arrival.

    ``min_by`` over a struct is a partial aggregate: each task keeps one row
    per key before the shuffle, so a hot URL never piles up in one task.
    ``columns`` limits the carried columns (Catalyst cannot prune fields
    inside the aggregated struct, so unneeded wide columns would be scanned).
    """
    if columns is not None:
        df = df.select(*dict.fromkeys([key, order, "error", *columns]))
    ok = ok_only(df)
    others = [c for c in ok.columns if c != key]
    first = ok.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_first"))
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def top_results(df: DataFrame, n: int = 10, min_score_value: float = 0.0, sort: str = "score",
                by: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """O1: ok rows → first per url → min score → stable sort → first n, with
    ``rank`` (W3). ``sort='score'`` is score desc, ``'depth'`` depth asc;
    ties keep arrival order. ``by`` gives top n per group instead."""
    if n < 0:
        raise ValueError("n must be >= 0")
    if sort not in ("score", "depth"):
        raise ValueError("sort must be 'score' or 'depth'")
    if columns is not None:
        columns = list(dict.fromkeys([*columns, "score", "depth"] + ([by] if by else [])))
    rows = min_score(dedupe_first(df, columns=columns), min_score_value)
    order = [F.desc("score"), F.asc("seq")] if sort == "score" else [F.asc("depth"), F.asc("seq")]
    if by is None:
        top = rows.orderBy(*order).limit(n)  # TakeOrderedAndProject: per-task top n, then merge
        # W3 runs on at most n rows.
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def needs_summary(df: DataFrame) -> DataFrame:
    """O3: rows shown that still lack a summary and have text."""
    return df.filter((F.col("summary") == "") & (F.col("text") != ""))


def pages_done(df: DataFrame, by: str = "job_id", order: str = "seq") -> DataFrame:
    """Running count of results per job in arrival order."""
    return ordinal(df, [order], by=[by], name="pages_done")


def job_result_rows(df: DataFrame) -> DataFrame:
    """The per-job non-error projection kept by the job registry."""
    return ok_only(df).select(
        "job_id", "seq", "url", "depth", snippet("text", 500).alias("text_snippet"),
        F.size("links").cast("long").alias("links_count"), "score")


def paginate(df: DataFrame, page: int = 1, per_page: int = 50, by: str = "job_id",
             order: str = "seq") -> DataFrame:
    """O2: slice [(page-1)*per_page, +per_page) of each job's results, with
    the job's total before the cut."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page must be >= 1")
    start = (page - 1) * per_page
    numbered = ordinal(df, [order], by=[by], name="_pos")
    totals = df.groupBy(by).agg(F.count("*").alias("total"))
    sliced = numbered.filter((F.col("_pos") > start) & (F.col("_pos") <= start + per_page))
    return (sliced.join(totals, by, "inner")
            .withColumn("page", F.lit(page).cast("long")).withColumn("per_page", F.lit(per_page).cast("long"))
            .withColumnRenamed("_pos", "position"))


def crawl_summary(df: DataFrame) -> DataFrame:
    """A1: good count, error count, session total."""
    return df.agg(F.count_if(F.col("error") == "").alias("good"),
                  F.count_if(F.col("error") != "").alias("errors"),
                  F.count("*").alias("total"))


def error_breakdown(df: DataFrame) -> DataFrame:
    """A5: error rows per human label."""
    return (errors_only(df).groupBy(error_label("error").alias("label"))
            .agg(F.count("*").alias("n")))


def summary_report(shown: DataFrame) -> DataFrame:
    """A4: summaries wanted / failed (empty) and the all-failed flag, over rows
    that went through ``summarize``; needs ``had_summary`` and ``summary``."""
    wanted = F.count_if(~F.col("had_summary"))
    failed = F.count_if(~F.col("had_summary") & (F.col("summary") == ""))
    return shown.agg(wanted.alias("wanted"), failed.alias("failed"),
                     ((wanted > 0) & (wanted == failed)).alias("all_failed"))


def result_view(df: DataFrame) -> DataFrame:
    """P10: display row: rank, url, score '.2f', depth, links, then summary
    else the 120-char snippet with newlines as spaces."""
    return df.select(
        "rank", "url", format_fixed("score", 2).alias("score_text"), "depth",
        F.size("links").cast("long").alias("links_count"),
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), snippet("text", 120, True)).alias("line"))


def _pad3(n: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, " ")).otherwise(s)


def progress_lines(df: DataFrame, by: str = "job_id", order: str = "seq") -> DataFrame:
    """One progress line per page, numbered per job in arrival order."""
    numbered = ordinal(df, [order], by=[by], name="n")
    is_err = F.col("error") != ""
    line = F.concat(
        F.when(is_err, F.lit("✗")).otherwise(F.lit("✓")), F.lit(" ["), _pad3(F.col("n")), F.lit("] depth="),
        F.col("depth").cast("string"), F.lit(" score="), format_fixed("score", 2), F.lit("  "),
        F.substring("url", 1, 80),
        F.when(is_err, F.concat(F.lit("  ("), error_label("error"), F.lit(")"))).otherwise(F.lit("")))
    return numbered.select(by, order, "n", line.alias("line"))


def jsonl_rows(df: DataFrame) -> DataFrame:
    """K1 row shape: the ten persisted keys, errors included, text cut to 500."""
    return df.select(
        "seq", "url", "depth", "score", "title", "summary", "error",
        F.size("links").cast("long").alias("links_count"), snippet("text", 500).alias("text_snippet"),
        "status_code", "extracted_content")


def csv_rows(df: DataFrame) -> DataFrame:
    """K2 row shape: non-error rows (not deduplicated), 7 columns; the snippet
    is cut to 500 characters first, then newlines become spaces."""
    return ok_only(df).select(
        "seq", "url", "depth", "score", F.size("links").cast("long").alias("links_count"), "title", "summary",
        snippet("text", 500, True).alias("text_snippet"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """K4: one markdown section per non-error row, numbered in session order."""
    ok = ordinal(ok_only(df), ["seq"], name="rank")
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.nullif(snippet("text", 500), F.lit("")))
    md = F.concat(
        F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")),
        F.lit("\n\n- **URL:** "), F.col("url"),
        F.lit("\n- **Score:** "), format_fixed("score", 2),
        F.lit("\n- **Depth:** "), F.col("depth").cast("string"),
        F.lit("\n- **Links:** "), F.size("links").cast("string"), F.lit("\n\n"),
        F.when(body.isNotNull(), F.concat(body, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit("---\n\n"))
    return ok.select("seq", "rank", md.alias("md"))
