"""File sinks: results JSONL (K1) and exports as CSV / JSON / Markdown
(K2-K5). Row shapes are the queries in ``operators.results``; files are
written by Spark writers in session order (range-partitioned sort, never
coalesced to one task)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results as R


def append_results(df: DataFrame, path: str) -> None:
    """K1: append every result, errors included, as JSON lines (10 keys plus
    seq; text cut to 500; non-ASCII kept)."""
    rows = R.jsonl_rows(df)
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2: non-error rows, not deduplicated, in session order; 7 columns."""
    rows = R.csv_rows(df).orderBy("seq").drop("seq")
    (rows.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def json_rows(df: DataFrame) -> DataFrame:
    """K3 row shape: 9 keys (full text and links) plus extracted_content only
    when non-empty: parsed JSON if valid, else the raw string."""
    ec = F.col("extracted_content")
    as_string = F.try_variant_get(F.parse_json(F.to_json(F.array(ec))), "$[0]", "variant")
    extracted = F.when(F.coalesce(ec, F.lit("")) != "", F.coalesce(F.try_parse_json(ec), as_string))
    return R.ok_only(df).select(
        "seq", "url", "depth", "score", "title", F.size("links").alias("links_count"), "links", "summary", "text",
        "status_code", extracted.alias("extracted_content"))


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3: JSON lines in session order (one object per line instead of one
    array); extracted_content omitted when empty."""
    json_rows(df).orderBy("seq").drop("seq").write.mode(mode).option("ignoreNullFields", True).json(path)


def export_markdown(df: DataFrame, path: str, goal: str = "", mode: str = "errorifexists") -> None:
    """K4: header (title, optional goal, total) then one section per row."""
    body = R.markdown_rows(df).select(F.col("rank"), F.col("md"))
    goal_line = f"**Goal:** {goal}\n\n" if goal else ""
    header = R.ok_only(df).agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("rank"),
        F.concat(F.lit(f"# Crawl Results\n\n{goal_line}**Total pages:** "), F.col("n").cast("string"),
                 F.lit("\n\n---\n\n")).alias("md"))
    doc = header.unionByName(body).orderBy("rank")
    # the text writer adds one newline per row: drop the last one of each piece
    doc.select(F.regexp_replace("md", r"\n\z", "").alias("value")).write.mode(mode).text(path)


def export(df: DataFrame, path: str = "results.csv", goal: str = "", overwrite: bool = False) -> str:
    """K5: format by extension (.json, .md, else CSV). Raises when there is
    nothing to export; an existing path needs ``overwrite=True``."""
    if R.ok_only(df).isEmpty():
        raise ValueError("No results to export.")
    mode = "overwrite" if overwrite else "errorifexists"
    ext = os.path.splitext(path)[1].lower()
    if ext == ".json":
        export_json(df, path, mode)
        return "json"
    if ext == ".md":
        export_markdown(df, path, goal, mode)
        return "md"
    export_csv(df, path, mode)
    return "csv"



def export_document(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """K5 as one document: a JSON array (.json) or a CSV file with one header
    (anything but .md, which is ``export``'s), in session order, as a folder of
    ordered pieces that is shown when it is whole (``sinks.ordered``). Raises
    like ``export``."""
    from .ordered import write_document

    if R.ok_only(df).isEmpty():
        raise ValueError("No results to export.")
    if os.path.splitext(path)[1].lower() == ".md":
        return export(df, path, overwrite=overwrite)
    if os.path.splitext(path)[1].lower() == ".json":
        rows = json_rows(df).withColumn("extracted_content", F.to_json("extracted_content"))
        write_document(rows, path, "json", ["seq"], raw=("extracted_content",), overwrite=overwrite)
        return "json"
    write_document(R.csv_rows(df), path, "csv", ["seq"], overwrite=overwrite)
    return "csv"
