"""Batch model calls as a seam.

Prompts are string expressions. The call itself is a user-supplied batch
function run by ``mapInPandas`` (one client per partition); failures become
'' as the reference's summarize does. A built-in offline summarizer keeps the
three sentences of each text with the best BM25 score against the goal,
computed with DataFrame expressions like the BM25 filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import clean_html

HTML_CAP = 15_000
SENTENCE_RE = r"(?<=[.!?])\s+"


def summary_prompts(rows: DataFrame, goal: str) -> DataFrame:
    """L4 prompt: goal, url and page text."""
    prompt = F.concat(F.lit(f"Goal: {goal}\nURL: "), F.col("url"), F.lit("\n\nPage text:\n"), F.coalesce(F.col("text"), F.lit("")))
    return rows.select("page_id", prompt.alias("prompt"))


def extraction_prompts(pages: DataFrame, goal: str, description: str) -> DataFrame:
    """L5 prompt: goal, url, description and the cleaned html cut to 15,000 characters."""
    html = F.substring(clean_html("html"), 1, HTML_CAP)
    head = F.concat(F.lit(f"Goal: {goal}\nURL: "), F.col("url"), F.lit(f"\nExtract: {description}"))
    body = F.when(html != "", F.concat(F.lit("\n\nPage HTML:\n"), html)).otherwise(F.lit(""))
    return pages.select("page_id", F.concat(head, body, F.lit("\n\nProduce the extraction schema JSON.")).alias("prompt"))


def summarize(rows: DataFrame, make_fn: Callable[[], Callable[[list[str], list[str], list[str]], list[str]]],
              goal: str, only_missing: bool = True) -> DataFrame:
    """L4: fill ``summary`` by calling ``make_fn()``'s batch function once per
    Arrow batch (the client is made once per partition). Rows that already
    have a summary or have no text are passed through when ``only_missing``.
    Where a batch fails, its rows are asked one by one, so that only the rows
    that fail themselves lose their summary. Adds ``had_summary`` (for A4) and
    ``failed`` (the call raised); a failed or empty answer is ''."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    cols = rows.columns
    schema = StructType(list(rows.schema.fields) + [StructField("had_summary", BooleanType()), StructField("failed", BooleanType())])  # not .add: it mutates

    def run(batches: Iterator):
        fn = make_fn()
        for pdf in batches:
            had = pdf["summary"].fillna("") != ""
            want = (~had) & (pdf["text"].fillna("") != "") if only_missing else pdf["text"].fillna("") != ""
            out = pdf["summary"].fillna("").copy()
            idx = list(pdf.index[want])
            failed = want & False
            groups = [idx] if idx else []
            while groups:
                some = groups.pop()
                try:
                    got = fn([goal] * len(some), list(pdf.loc[some, "url"]), list(pdf.loc[some, "text"]))
                    out.loc[some] = [(g or "").strip() for g in got]
                except Exception:  # noqa: BLE001 - a provider's error costs that row its summary, not the job
                    if len(some) > 1:
                        groups += [[i] for i in some]
                    else:
                        out.loc[some], failed.loc[some] = "", True
            pdf = pdf[cols].copy()
            pdf["summary"] = out
            pdf["had_summary"] = had | ~want
            pdf["failed"] = failed
            yield pdf

    from ..session import ship_package

    ship_package(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def extractive_summaries(rows: DataFrame, goal: str, n: int = 3) -> DataFrame:
    """Offline summarizer: the ``n`` sentences with the best BM25 score
    against the goal (corpus = the row's own sentences), in text order,
    joined by a space. Pure DataFrame expressions; adds ``summary_text``."""
    from .relevance import goal_terms, with_bm25

    sentences = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SENTENCE_RE), lambda s: F.trim(s) != "")
    df = rows.withColumn("_sent", F.transform(sentences, lambda s: F.struct(s.alias("text"))))
    df = with_bm25(df, "_sent", goal_terms(goal), "_ss")
    ranked = F.transform(F.arrays_zip(F.col("_sent").alias("s"), F.col("_ss").alias("score")),
                         lambda z, i: F.struct((-z["score"]).alias("neg"), i.alias("i"), z["s"]["text"].alias("t")))
    best = F.slice(F.array_sort(ranked), 1, n)
    in_order = F.array_sort(F.transform(best, lambda b: F.struct(b["i"].alias("i"), b["t"].alias("t"))))
    return df.withColumn("summary_text", F.array_join(F.transform(in_order, lambda b: b["t"]), " ")).drop("_sent", "_ss")
