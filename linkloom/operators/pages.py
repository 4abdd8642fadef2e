"""Page html → page rows and link rows (P1-P5, P8, C1). Narrow: no shuffle;
html is dropped by projection before anything downstream shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import clean_html, page_text, strip_tags, title_of
from ..functions.urls import authority, out_links


def page_rows(pages: DataFrame, fit_text=None) -> DataFrame:
    """One row per stored page: url, title, text (P3 over the cleaned html, or
    ``fit_text`` first when given), links_count, host."""
    text = page_text(fit=fit_text, html=clean_html("html"))
    return pages.select(
        "page_id", "url", title_of("html").alias("title"), text.alias("text"),
        F.size(out_links("html", "url")).cast("long").alias("links_count"),
        authority("url").alias("host"))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per out-link in link order (internal first, then external)."""
    exploded = pages.select("page_id", "url", F.posexplode(out_links("html", "url")).alias("pos", "l"))
    return exploded.select(
        "page_id", F.col("pos").cast("long").alias("pos"), F.col("l.href").alias("href"),
        F.col("l.url").alias("dst_url"), (~F.col("l.ext")).alias("is_internal"))


def link_counts(pages: DataFrame) -> DataFrame:
    """Per page: links, internal links and the first link's target, read off
    the page's link array (nothing is exploded or shuffled)."""
    links = pages.select("page_id", out_links("html", "url").alias("l"))
    return links.select(
        "page_id", F.size("l").cast("long").alias("links_count"),
        F.size(F.filter("l", lambda x: ~x["ext"])).cast("long").alias("internal_count"),
        F.get("l", F.lit(0))["url"].alias("first_link"))


def links_from_pages(pages: DataFrame) -> DataFrame:
    """The crawl's link table out of stored pages: src_url, dst_url, pos, is_internal."""
    return (page_links(pages.withColumn("page_id", F.col("url"))).select(
        F.col("page_id").alias("src_url"), "dst_url", F.col("pos").cast("int").alias("pos"), "is_internal"))


def page_text_only(pages: DataFrame) -> DataFrame:
    """P1+P2: text of the cleaned page, whitespace collapsed, uncut."""
    return pages.select("page_id", strip_tags(clean_html("html")).alias("text"))


def page_meta(df: DataFrame, meta_title: str = "meta_title", result_title: str = "result_title",
              depth: str = "depth", status_code: str = "status_code", score: str = "score",
              extracted: str = "extracted_content") -> DataFrame:
    """P8 on fetched-page rows: title = metadata title, else the result's
    title, else ''; depth and status default 0; score = |score| (default
    0.0); extracted content default ''. Missing columns count as absent."""
    def col(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    return df.withColumns({
        "title": F.coalesce(F.nullif(col(meta_title, None).cast("string"), F.lit("")),
                            F.nullif(col(result_title, None).cast("string"), F.lit("")), F.lit("")),
        "depth": F.coalesce(col(depth, None).cast("int"), F.lit(0)),
        "status_code": F.coalesce(col(status_code, None).cast("int"), F.lit(0)),
        "score": F.abs(F.coalesce(col(score, None).cast("double"), F.lit(0.0))),
        "extracted_content": F.coalesce(col(extracted, None).cast("string"), F.lit("")),
    })
