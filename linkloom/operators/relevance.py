"""Goal-relevant text: blocks, BM25 and pruning filters.

The BM25 corpus is one page's own blocks, and a page is one row, so the
whole computation (document frequencies, average length, per-block scores,
fit text) is done inside the row with higher-order functions: no explode,
no shuffle, and the cost grows linearly with the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import CLEANED_TAGS, EXCLUDED_TAGS, blocks, page_text
from ..functions.text import tokens

K1, B = 1.5, 0.75
BM25_THRESHOLD = 1.2
PRUNE_WEIGHTS = (0.5, 0.4, 0.1)
PRUNE_THRESHOLD = 0.48
ANCHOR_RE = r"(?is)<a\b[^>]*>(.*?)</a\s*>"


def goal_terms(goal) -> Column:
    """Distinct goal tokens in first-seen order (a literal goal or a column)."""
    g = F.lit(goal) if isinstance(goal, str) else goal
    return F.array_distinct(tokens(g))


def with_bm25(df: DataFrame, blocks_col: str, terms: Column, out: str = "_scores",
              k1: float = K1, b: float = B) -> DataFrame:
    """Add ``out`` = Okapi BM25 of each block of ``blocks_col`` against
    ``terms``; corpus = the row's own blocks.

    idf = ln((N - n + 0.5)/(n + 0.5) + 1),
    score = Σ idf·tf·(k1+1)/(tf + k1·(1 - b + b·dl/avgdl)).
    Staged as separate columns (tokens → page stats → block scores) so that
    each array is computed once per row.
    """
    df = df.withColumn("_toks", F.transform(blocks_col, lambda blk: tokens(blk["text"])))
    df = df.withColumn("_terms", terms)
    n_blocks = F.size("_toks")
    total = F.aggregate("_toks", F.lit(0).cast("long"), lambda acc, t: acc + F.size(t))
    df_n = F.transform("_terms", lambda term: F.size(F.filter("_toks", lambda t: F.array_contains(t, term))))
    df = df.withColumn("_stats", F.struct(
        F.try_divide(total.cast("double"), n_blocks.cast("double")).alias("avgdl"),
        n_blocks.alias("n"), df_n.alias("df")))
    idf = F.transform("_stats.df", lambda n: F.log((F.col("_stats.n") - n + 0.5) / (n + 0.5) + 1.0))
    df = df.withColumn("_qi", F.arrays_zip(F.col("_terms").alias("term"), idf.alias("idf")))

    def block_score(t):
        dl = F.size(t).cast("double")
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.coalesce(F.try_divide(dl, F.col("_stats.avgdl")), F.lit(0.0)))

        def add(acc, qi):
            tf = F.size(F.filter(t, lambda x: x == qi["term"])).cast("double")
            return acc + F.when(tf > 0, qi["idf"] * tf * (k1 + 1.0) / (tf + norm)).otherwise(F.lit(0.0))

        return F.aggregate("_qi", F.lit(0.0), add)

    df = df.withColumn(out, F.transform("_toks", block_score))
    return df.drop("_toks", "_terms", "_stats", "_qi")


def _kept_text(block_arr: Column, scores: Column, threshold: float) -> Column:
    kept = F.filter(F.arrays_zip(block_arr.alias("blk"), scores.alias("s")),
                    lambda z: F.round(z["s"], 4) >= F.lit(threshold))
    return F.array_join(F.transform(kept, lambda z: z["blk"]["text"]), "\n")


def bm25_filter(pages: DataFrame, goal, threshold: float = BM25_THRESHOLD, k1: float = K1, b: float = B,
                excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> DataFrame:
    """B2: fit text = blocks with BM25 >= threshold, in order, joined by '\\n';
    ``text`` = P3 (fit text, else the stripped page)."""
    blk = blocks("html", excluded)
    scored = with_bm25(pages.select("page_id", "url", blk.alias("_blocks")), "_blocks", goal_terms(goal), "_scores", k1, b)
    fit = _kept_text(F.col("_blocks"), F.col("_scores"), threshold)
    return scored.select("page_id", "url", fit.alias("fit_text"),
                         page_text(fit=fit, raw=F.concat_ws(" ", F.transform("_blocks", lambda x: x["text"]))).alias("text"))


def bm25_block_rows(pages: DataFrame, goal, threshold: float = BM25_THRESHOLD, k1: float = K1, b: float = B,
                    excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> DataFrame:
    """B1+B2 as rows: one row per block with its score and keep flag."""
    blk = blocks("html", excluded)
    s = with_bm25(pages.select("page_id", blk.alias("_blocks")), "_blocks", goal_terms(goal), "_scores", k1, b)
    z = s.select("page_id", F.posexplode(F.arrays_zip(F.col("_blocks").alias("blk"), F.col("_scores").alias("s"))))
    return z.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("col.blk.text").alias("text"),
                    F.round(F.col("col.s"), 4).alias("score"),
                    (F.round(F.col("col.s"), 4) >= F.lit(threshold)).alias("kept"))


def block_rows(pages: DataFrame, excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> DataFrame:
    """B1 as rows: page_id, pos, piece (raw html), text."""
    z = pages.select("page_id", F.posexplode(blocks("html", excluded)))
    return z.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("col.piece").alias("piece"),
                    F.col("col.text").alias("text"))


def prune_scores(block_arr: Column, weights=PRUNE_WEIGHTS) -> Column:
    """B3 per-block score: w0·text_density + w1·(1 - link_density) + w2·min(words/10, 1)."""
    from ..functions.html import strip_tags

    w0, w1, w2 = weights

    def one(blk):
        text_len = F.length(blk["text"]).cast("double")
        piece_len = F.length(blk["piece"]).cast("double")
        anchors = F.regexp_extract_all(blk["piece"], F.lit(ANCHOR_RE), 1)
        link_len = F.aggregate(anchors, F.lit(0).cast("long"), lambda acc, a: acc + F.length(strip_tags(a))).cast("double")
        td = F.coalesce(F.try_divide(text_len, piece_len), F.lit(0.0))
        ld = F.coalesce(F.try_divide(link_len, text_len), F.lit(0.0))
        words = F.size(tokens(blk["text"])).cast("double")
        return F.lit(w0) * td + F.lit(w1) * (F.lit(1.0) - ld) + F.lit(w2) * F.least(words / 10.0, F.lit(1.0))

    return F.transform(block_arr, one)


def pruning_filter(pages: DataFrame, threshold: float = PRUNE_THRESHOLD, weights=PRUNE_WEIGHTS,
                   excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> DataFrame:
    """Goal-free boilerplate pruning; fit text = kept blocks joined by
    '\\n'; ``text`` = P3 (fit text, else the stripped page)."""
    blk = blocks("html", excluded)
    s = pages.select("page_id", "url", blk.alias("_blocks"))
    s = s.withColumn("_scores", prune_scores(F.col("_blocks"), weights))
    kept = F.filter(F.arrays_zip(F.col("_blocks").alias("blk"), F.col("_scores").alias("s")),
                    lambda z: F.round(z["s"], 4) >= F.lit(threshold))
    fit = F.array_join(F.transform(kept, lambda z: z["blk"]["text"]), "\n")
    whole = F.concat_ws(" ", F.transform("_blocks", lambda x: x["text"]))
    return s.select("page_id", "url", fit.alias("fit_text"), page_text(fit=fit, raw=whole).alias("text"),
                    F.size(kept).cast("long").alias("kept_blocks"), F.size("_blocks").cast("long").alias("blocks"))


def prune_block_rows(pages: DataFrame, threshold: float = PRUNE_THRESHOLD, weights=PRUNE_WEIGHTS,
                     excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> DataFrame:
    s = pages.select("page_id", blocks("html", excluded).alias("_blocks"))
    s = s.withColumn("_scores", prune_scores(F.col("_blocks"), weights))
    z = s.select("page_id", F.posexplode(F.arrays_zip(F.col("_blocks").alias("blk"), F.col("_scores").alias("s"))))
    return z.select("page_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("col.s"), 4).alias("score"),
                    (F.round(F.col("col.s"), 4) >= F.lit(threshold)).alias("kept"))


def content_text(pages: DataFrame, content_filter: str = "bm25", goal: str = "",
                 bm25_threshold: float = BM25_THRESHOLD) -> DataFrame:
    """B4 dispatcher: page_id, url, fit_text (NULL for 'none'), text."""
    if content_filter == "bm25":
        return bm25_filter(pages, goal, bm25_threshold)
    from ..functions.html import clean_html
    if content_filter == "pruning":
        return pruning_filter(pages).select("page_id", "url", "fit_text", "text")
    if content_filter == "none":
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("fit_text"),
                            page_text(html=clean_html("html")).alias("text"))
    raise ValueError("content_filter must be bm25, pruning or none")


def paragraphs(text) -> Column:
    """Blocks of a plain text: its lines, trimmed of spaces, non-empty."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda line: F.struct(F.trim(line).alias("text")))
    return F.filter(lines, lambda b: b["text"] != "")


def text_bm25(docs: DataFrame, goal, key: str = "doc_id", threshold: float = BM25_THRESHOLD) -> DataFrame:
    """B2 over plain texts (corpus = a text's own paragraphs): per text the
    paragraph count, kept count, fit-text length and best score."""
    df = with_bm25(docs.select(key, paragraphs("text").alias("_b")), "_b", goal_terms(goal), "_s")
    kept = F.filter(F.arrays_zip(F.col("_b").alias("b"), F.col("_s").alias("s")),
                    lambda z: F.round(z["s"], 4) >= F.lit(threshold))
    return df.select(
        key, F.size("_b").cast("long").alias("paragraphs"), F.size(kept).cast("long").alias("kept"),
        F.length(F.array_join(F.transform(kept, lambda z: z["b"]["text"]), "\n")).cast("long").alias("fit_len"),
        F.round(F.array_max("_s"), 4).alias("best"))
