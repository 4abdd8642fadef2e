"""File sources: persisted results (S1), page store (S2), event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import ordinal
from ..schemas import CRAWL_EVENTS, RESULTS_JSONL


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results JSONL → result rows. Blank and malformed lines are
    dropped, missing keys take '' / 0 / 0.0, ``text`` is the stored snippet
    and links are not restored (so ``links`` is empty). ``seq`` is the stored
    one when present, else the line order (file, offset, position)."""
    from pyspark.errors import AnalysisException

    try:
        raw = (spark.read.schema(RESULTS_JSONL).option("mode", "DROPMALFORMED").json(path)
               .select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                       F.monotonically_increasing_id().alias("_m")))
    except AnalysisException as e:  # a missing file means no rows, as in the reference
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], _results_out_schema())
        raise
    numbered = ordinal(raw, ["_f", "_b", "_m"], name="_line")
    s = F.coalesce
    return numbered.select(
        s(F.col("seq"), F.col("_line") - 1).alias("seq"), s(F.col("url"), F.lit("")).alias("url"),
        s(F.col("depth"), F.lit(0)).alias("depth"), s(F.col("text_snippet"), F.lit("")).alias("text"),
        F.array().cast("array<string>").alias("links"), s(F.col("score"), F.lit(0.0)).alias("score"),
        s(F.col("error"), F.lit("")).alias("error"), s(F.col("summary"), F.lit("")).alias("summary"),
        s(F.col("extracted_content"), F.lit("")).alias("extracted_content"), s(F.col("title"), F.lit("")).alias("title"),
        s(F.col("status_code"), F.lit(0)).alias("status_code"))


def _results_out_schema():
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
    return StructType([StructField("seq", LongType()), StructField("url", StringType()), StructField("depth", IntegerType()),
                       StructField("text", StringType()), StructField("links", ArrayType(StringType())),
                       StructField("score", DoubleType()), StructField("error", StringType()),
                       StructField("summary", StringType()), StructField("extracted_content", StringType()),
                       StructField("title", StringType()), StructField("status_code", IntegerType())])


def page_store(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S2 seam: a table of already-fetched pages (url, html, ...)."""
    return spark.read.format(fmt).load(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The crawl event log, batch or as a stream (a file stream starts at
    the earliest file: every new subscriber replays from the start)."""
    if stream:
        return spark.readStream.schema(CRAWL_EVENTS).json(path)
    return spark.read.schema(CRAWL_EVENTS).json(path)
