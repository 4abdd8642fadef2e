"""Schemas of the library's tables."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampType)

RESULTS = StructType([
    StructField("seq", LongType()), StructField("job_id", StringType()), StructField("url", StringType()),
    StructField("depth", IntegerType()), StructField("text", StringType()), StructField("links", ArrayType(StringType())),
    StructField("score", DoubleType()), StructField("error", StringType()), StructField("summary", StringType()),
    StructField("extracted_content", StringType()), StructField("title", StringType()),
    StructField("status_code", IntegerType()),
])

# One persisted result line (JSONL); ``seq`` is ours and optional on read.
RESULTS_JSONL = StructType([
    StructField("seq", LongType()), StructField("url", StringType()), StructField("depth", IntegerType()),
    StructField("score", DoubleType()), StructField("title", StringType()), StructField("summary", StringType()),
    StructField("error", StringType()), StructField("links_count", IntegerType()),
    StructField("text_snippet", StringType()), StructField("status_code", IntegerType()),
    StructField("extracted_content", StringType()),
])

CRAWL_EVENTS = StructType([
    StructField("job_id", StringType()), StructField("seq", LongType()), StructField("ts", TimestampType()),
    StructField("event", StringType()), StructField("status", StringType()), StructField("summary", StringType()),
    StructField("error", StringType()), StructField("url", StringType()), StructField("depth", IntegerType()),
    StructField("pages_done", IntegerType()),
])

LINKS = StructType([
    StructField("src_url", StringType()), StructField("dst_url", StringType()), StructField("pos", IntegerType()),
    StructField("is_internal", BooleanType()),
])

PLAN_SEED = StructType([StructField("url", StringType()), StructField("score", DoubleType()),
                        StructField("reason", StringType())])
