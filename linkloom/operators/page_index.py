"""O2 with an index: a page of a job's results without numbering all of them.

The results are range-partitioned once by (job, order) and written, a folder
for each range; beside them a small table has, for each range and job, the
position of the job's first row there. A page then reads the index and the
ranges it touches, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class PageIndex:
    """Where an index is, and the columns it was built by."""

    path: str
    by: str
    order: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def ranges(self, spark: SparkSession) -> DataFrame:
        """(range, by, first, last, total): positions from 1."""
        return spark.read.parquet(f"{self.path}/ranges")


def build_page_index(df: DataFrame, path: str, by: str = "job_id", order: str = "seq", ranges: int | None = None) -> PageIndex:
    """Write ``df`` and its index to ``path`` (which must not exist).

    ``order`` is unique within a job. A job with very many rows spans ranges;
    a range has about ``RANGE_ROWS`` rows unless ``ranges`` says how many there are.
    """
    n = ranges or max(1, -(-df.count() // RANGE_ROWS))
    part = df.repartitionByRange(n, by, order).withColumn("range", F.spark_partition_id()).sortWithinPartitions(by, order)
    part.write.partitionBy("range").parquet(f"{path}/rows")
    spark = df.sparkSession
    # Ranges follow each other in order, so a job's rows before a range are those of its lower ranges.
    held = spark.read.parquet(f"{path}/rows").groupBy("range", by).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("range")
    index = held.withColumn("last", F.sum("n").over(before)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    index.select("range", by, (F.col("last") - F.col("n") + 1).alias("first"), "last", "total").write.parquet(f"{path}/ranges")
    return PageIndex(path, by, order)


def page_of(spark: SparkSession, index: PageIndex, page: int = 1, per_page: int = 50, job=None) -> DataFrame:
    """O2: rows (page-1)*per_page + 1 to page*per_page of ``job``, or of every job, with position, total, page and per_page.

    With ``job`` the ranges it touches are looked up first (at most
    per_page of them) and only their folders are read.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page must be >= 1")
    start, stop = (page - 1) * per_page + 1, page * per_page
    touched = index.ranges(spark).filter((F.col("first") <= stop) & (F.col("last") >= start))
    rows = index.rows(spark)
    if job is not None:
        touched = touched.filter(F.col(index.by) == F.lit(job))
        ids = [r["range"] for r in touched.select("range").distinct().collect()]
        rows = rows.filter(F.col("range").isin(*ids) & (F.col(index.by) == F.lit(job))) if ids else rows.limit(0)
    j = rows.join(touched, ["range", index.by])
    # Positions within a range: its rows of a job are few beside the job, and bounded by the range.
    at = F.row_number().over(Window.partitionBy("range", index.by).orderBy(index.order))
    j = j.withColumn("position", (at + F.col("first") - 1).cast("long")).filter(F.col("position").between(start, stop))
    return j.drop("range", "first", "last").withColumn("page", F.lit(page).cast("long")).withColumn("per_page", F.lit(per_page).cast("long"))
