"""Row numbers and running sums that never put one hot group in one task.

``row_number() OVER (PARTITION BY k ORDER BY o)`` hash-partitions on ``k``;
that is fine while the largest group is modest, so the group sizes are
checked first (one partial aggregate). Beyond the bound, and always where
the whole table is numbered, rows are range-partitioned on ``(k, o)`` instead, which splits a hot key over many
partitions; each partition numbers its rows locally and adds the counts of
the same key in earlier partitions (a small per-(key, partition) summary).

The range-partitioned rows are checkpointed before the two uses: Spark's
range partitioner samples its bounds per execution, so two unmaterialised
uses could disagree on which partition a row is in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_MAX_GROUP_ROWS = 5_000_000
_PID, _LRN, _BEFORE = "_ord_pid", "_ord_lrn", "_ord_before"


def _sort_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest ``by`` group (partial aggregate, one number back)."""
    v = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return int(v or 0)


def ordinal(df: DataFrame, order_by: Sequence, by: Sequence[str] = (), name: str = "rn",
            running: Column | None = None, running_name: str | None = None,
            max_group_rows: int | None = None, num_partitions: int | None = None,
            group_rows: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its ``by`` group in
    ``order_by`` order (give a total order for a stable answer).

    ``running`` (optional numeric Column) adds ``running_name`` = its running
    sum in the same order, current row included. ``group_rows`` is a known
    upper bound of the largest group's size (skips the check).
    """
    spark = df.sparkSession
    bound = max_group_rows if max_group_rows is not None else int(
        spark.conf.get("linkloom.ordinal.maxGroupRows", str(DEFAULT_MAX_GROUP_ROWS)))
    order = [_sort_col(c) for c in order_by]
    rname = running_name or f"{name}_running"
    work = df.withColumn("_ord_w", running.cast("long")) if running is not None else df

    if by and (group_rows if group_rows is not None else largest_group(df, by)) <= bound:
        w = Window.partitionBy(*by).orderBy(*order)
        out = work.withColumn(name, F.row_number().over(w).cast("long"))
        if running is not None:
            out = out.withColumn(rname, F.sum("_ord_w").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
            out = out.drop("_ord_w")
        return out

    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = cut_lineage(work.repartitionByRange(n, *keys, *order).withColumn(_PID, F.spark_partition_id()))
    w_local = Window.partitionBy(*by, _PID).orderBy(*order)
    local = ranged.withColumn(_LRN, F.row_number().over(w_local))
    aggs = [F.max(_LRN).alias("_ord_cnt")]
    if running is not None:
        local = local.withColumn("_ord_wl", F.sum("_ord_w").over(w_local.rowsBetween(Window.unboundedPreceding, 0)))
        aggs.append(F.sum("_ord_w").alias("_ord_wsum"))
    summary = local.groupBy(*by, _PID).agg(*aggs)
    w_prev = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn(_BEFORE, F.coalesce(F.sum("_ord_cnt").over(w_prev), F.lit(0)))
    cols = [*by, _PID, _BEFORE]
    if running is not None:
        summary = summary.withColumn("_ord_wbefore", F.coalesce(F.sum("_ord_wsum").over(w_prev), F.lit(0)))
        cols.append("_ord_wbefore")
    # The summary has one row per (key, partition); the join keeps ``local``'s
    # hash partitioning on (key, partition), so only the summary moves (or is
    # broadcast by AQE when its runtime size allows).
    out = local.join(summary.select(*cols), on=[*by, _PID], how="inner")
    out = out.withColumn(name, (F.col(_LRN) + F.col(_BEFORE)).cast("long"))
    drop = [_PID, _LRN, _BEFORE]
    if running is not None:
        out = out.withColumn(rname, (F.col("_ord_wl") + F.col("_ord_wbefore")).cast("long"))
        drop += ["_ord_w", "_ord_wl", "_ord_wbefore"]
    return out.drop(*drop)
