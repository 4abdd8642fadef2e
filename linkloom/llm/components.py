"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import paged_join, release, written


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours; frequent u are split."""
    least = edges.groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.least(F.min("v"), F.first("u")).alias("m"))
    return paged_join(edges, least, ["u"], "deg", total, F.xxhash64("v"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the component's smallest node.

    ``known``: labels of an earlier call; the components of its links and
    these together are found, from its stars on. Every round ties each node's
    larger neighbours to its smallest one, then its smaller ones, until the
    edges are stars; rounds grow with the logarithm of the size. Nothing of a
    node's neighbourhood is collected. The result is a written table: release
    it when it is of no more use.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.unionByName(known.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")))
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        total, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, check) == before or not total:
            break
        before = (total, check)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        small = _least(large, 2 * total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        old, edges = edges, written(small.distinct(), "edges")
        release(old, large)
    labels = written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
    release(edges)
    return labels
