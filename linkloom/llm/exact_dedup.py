"""Operator 1: exact dedup with an extendible-hash index on shared files.

Keys are 64-bit hashes of the whole text. The *directory* is an array of
2^g slots, addressed by a key's first g bits; a slot names a bucket, and a
bucket that would hold more than ``capacity`` keys is split by one more bit
(when a split needs a bit more than g, the directory doubles). Buckets are
key ranges; their files are written to the shared folder, each by the task
that owns them. A key that very many rows share has several overflow
*pages*, so that no task gets all its rows.

Equal keys don't prove equal texts: for every key of two or more rows the
owner compares the texts byte by byte (grouping on the text itself) and
chains those that differ. Texts whose key is alone stay where they are, but
for a few that a map of the shared keys' low bits can't tell from them.

Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import maybe_in, without, written

#: Keys of a bucket before it splits.
CAPACITY = 4096
#: Overflow pages are cut so that at most so many keys can have several.
HOT_KEYS = 100_000
#: Rows of an overflow page, at least.
PAGE_ROWS = 1024


def _slot(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, n_keys: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, local_depth) over ``keys`` (h) and its global depth.

    All depths are counted in one pass; a bucket is the shallowest prefix
    with at most ``capacity`` keys. Prefixes that are overfull at the
    deepest level (an uneven hash) stay as they are and chain.
    """
    deepest = min(40, max(0, math.ceil(math.log2(max(1, n_keys) / capacity))) + 4)
    fine = keys.groupBy(_slot(F.col("h"), deepest).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    levels = (fine.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
              .groupBy("depth", F.expr(f"shiftrightunsigned(p, {deepest} - depth)").alias("prefix")).agg(F.sum("n").alias("n")))
    parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("n").alias("above"))
    buckets = written(
        levels.withColumn("up", F.expr("shiftrightunsigned(prefix, 1)")).join(parent, ["depth", "up"], "left")
        .filter(((F.col("n") <= capacity) | (F.col("depth") == deepest)) & (F.col("above").isNull() | (F.col("above") > capacity)))
        .select("depth", "prefix"), "buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = buckets.select(
        F.col("depth").alias("local_depth"),
        F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket"),
        F.explode(F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")).alias("slot"))
    return slots, depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key=None,
                 capacity: int = CAPACITY, page_rows: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the largest id stays; of rows that
    also share that id exactly one is kept, and a null id wins only among
    nulls. Null text counts as empty, and empty texts equal each other. An
    empty table gives an empty result; other columns are not looked at.
    ``key``: Column -> Column, the 64-bit hash (tests pass a poor one).
    """
    key = key or F.xxhash64
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                                  key(text).cast("long").alias("h"), F.sha2(text, 256).alias("sha")), "entries")
    keys = written(entries.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"),
        F.coalesce(F.max_by("rid", "id"), F.max("rid")).alias("keep_rid")), "keys")
    n_keys, n_rows, n_shared = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    page_rows = page_rows or max(PAGE_ROWS, n_rows // HOT_KEYS)

    slots, depth = build_directory(keys, n_keys, capacity)
    index = written(
        keys.withColumn("slot", _slot(F.col("h"), depth)).join(slots, "slot").drop("slot")
        .withColumn("pages", F.ceil(F.col("n") / page_rows).cast("int"))
        .repartition("bucket").sortWithinPartitions("bucket", "h"), "index")
    # At most HOT_KEYS (rows / page_rows) keys have several pages, so this side is safe to broadcast.
    hot = F.broadcast(index.filter("pages > 1").select("h", "pages"))

    def paged(rows: DataFrame, spread: Column) -> DataFrame:
        return (rows.join(hot, "h", "left")
                .withColumn("page", F.pmod(spread, F.coalesce("pages", F.lit(1))).cast("int")).drop("pages"))

    opened = index.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    # Owners: texts of shared keys, compared as bytes, first by page and then by key.
    shared = opened.filter("n > 1").select("h", "page", "bucket")
    texts = docs.select(key(text).cast("long").alias("h"), text.alias("t"), F.monotonically_increasing_id().alias("r"))
    texts = maybe_in(texts, index.filter("n > 1").select("h"), "h", n_shared)
    links = (paged(texts, F.xxhash64("r")).drop("r").join(shared, ["h", "page"])
             .groupBy("bucket", "h", "page", "t").agg(F.lit(1).alias("one"))
             .groupBy("bucket", "h", "t").agg(F.lit(1).alias("one")))
    chained = written(links.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("links")).filter("links > 1").select("h"), "chained")

    alike = (paged(entries.join(chained, "h", "left_anti"), F.xxhash64("rid"))
             .join(opened.select("h", "page", "n", "keep_id", "keep_rid"), ["h", "page"]))
    # A chained key: the byte comparison found several texts; each link of the chain is told apart by its digest.
    odd = entries.join(chained, "h", "left_semi")
    link = odd.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"),
                                       F.coalesce(F.max_by("rid", "id"), F.max("rid")).alias("keep_rid"))
    columns = ["id", "keep_id", "n", "rid", "keep_rid", "sha"]
    rows = alike.select(*columns).unionByName(odd.join(link, ["h", "sha"]).select(*columns))
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"),
                       (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; same columns.

    Rows are told by id. Ids that are null or occur more than once are told
    by id and text, and one row of each is kept.
    """
    found = written(exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("_ll_id"), "kept", F.col("text_sha256").alias("_ll_sha")), "groups")
    again = written(found.groupBy("_ll_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and _ll_id is not null").select("_ll_id"), "again")
    gone = found.filter("not kept and _ll_id is not null").select("_ll_id").unionByName(again).withColumnRenamed("_ll_id", id_col)
    plain = without(docs.filter(F.col(id_col).isNotNull()), gone, gone.count())
    hashed = again.select(F.xxhash64("_ll_id").alias("_ll_key"))
    repeated = maybe_in(docs.withColumn("_ll_key", F.xxhash64(id_col)), hashed, "_ll_key", again.count()).drop("_ll_key")
    repeated = repeated.join(again, repeated[id_col] == again["_ll_id"], "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    repeated = repeated.withColumn("_ll_text", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).dropDuplicates([id_col, "_ll_text"])
    stays = found.filter("kept").select("_ll_id", "_ll_sha")
    repeated = repeated.join(stays, F.col(id_col).eqNullSafe(F.col("_ll_id")) & (F.col("_ll_text") == F.col("_ll_sha")), "left_semi").drop("_ll_text")
    return plain.unionByName(repeated)
