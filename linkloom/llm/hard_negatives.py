"""Operator 11: hard negatives by coordinate pruning in length buckets.

Vectors are sorted into buckets by length (Euclidean norm), and a bucket into
blocks of bounded size. A block has, for each coordinate, the list of its
vectors sorted by the coordinate of the vector at length one. An anchor asks a
block for vectors with an inner product of at least t. With |q| and the
largest length of the bucket that is a least cosine; a bucket where it is over
1 is left out. Elsewhere it bounds the angle to the anchor, and so the range
in which each coordinate of a vector must lie. The coordinates with the
narrowest ranges are the anchor's *focus*; their ranges are cut out of the
sorted lists, and only vectors in all of them get an exact inner product.

Thresholds come from the block of the longest vectors: the k-th best score
there, or the ask's own lower limit. They only leave out what cannot be among
the first k, so the answer is whole however little they prune.

Anchors are a stated query set (every hundredth row). They meet the blocks in
tiles: a tile holds at most ``BLOCK_ROWS`` rows and ``TILE_ANCHORS`` anchors,
and hands on at most k rows for each ask.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import release, with_python, written

#: Rows of a block, anchors of a tile, length buckets and focus coordinates at most.
BLOCK_ROWS, TILE_ANCHORS, BUCKETS, FOCUS = 32_768, 8_192, 64, 4
#: Slack of bounds in floating point: they may only let in more.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    size, flat = pc.list_value_length(column).to_numpy(), pc.list_flatten(column).to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Which number type gives exact inner products of the two."""
    if not rows.size or not query.size:
        return np.float64
    most = int(np.abs(rows).max()) * int(np.abs(query).max()) * rows.shape[1]
    if most >= 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


class Block:
    """A block's vectors, and their coordinates at length one in sorted lists (made when first asked for)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows.astype(np.float64)
        self.length = np.sqrt((self.rows ** 2).sum(1))
        self.longest = float(self.length.max(initial=0.0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.found = np.zeros(len(ids), np.uint8)

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            unit = np.divide(self.rows[:, f], self.length, out=np.zeros(len(self.length)), where=self.length > 0)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = unit[order], order
        return self.lists[f]

    def candidates(self, query: np.ndarray, least: int | None) -> np.ndarray | None:
        """Rows that may have an inner product of ``least`` or more with ``query``; None: all may."""
        if least is None or least <= 0:
            return None
        length = math.sqrt(float((query.astype(np.float64) ** 2).sum()))
        if length * self.longest * (1 + SLACK) < least:
            return np.zeros(0, np.int64)
        angle = math.acos(min(1.0, least / (length * self.longest) * (1 - SLACK)))
        own = np.arccos(np.clip(query / length, -1.0, 1.0))
        low, high = np.cos(np.minimum(math.pi, own + angle)) - SLACK, np.cos(np.maximum(0.0, own - angle)) + SLACK
        cuts = []
        for f in np.argsort(high - low, kind="stable")[:FOCUS].tolist():
            values, order = self.sorted_list(f)
            cuts.append(order[np.searchsorted(values, low[f]):np.searchsorted(values, high[f], "right")])
        cuts = [c for c in cuts if len(c) < len(self.ids)]
        if not cuts:
            return None
        self.found[:] = 0
        for c in cuts:
            self.found[c] += 1
        return np.flatnonzero(self.found == len(cuts))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


_ASKS = "key long, ask int, vec_id long, score long"


def _answer(same: bool, k: int):
    """Rows of a block that are among its first k for an anchor's ask: of the same or another label, in the ask's limits."""
    def answer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if rows.num_rows and asks.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (rows, asks))
            held, queries = _matrix(rows.column("v"), width), _matrix(asks.column("v"), width)
            exact = _exact(held, queries)
            block = Block(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), held)
            whole = held.astype(exact)
            for key, own, label, limits, query in zip(asks.column("key").to_pylist(), asks.column("vec_id").to_pylist(), asks.column("label").to_pylist(),
                                                      asks.column("limits").to_pylist(), queries):
                lows = [x["low"] for x in limits]
                at = block.candidates(query, None if None in lows else min(lows))
                fits = (block.labels == label) == same if at is None else (block.labels[at] == label) == same
                at = np.flatnonzero(fits) if at is None else at[fits]
                at = at[block.ids[at] != own]
                if not len(at):
                    continue
                score = (whole @ query.astype(exact) if len(at) > len(block.ids) // 2 else whole[at] @ query.astype(exact)).astype(np.int64)
                score = score[at] if len(score) != len(at) else score
                for x in limits:
                    there = np.ones(len(at), bool)
                    if x["low"] is not None:
                        there &= score >= x["low"]
                    if x["high"] is not None:
                        there &= score <= x["high"]
                    ids, some = block.ids[at[there]], score[there]
                    best = _first(some, ids, k)
                    out.append((np.full(len(best), key), np.full(len(best), x["ask"]), ids[best], some[best]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32)), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                        names=["key", "ask", "vec_id", "score"])
    return answer


class _Buckets:
    """The rows in blocks, and which buckets an anchor has to ask."""

    def __init__(self, vectors: DataFrame, block_rows: int, tile_anchors: int):
        total, anchors = vectors.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
        size = min(block_rows, max(256, math.ceil(total / (2 * vectors.sparkSession.sparkContext.defaultParallelism))))
        buckets = max(1, min(BUCKETS, total // size))
        edges = vectors.approxQuantile("length", [i / buckets for i in range(1, buckets)], 0.5 / buckets) if buckets > 1 else []
        # Bucket 0 has the longest vectors; at most BUCKETS numbers for each list below.
        bucket = sum((F.when(F.col("length") <= e, 1).otherwise(0) for e in edges), F.lit(0))
        sized = vectors.withColumn("bucket", bucket.cast("int"))
        found = {r["bucket"]: r for r in sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}
        self.blocks = [math.ceil(found[b]["n"] / size) if b in found else 0 for b in range(buckets)]
        self.longest = [found[b]["longest"] if b in found else 0.0 for b in range(buckets)]
        self.first = min(found, default=0)
        self.groups = max(1, math.ceil(anchors / tile_anchors))
        blocks = F.element_at(F.array(*map(F.lit, self.blocks)), F.col("bucket") + 1)
        self.rows = written(sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(blocks, F.lit(1))).cast("int")), "blocks")

    def first_of(self, asks: DataFrame, same: bool, k: int, only_longest: bool = False) -> DataFrame:
        """(key, ask, vec_id, score, rank): the first k rows for every ask of ``asks`` (key, vec_id, label, v, length, limits)."""
        tile = F.pmod(F.xxhash64("key"), F.lit(self.groups)).cast("int").alias("tile")
        rows = self.rows.select("bucket", "block", "vec_id", "label", "v")
        if only_longest:
            asked = asks.select("*", F.lit(self.first).alias("bucket"), F.lit(0).alias("block"), tile)
            rows = rows.filter((F.col("bucket") == self.first) & (F.col("block") == 0))
        else:
            # Buckets whose longest vector is too short for the least that is asked for are left out.
            least = F.array_min(F.transform("limits", lambda x: F.coalesce(x["low"].cast("double"), F.lit(float("-inf")))))
            near = F.filter(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("blocks"), F.lit(float(x)).alias("longest"))
                                      for b, (n, x) in enumerate(zip(self.blocks, self.longest)) if n]),
                            lambda x: (least <= 0) | (x["longest"] * F.col("length") * (1 + SLACK) >= least)) if any(self.blocks) else F.array().cast("array<struct<bucket:int,blocks:int,longest:double>>")
            asked = asks.select("*", tile, F.explode(near).alias("near")).select("*", F.col("near.bucket").alias("bucket"),
                                                                               F.explode(F.sequence(F.lit(0), F.col("near.blocks") - 1)).alias("block"))
        place = ["bucket", "block", "tile"]
        asked = asked.select(*place, "key", "vec_id", "label", "v", "limits")
        rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        found = rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(_answer(same, k), _ASKS)
        rank = F.row_number().over(Window.partitionBy("key", "ask").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", *, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, anchor_step: int = 100, block_rows: int = BLOCK_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(256 * x). Anchors are rows whose id is
    divisible by ``anchor_step``; their positives the first rows of their
    label, their negatives for each positive the first of other labels with
    low * p <= 100 * n <= high * p; higher scores first, then smaller ids.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part. Shorter vectors count as ending in zeros, empty
    ones score 0 with all. Repeated rows are one; rows that share an id but
    not their content are rows of their own, but never each other's positives
    or negatives. Too few rows, an empty table: what there is. Scores beyond
    64 bits raise an error. Other columns are not looked at.
    """
    finite = F.forall(F.col("_v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("_v"))
    taken = taken.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull() & F.coalesce(finite, F.lit(False)))
    taken = with_python(taken).select("vec_id", "label", F.transform("_v", lambda x: F.floor(x * 256)).alias("v")).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    table = written(taken.select("*", F.sqrt(square).alias("length"), F.xxhash64("vec_id", "label", "v").alias("key"), (F.col("vec_id") % anchor_step == 0).alias("anchor")), "vectors")
    held = _Buckets(table, block_rows, tile_anchors)
    anchors = table.filter("anchor").select("key", "vec_id", "label", "v", "length")
    limit = "array<struct<ask:int,low:bigint,high:bigint>>"

    def limited(asks: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
        """``asks`` with the k-th best score of ``bounds`` as the lower limit of each ask that has one."""
        least = bounds.filter(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("least"))
        raised = F.transform("limits", lambda x: F.struct(x["ask"].alias("ask"), F.greatest(x["low"], F.element_at("least", x["ask"])).alias("low"), x["high"].alias("high")))
        return asks.join(least, "key", "left").withColumn("limits", F.when(F.col("least").isNull(), F.col("limits")).otherwise(raised)).drop("least")

    asks = anchors.withColumn("limits", F.array(F.struct(F.lit(0).alias("ask"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))).cast(limit))
    seeds = written(held.first_of(asks, True, positives, only_longest=True), "seeds")
    chosen = written(held.first_of(limited(asks, seeds, positives), True, positives), "positives")
    # An ask for each positive's score; at most ``positives`` of an anchor, one of equal scores.
    scores = chosen.groupBy("key").agg(F.array_sort(F.collect_set("score")).alias("p"))
    floor = lambda x, part: F.floor(x.cast("decimal(38,0)") * part / 100).cast("long")
    limits = F.transform("p", lambda x, i: F.struct(i.cast("int").alias("ask"), (-floor(-x, low)).alias("low"), floor(x, high).alias("high")))
    asks = written(anchors.join(scores, "key").withColumn("limits", limits.cast(limit)), "asks")
    more = written(held.first_of(asks.drop("p"), False, negatives, only_longest=True), "seeds")
    found = written(held.first_of(limited(asks.drop("p"), more, negatives), False, negatives), "negatives")
    release(seeds, more, held.rows)
    named = asks.select("key", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("ask", "score"))
    named = named.join(chosen.select("key", F.col("vec_id").alias("positive_id"), "score"), ["key", "score"])
    return named.join(found.select("key", "ask", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["key", "ask"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
