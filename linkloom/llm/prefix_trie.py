"""Operator 13: the trie of conversation prefixes, by van Emde Boas recursion.

A conversation is a sequence of turns; every distinct sequence of first turns
is a node. A range of depths is cut in half: the prefixes that end at the cut
are *named*, and then the upper trie and the lower forests, one below each
name, are built by the same step. All parts of one size are independent of
each other, so one job does them all, and as many jobs as the largest depth
has binary digits do the whole trie:

* upward, turns are digested in blocks of 2, 4, 8 ... turns (rows of a
  conversation and block, never whole conversations);
* downward, the prefix that ends in the middle of a range is named by the
  name at the top of the range and the digest of the block between;
* upward again, totals are grafted: the roots of the lower forests add theirs
  to the nodes above them in the upper trie of the range, whose totals within
  it are already known. A root has as many of these as half the range is deep,
  so each of the jobs moves at most as many rows as there are turns.

Names and digests are 128-bit hashes. Nothing of a node's members or children
is collected: members are counted, and the ids that end at a node are hashed
in order from pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import paged_join, release, with_python, written
from linkloom.operators.ordinal import ordinal

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one piece of a node's list.
PIECE_IDS = 4096
_NODE = ["depth", "name"]


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def rebuilt_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  *, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the rebuilt conversations.

    c takes the first h = crc32(c) % ``shared`` turns of conversation
    c - c % ``family`` (all if there are fewer, none if it is absent), then its
    own after its first h. turns: conv_id, depth (from 1), digest, words;
    lengths: conv_id, depth (0 and up), for every conversation. Equal turn
    numbers are ordered by role and a hash of the text; rows without a conv_id
    take no part.
    """
    c = F.col("conv_id")
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # From here on a turn is its digest and its words.
    rows = rows.select("conv_id", "turn", _digest(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).alias("digest"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), "role", F.xxhash64("text").alias("tie"))
    own = written(ordinal(rows, [F.col("turn").asc_nulls_first(), "role", "tie", "digest"], by=["conv_id"], name="n").select("conv_id", "n", "digest", "words"), "own-turns")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(shared))
    base = own.filter((c % family == 0) & (F.col("n") < shared)).select(c.alias("base"), "n", "digest", "words")
    held = base.groupBy("base").agg(F.max("n").alias("held"))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select("conv_id", "turns", (c - c % family).alias("base"), h.alias("h"))
    convs = written(convs.join(held, "base", "left").select("conv_id", "turns", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken")), "rebuilt")
    total = convs.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    first = convs.join(base, "base").filter("n <= h").select("conv_id", F.col("n").alias("depth"), "digest", "words")
    rest = paged_join(own.filter(F.col("n") > h), convs.select("conv_id", "turns", "h", "taken"), ["conv_id"], "turns", total, F.xxhash64("n"))
    turns = written(first.unionByName(rest.select("conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("depth"), "digest", "words")), "turns")
    lengths = written(convs.select("conv_id", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).cast("long").alias("depth")), "lengths")
    release(own, convs)
    return turns, lengths


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Digests of whole blocks of 1, 2, 4 ... turns: conv_id, block, digest."""
    out = [turns.select("conv_id", (F.col("depth") - 1).alias("block"), "digest")]
    for k in range(1, levels):
        odd = F.col("block") % 2
        pairs = out[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block").cast("long").alias("block")).agg(
            F.max(F.when(odd == 0, F.col("digest"))).alias("a"), F.max(F.when(odd == 1, F.col("digest"))).alias("b"))
        out.append(written(pairs.filter("a is not null and b is not null").select("conv_id", "block", _digest("a", "b").alias("digest")), f"blocks-{k}"))
    return out


def named_prefixes(turns: DataFrame, levels: int) -> DataFrame:
    """conv_id, depth, name of every prefix (but the empty one) of every conversation."""
    blocks = _blocks(turns, levels)
    names: DataFrame | None = None
    parts = []
    for k in reversed(range(levels)):
        size = 1 << k
        upper = blocks[k].filter("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("depth"), "digest")
        empty = F.lit(b"")
        if names is None:  # the cut of the whole: all lie below the root
            found = upper.select("conv_id", (F.col("depth") + size).alias("depth"), _digest(empty, "digest").alias("name"))
        else:
            found = upper.join(names, ["conv_id", "depth"], "left").select(
                "conv_id", (F.col("depth") + size).alias("depth"), _digest(F.coalesce("name", empty), F.col("digest")).alias("name"))
        parts.append(written(found, f"names-{k}"))
        names = parts[-1] if names is None else names.unionByName(parts[-1])
    whole = written(names, "names")
    release(*parts, *blocks[1:])
    return whole


def _grafted(nodes: DataFrame, names: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with leaves and saved summed over subtrees."""
    for k in range(levels):
        size, above = 1 << k, F.col("depth") - 1
        roots = nodes.filter((above % size == 0) & (F.shiftright(above, k) % 2 == 1)).select(
            "conv_id", F.explode(F.sequence(F.col("depth") - size, above)).alias("depth"), "leaves", "saved")
        added = roots.join(names, ["conv_id", "depth"]).groupBy(*_NODE).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        more = nodes.join(added, _NODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0))).withColumn(
            "saved", F.col("saved") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved")
        old, nodes = nodes, written(more, f"nodes-{k}")
        release(old)
    return nodes


_PIECES = pa.schema([("depth", pa.int64()), ("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("depth", pa.int64()), ("name", pa.binary()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows as comma-joined pieces of a node's ids."""
    node, ids, out = None, [], []

    def cut() -> None:
        if ids:
            out.append({"depth": node[0], "name": node[1], "first": ids[0], "ids": ",".join(map(str, ids))})
            ids.clear()

    for batch in batches:
        for depth, name, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "conv_id"))):
            if (depth, name) != node or len(ids) == PIECE_IDS:
                cut()
                node = (depth, name)
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECES)
            out.clear()
    cut()
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash a node; the state of one hash is all that is held."""
    node, state, out = None, None, []
    for batch in batches:
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids"))):
            if (depth, name) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append({"depth": node[0], "name": node[1], "ends_sha256": state.hexdigest()})
            node, state = (depth, name), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _HASHES)
            out.clear()
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"depth": node[0], "name": node[1], "ends_sha256": state.hexdigest()}], _HASHES)


def _ends(lengths: DataFrame, names: DataFrame) -> DataFrame:
    """(depth, name) with the hash of the ids of the conversations that end there, in order."""
    ends = lengths.join(names, ["conv_id", "depth"], "left").select("depth", F.coalesce("name", F.lit(b"")).alias("name"), "conv_id")
    parts = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_NODE, "conv_id"]
    pieces = with_python(ends).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, name binary, first long, ids string")
    pieces = written(pieces, "pieces")
    out = written(pieces.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hashed, "depth long, name binary, ends_sha256 string"), "ends")
    release(pieces)
    return out


def build_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth from 1, digest, words).

    ``lengths`` (conv_id, depth) has every conversation once, turnless ones
    too. Per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. No conversations: no rows.
    """
    convs, least, deepest = lengths.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("depth")).first()
    none = hashlib.sha256(b"").hexdigest()
    levels = max(1, int(deepest or 0).bit_length())
    names = named_prefixes(turns, levels)
    up = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    placed = names.join(turns.select("conv_id", "depth", "words"), ["conv_id", "depth"]).join(up, ["conv_id", "depth"], "left")
    nodes = written(placed.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
                                               F.max("parent").alias("parent")), "prefixes")
    children = nodes.filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = written(own.select(*_NODE, "conv_id", "parent", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                             ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "own-totals")
    release(nodes)
    nodes = _grafted(own, names, levels)
    ends = _ends(lengths, names)
    release(names)
    top = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = top.filter(F.lit(convs > 0)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(convs).cast("long").alias("n_convs"), "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved"))
    count = nodes.count()
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                    F.col("n_children").alias("siblings"))
    below = paged_join(nodes.filter("depth > 1"), parents, ["depth", "parent"], "siblings", count, F.xxhash64("name")).drop("siblings")
    first = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    every = below.unionByName(first).drop("parent").unionByName(root).join(ends, _NODE, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations (``rebuilt_turns``), a row for each node (``build_trie``).

    Turns are ordered by number, null first, then role and a hash of the text;
    null roles and texts are empty, repeated rows are turns of their own, rows without a
    conv_id take no part, other columns are not looked at. An empty table has
    no node, not even a root.
    """
    return build_trie(*rebuilt_turns(conversations, conv_col, turn_col, role_col, text_col))
