"""Operator 10: removal of repeated word sequences with suffix trees.

Suffixes (windows of 35 words) are split by variable-length prefixes into
groups that fit a task's memory: the words that all windows of a run share
(its anchor) name the group, and where one anchor has more text than a group
holds, its runs are dealt out and the groups' windows, named by the whole
window, meet again. In a group a suffix tree is grown from the root, a word
deeper for all nodes at once; a node with one suffix is a leaf and is left.
Nodes that are still inner nodes at the window's depth are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import grams, slices, with_python, word_hashes, word_spans
from linkloom.llm.repeats import Unit, covered, find_repeats

WINDOW, GRAM = 35, 8
#: Words of a group, and of one anchor in it.
GROUP, HOT = 1 << 18, 1 << 16


def deep_nodes(window: int):
    """symbols, bounds, n -> inner node at the window's depth of every suffix, -1 for leaves."""
    def classes(words: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
        _, word = np.unique(words, return_inverse=True)
        suffix = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.full(len(suffix), -1, np.int64)
        mine = np.arange(len(suffix))  # suffixes below inner nodes, and their nodes
        node = np.zeros(len(suffix), np.int64)
        for depth in range(window):
            if not len(mine):
                return out
            edge = node * (int(word.max()) + 1) + word[suffix[mine] + depth]
            _, node, size = np.unique(edge, return_inverse=True, return_counts=True)
            inner = size[node] > 1
            mine, node = mine[inner], node[inner]
        out[mine] = node
        return out
    return classes


def word_unit(window: int = WINDOW, gram: int = GRAM, group: int = GROUP, hot: int = HOT) -> Unit:
    def read(data, offsets):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        return grams(words, gram), first, words

    return Unit(window, gram, 8, read, group, hot, deep_nodes(window), lambda words: grams(words, gram))


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: Unit | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256.

    Words lie between space and the controls from tab to carriage return; a
    word goes when a window over it also starts elsewhere, and the rest are
    joined by one space. Null has no words, and texts of fewer words than a
    window lose none; repeated rows remove each other wholly when a window
    long. Ids may be null or repeat, tables may be empty, other columns are
    not looked at. ``with_text`` adds ``kept``, the joined words.
    """
    unit = unit or word_unit()
    steps = find_repeats(docs, unit, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept binary" if with_text else "")

    def joined(marked: bool):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches, "t"):
                starts, ends, first = word_spans(data, offsets)
                stays = np.ones(len(starts), bool)
                if marked:
                    stays = ~covered(batch.column("marks"), batch.num_rows, first, len(starts), unit.window)
                # Each kept word and the byte after it (made a space), then cut by row.
                size = np.where(stays, ends - starts + 1, 0)
                total = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(starts - total[:-1], size) + np.arange(total[-1])
                flat = np.append(data, np.uint8(32))[take]
                flat[(total[1:] - 1)[stays]] = 32
                cut, whole = total[first].tolist(), flat.tobytes()
                kept = [whole[a:b - 1] if b > a else b"" for a, b in zip(cut[:-1], cut[1:])]
                gone = np.concatenate([[0], np.cumsum(~stays)])[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(first)), pa.array(np.diff(gone)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                     *([pa.array(kept, pa.binary())] if with_text else [])], [batch.schema.names[0], *names])
        return join

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k")).alias("who"), text.alias("t"))
    base = with_python(base).mapInArrow(joined(False), f"who struct<id: {kind}, k: bigint>, {schema}")
    rest = base.select(F.col("who.k").alias("k"), F.col("who.id").alias("id"), *names).join(steps.keys, "k", "left_anti").drop("k")
    out = with_python(steps.touched.select("id", "t", "marks")).mapInArrow(joined(True), f"id {kind}, {schema}")
    return rest.unionByName(out).withColumnRenamed("id", id_col)
