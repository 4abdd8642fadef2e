"""Operator 3: removal of repeated byte strings with suffix arrays.

Candidate stretches of text (anchors.py) are dealt to shards so that equal
400-byte windows meet. A shard's suffixes are sorted in numpy by
Larsson-Sadakane refinement: sorted by 4 bytes, then by doubled depth using
the ranks so far, only groups that are still tied being sorted again. Kasai's
walk gives the common prefix of each window with its predecessor, taking all
stretches a step at a time. Windows whose common prefix reaches 400 bytes are
repeats. An anchor with more text than a shard takes several shards; these
are merged by binary search in their sorted windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.anchors import byte_grams
from linkloom.llm.common import slices, with_python
from linkloom.llm.repeats import Unit, covered, find_repeats, stretches

WINDOW, GRAM = 400, 32
#: Bytes of a shard, and of one anchor in it.
SHARD, HOT = 1 << 20, 1 << 19


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by ``depth`` symbols at least, and each suffix's rank (equal for ties).

    ``symbols``: small integers; the end sorts before all of them.
    """
    n = len(symbols)
    bits = max(1, int(n).bit_length())
    wide = max(1, int(symbols.max(initial=0) + 1).bit_length())
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = symbols + np.int64(1)
    take = min(4, (63 - bits) // wide)
    key = np.zeros(n, np.int64)
    for j in range(take):
        key = (key << wide) | padded[j:j + n]
    packed = np.sort((key << bits) | np.arange(n))
    sa, key = packed & ((1 << bits) - 1), packed >> bits
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    h = take
    while h < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slot = np.flatnonzero(~alone)  # places of groups that are still tied
        if not len(slot):
            break
        i = sa[slot]
        group = rank[i]
        after = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        if 3 * bits <= 63:
            packed = np.sort((((group << bits) | after) << bits) | i)
            i, key = packed & ((1 << bits) - 1), packed >> bits
        else:
            order = np.lexsort((after, group))
            i, key = i[order], (group[order] << 32) | after[order]
        first = np.ones(len(i), bool)
        first[1:] = key[1:] != key[:-1]
        sa[slot] = i
        rank[i] = np.maximum.accumulate(np.where(first, slot, 0))
        new[slot] = first
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, bounds: np.ndarray, starts: np.ndarray, n: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefixes (at most ``cap``) of suffixes with their predecessors.

    ``starts``, ``n``: where stretches begin and how many suffixes of each
    are asked for; one lane each, all lanes moving on together. A suffix
    tied with its predecessor beyond the sorted depth shares ``cap``; a
    lane's bound is carried on between suffixes that are not.
    """
    size = len(sa)
    place = np.empty(size, np.int64)
    place[sa] = np.arange(size)
    end = np.repeat(bounds[1:], np.diff(bounds))  # of the stretch in which a position lies
    words = np.arange(0, 64, 8)  # compared together
    padded = np.zeros(size + cap + 128, np.uint8)
    padded[:size] = data
    eights = np.ndarray((size + cap + 120,), "<u8", padded, strides=(1,))
    offset = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int32)
    lane = np.argsort(-n, kind="stable")
    held, carried = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    for step in range(int(n.max(initial=0))):
        lane = lane[:np.searchsorted(-n[lane], -step, "left")]
        i = starts[lane] + step
        at = place[i]
        tied = rank[i] != at  # not the first of a group: equal to its predecessor beyond cap
        h = np.where(carried[lane], np.maximum(held[lane] - 1, 0), 0)
        h[tied] = cap
        live = np.flatnonzero(~tied & (at > 0))
        before = np.where(at > 0, sa[np.maximum(at - 1, 0)], 0)
        room = np.minimum(np.minimum(end[i] - i, end[before] - before), cap)
        while len(live):
            differ = eights[(i[live] + h[live])[:, None] + words] ^ eights[(before[live] + h[live])[:, None] + words]
            some = differ != 0
            word = some.argmax(1)
            first = differ[np.arange(len(live)), word]
            found = first != 0
            lowest = first[found] & (~first[found] + np.uint64(1))
            step_by = np.full(len(live), 8 * len(words), np.int64)
            step_by[found] = 8 * word[found] + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
            h[live] += step_by
            live = live[~found & (h[live] < room[live])]
        h = np.where(tied, cap, np.minimum(h, room))
        h[(at == 0) & ~tied] = 0
        out[offset[lane] + step] = h
        held[lane], carried[lane] = h, ~tied
    return out


def equal_windows(window: int):
    """symbols, bounds, n -> class of every window, -1 for those that are alone."""
    def classes(data: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
        # A sign of its own ends each stretch, so no window reaches over.
        marked = np.empty(len(data) + len(n), np.uint16)
        shift = np.arange(len(n))
        marked[np.arange(len(data)) + np.repeat(shift, np.diff(bounds))] = data.astype(np.uint16) + 1
        marked[bounds[1:] + shift] = 0
        ends = bounds + np.arange(len(n) + 1)
        sa, rank = suffix_array(marked, window)
        plain = (marked - 1).astype(np.uint8)
        prefix = common_prefixes(plain, sa, rank, ends, ends[:-1], n.astype(np.int64), window)
        at = np.repeat(ends[:-1], n) + np.arange(len(prefix)) - np.repeat(np.cumsum(n) - n, n)
        place = np.empty(len(sa), np.int64)
        place[sa] = np.arange(len(sa))
        where = place[at]
        order = np.argsort(where)
        joined = (prefix[order] >= window)
        label = np.cumsum(~joined)
        size = np.bincount(label)
        out = np.empty(len(prefix), np.int64)
        out[order] = np.where(size[label] > 1, label, -1)
        return out
    return classes


def byte_unit(window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> Unit:
    def read(data, offsets):
        return byte_grams(data, gram), offsets, data

    return Unit(window, gram, 1, read, shard, hot, equal_windows(window), lambda data: byte_grams(data, gram))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: Unit | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty; a byte goes when a window over it
    also starts elsewhere. Texts shorter than a window, and empty tables,
    lose nothing; repeated rows remove each other wholly when a window long.
    Ids may be null or repeat, other columns are not looked at.
    ``with_text`` adds ``kept``, the remaining bytes.
    """
    unit = unit or byte_unit()
    steps = find_repeats(docs, unit, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = (docs.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
                        *([F.to_binary(text, F.lit("utf-8")).alias("kept")] if with_text else []))
            .join(steps.keys, "k", "left_anti").drop("k"))
    kind = docs.schema[id_col].dataType.simpleString()

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "t"):
            gone = covered(batch.column("marks"), batch.num_rows, offsets, len(data), unit.window)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            place = np.arange(len(data))
            spans = np.bincount(stretches(gone, row, place)[0], minlength=batch.num_rows)
            left = np.bincount(row[gone], minlength=batch.num_rows)
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets)), pa.array(left), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                 *([pa.array(kept, pa.binary())] if with_text else [])],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    out = with_python(steps.touched).mapInArrow(removed, rest.schema)
    return rest.unionByName(out).withColumnRenamed("id", id_col)
