"""Repeated windows over a whole corpus: what operators 3 and 10 share.

A ``Unit`` says what a symbol is and how groups of windows are searched. The
steps: every document's runs (anchors.py); runs that repeat wholly, by
counting; of the others one run of each content goes, with its symbols, to a
group small enough for one task, where the unit finds equal windows; then
the marks are gathered by document and the marked symbols removed. Text
moves in one shuffle, and that of touched documents in a second.

Documents are known by a hash of id and text, so that rows which repeat
both, or have no id, are treated alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.anchors import _power, window_runs
from linkloom.llm.common import mixed, paged_join, slices, with_python, written


@dataclass
class Unit:
    """What the steps need to know of a symbol."""

    window: int
    gram: int
    #: Bytes that a symbol takes in a group.
    width: int
    #: data, offsets -> hash at each gram place, each row's first symbol, the symbols
    read: object
    #: Symbols of a group, and of one anchor before its windows are dealt out further.
    group: int
    hot: int
    #: symbols end to end, snippet bounds, windows of each -> class of every window (-1: alone)
    classes: object
    #: symbols -> hash at each gram place
    grams: object


@dataclass
class Steps:
    """The tables of one search, for the operators' last steps."""

    touched: DataFrame  # k, id, text, marks
    keys: DataFrame  # k of touched documents


def _runs(unit: Unit):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "t"):
            grams, first, _ = unit.read(data, offsets)
            row, anchor, content, low, n = window_runs(grams, first, unit.window, unit.gram)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                                              pa.array(low.astype(np.int64)), pa.array(n.astype(np.int32))], ["k", "anchor", "content", "low", "n"])
    return runs


def _snippets(unit: Unit):
    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "t"):
            _, first, symbols = unit.read(data, offsets)
            need = batch.column("need")
            count = np.diff(need.offsets.to_numpy())
            flat = need.flatten()
            row = np.repeat(np.arange(batch.num_rows), count)
            low, n = flat.field("low").to_numpy(), flat.field("n").to_numpy()
            lo = first[row] + low
            raw = symbols.tobytes()
            w = symbols.itemsize
            bodies = [raw[a * w:b * w] for a, b in zip(lo.tolist(), (lo + n + unit.window - 1).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row)), flat.field("low"), flat.field("n"), flat.field("anchor"),
                                              flat.field("grp"), flat.field("hot"), pa.array(bodies, pa.binary())], ["k", "low", "n", "anchor", "grp", "hot", "body"])
    return snippets


def stretches(windows: np.ndarray, snippet: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked windows (bool over all, by snippet and place) as snippet, first place, length."""
    at = np.flatnonzero(windows)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (snippet[at[1:]] != snippet[at[:-1]])
    lead = np.flatnonzero(new)
    return snippet[at[lead]], place[at[lead]], np.diff(np.append(lead, len(at)))


def _search(unit: Unit, slots: int):
    """Equal windows of a group; of hot anchors also the windows that other groups must know of."""
    def search(table: pa.Table) -> pa.Table:
        bodies, n = table.column("body").combine_chunks(), table.column("n").to_numpy()
        k, low, anchor, hot = (table.column(c).to_numpy() for c in ("k", "low", "anchor", "hot"))
        bounds = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset:bodies.offset + len(bodies) + 1].astype(np.int64)
        raw = np.frombuffer(bodies.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        symbols = raw if unit.width == 1 else np.frombuffer(raw.tobytes(), "<u8")
        bounds = (bounds - bounds[0]) // unit.width
        snippet = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(snippet)) - np.repeat(np.cumsum(n) - n, n)
        kind = unit.classes(symbols, bounds, n)
        s, p, length = stretches(kind >= 0, snippet, place)
        out = {"k": k[s], "low": low[s] + p, "n": length.astype(np.int64)}
        packed: dict[str, list] = {c: [] for c in ("slot", "fingers", "keys", "lows", "alone")}
        if hot.any():
            # One window of each class, and every window that is alone here, as arrays for each slot.
            grams = unit.grams(symbols)
            at = np.flatnonzero(hot[snippet])
            mine = kind[at]
            lead = np.zeros(len(at), bool)
            lead[np.unique(mine, return_index=True)[1]] = True
            at = at[lead | (mine < 0)]
            finger = mixed(_fingers(grams, bounds[snippet[at]] + place[at], unit.window - unit.gram + 1) ^ anchor[snippet[at]].view(np.uint64))
            slot = ((finger >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            at, finger, slot = at[order], finger[order], slot[order]
            some, first = np.unique(slot, return_index=True)
            for x, a, b in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                own = at[a:b]
                for c, v in zip(packed, (x, finger[a:b].tobytes(), k[snippet[own]].tobytes(), (low[snippet[own]] + place[own]).tobytes(), (kind[own] < 0).tobytes())):
                    packed[c].append(v)
        marks, more = len(s), len(packed["slot"])
        columns = [pa.array(np.concatenate([v, np.zeros(more, np.int64)])) for v in out.values()]
        columns += [pa.array([None] * marks + packed[c], pa.int32() if c == "slot" else pa.binary()) for c in packed]
        return pa.table(columns, names=[*out, *packed])
    return search


def _fingers(grams: np.ndarray, start: np.ndarray, wide: int) -> np.ndarray:
    """A hash of the ``wide`` grams from each start."""
    up, down = _power(len(grams) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * up[:len(grams)])])
    return mixed((total[start + wide] - total[start]) * down[start])


def _merge(table: pa.Table) -> pa.Table:
    """Windows of hot anchors that were alone in their group, but not over all groups.

    A window is looked up by binary search in the sorted windows of all groups.
    """
    finger, k, low, alone = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
                             for c, t in (("fingers", np.uint64), ("keys", np.int64), ("lows", np.int64), ("alone", bool)))
    every = np.sort(finger)
    twice = (np.searchsorted(every, finger, "right") - np.searchsorted(every, finger, "left") > 1) & alone
    return pa.table([pa.array(k[twice]), pa.array(low[twice]), pa.array(np.ones(twice.sum(), np.int64))], names=["k", "low", "n"])


def find_repeats(docs: DataFrame, unit: Unit, id_col: str, text_col: str) -> Steps:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id"), text.alias("t"))
    runs = written(with_python(named.select("k", "t")).mapInArrow(_runs(unit), "k long, anchor long, content long, low long, n int"), "runs")
    total = runs.count()
    # Contents with their counts, and one place that has each (a text may hold one many times); anchors that occur twice.
    contents = written(runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("one"), F.min_by("low", "k").alias("there"),
                                                                F.max("n").alias("n0")), "contents")
    anchors = (contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("c"), F.sum(F.col("n0") + unit.window - 1).alias("symbols"))
               .filter("c > 1"))
    anchors = written(anchors.select("anchor", "d", F.when(F.col("d") > 1, F.col("symbols")).otherwise(0).alias("symbols")), "anchors")
    load = anchors.agg(F.sum("symbols")).first()[0] or 0
    groups = max(1, math.ceil(load / unit.group))
    known = paged_join(contents, anchors, ["anchor"], "d", total, F.xxhash64("content"))
    # A hot anchor's contents are dealt to several groups, a group's worth of symbols each.
    parts = F.ceil(F.col("symbols") / unit.hot)
    known = known.select("anchor", "content", "c", "one", "there", (F.col("c") > 1).alias("whole"), (F.col("d") > 1).alias("several"), (parts > 1).alias("hot"),
                         F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("content"), F.greatest(parts, F.lit(1)))), F.lit(groups)).cast("int").alias("grp"))
    known = written(known.filter("whole or several"), "known")
    found = paged_join(runs, known, ["anchor", "content"], "c", total, F.xxhash64("k", "low"))
    found = written(found.select("k", "low", "n", "anchor", "whole", "hot", "grp", (F.col("several") & (F.col("k") == F.col("one")) & (F.col("low") == F.col("there"))).alias("need")).distinct(), "found")
    lists = found.filter("whole or need").groupBy("k").agg(
        F.collect_list(F.when(F.col("need"), F.struct("low", "n", "anchor", "grp", "hot"))).alias("need"))
    touched = written(named.join(lists, "k"), "touched")

    snippets = with_python(touched.filter(F.size("need") > 0).select("k", "t", "need")).mapInArrow(
        _snippets(unit), "k long, low long, n int, anchor long, grp int, hot boolean, body binary")
    # Windows of hot anchors meet those of the anchor's other groups, in slots by their hash.
    heavy = anchors.agg(F.sum(F.when(F.col("symbols") > unit.hot, F.col("symbols")))).first()[0] or 0
    slots = max(1, math.ceil(heavy * 8 / (1 << 20)))
    searched = written(snippets.groupBy("grp").applyInArrow(
        _search(unit, slots), "k long, low long, n long, slot int, fingers binary, keys binary, lows binary, alone binary"), "searched")
    merged = searched.filter("slot is not null").groupBy("slot").applyInArrow(_merge, "k long, low long, n long")
    marks = (found.filter("whole").select("k", "low", F.col("n").cast("long").alias("n"))
             .unionByName(searched.filter("slot is null").select("k", "low", "n")).unionByName(merged))
    marks = marks.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("low", "n"))).alias("marks"))
    return Steps(touched.select("k", "id", "t").join(marks, "k", "left"), touched.select("k").distinct())


def covered(marks, rows: int, first: np.ndarray, size: int, window: int) -> np.ndarray:
    """Which symbols of a slice the rows' marked windows cover."""
    delta = np.zeros(size + 1, np.int32)
    count = np.diff(marks.offsets.to_numpy())
    flat = marks.flatten()
    row = np.repeat(np.arange(rows), count)
    lo = first[row] + flat.field("low").to_numpy()
    np.add.at(delta, lo, 1)
    np.add.at(delta, lo + flat.field("n").to_numpy() - 1 + window, -1)
    return np.cumsum(delta[:size]) > 0
