"""Operator 7: benchmark decontamination by seeds and Smith-Waterman.

Texts are words between white space and ASCII punctuation, lower-cased by
Spark's ``lower`` (all letters, not only A-Z). One
pass over the documents, without a shuffle of text:

1. Every word triple of an item is a *seed*, however frequent: how often a
   passage was copied says nothing about whether it is a copy. Every document
   position that holds a seed is joined to the items that have it, and hits
   of a document and an item that lie on near diagonals make a passage, wide
   enough for every alignment through a hit that could reach the score.
2. Stock phrases are told from copies by a bound, not by their count: with 1
   for a word that the item has and the cost for any other, no alignment
   scores more than the best run of a passage's words. Only the runs that
   could reach the score are kept.
3. Smith-Waterman aligns item and passage word by word, so that
   words replaced, left out or added cost a little and do not hide a copy.

Items too short for the least score are found where a document has the whole
item word for word.

The benchmark is taken in blocks of bounded size, each sent to all tasks; of
several blocks, one is used and its copies written before the next is read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import IS_SPACE, grams, mixed, row_of, slices, with_python, within_rows, word_hashes, word_spans, written

#: Words of a seed.
SEED = 3
#: What a differing, missing or added word costs; an equal one counts 1.
COST = 0.5
#: A copy's alignment score as a share of the item's words, and the least score in words.
THRESHOLD, LEAST = 0.5, 6.0
#: Seed hits, or words of passages, that a task holds at a time.
HITS = 1 << 20
#: Benchmark text of a block.
BLOCK_BYTES = 16 << 20

BREAKS = IS_SPACE.copy()
BREAKS[[ord(c) for c in string.punctuation]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, BREAKS)
    return word_hashes(data, starts, ends), first


def _of_item(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each word and the item it is looked up in."""
    return mixed(words + mixed(item.astype(np.uint64)))


class Keys:
    """A sorted set of hashes with a bitmap before it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(16, int(math.log2(len(self.keys) + 1)) + 5)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(self.keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``values`` are keys (and ``ok``), and which."""
        at = np.flatnonzero(self.map[(values & np.uint64((1 << self.bits) - 1)).astype(np.int64)] & ok)
        which = np.searchsorted(self.keys, values[at])
        which[which == len(self.keys)] = 0
        same = self.keys[which] == values[at]
        return at[same], which[same]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word-hash arrays, many pairs a step."""
    best = np.zeros(len(items), np.float32)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(passages[i])))
    at = 0
    while at < len(order):
        wide, to = len(items[order[at]]), at + 1
        while to < len(order) and len(items[order[to]]) <= 2 * wide and (to - at) * len(items[order[to]]) < 100_000:
            to += 1
        lane = order[at:to]
        m, n = max(len(items[i]) for i in lane), max(len(passages[i]) for i in lane)
        a, b = np.zeros((len(lane), m), np.uint64), np.ones((n, len(lane)), np.uint64)
        inside = np.zeros((len(lane), m), bool)
        for k, i in enumerate(lane):
            a[k, :len(items[i])], inside[k, :len(items[i])] = items[i], True
            b[:len(passages[i]), k] = passages[i]
        slope = (COST * np.arange(1, m + 1)).astype(np.float32)
        held, top = np.zeros((len(lane), m + 1), np.float32), np.zeros(len(lane), np.float32)
        for row in b:
            step = np.where((a == row[:, None]) & inside, np.float32(1), np.float32(-COST))
            now = np.maximum(np.maximum(held[:, :-1] + step, held[:, 1:] - np.float32(COST)), 0)
            now = np.maximum.accumulate(now + slope, axis=1) - slope
            held[:, 1:] = now
            np.maximum(top, now.max(1), out=top)
        best[lane] = top
        at = to
    return best


class Index:
    """A block of items: their words, and which have which seed where."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        gram, item, place = [], [], []
        for i, w in enumerate(words):
            if len(w) < LEAST:
                continue
            g = grams(w, SEED)
            gram.append(g), place.append(np.arange(len(g))), item.append(np.full(len(g), i))
        gram, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((gram, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.place = gram[order], self.item[order], self.place[order]
        self.keys = Keys(gram)
        self.bounds = np.concatenate([np.searchsorted(gram, self.keys.keys), [len(gram)]])
        self.size = np.array([len(w) for w in words] or [0])
        self.need = np.maximum(THRESHOLD * self.size, LEAST)
        self.known = np.unique(_of_item(np.repeat(np.arange(len(words)), self.size[:len(words)]), np.concatenate(words or [np.zeros(0, np.uint64)])))

        self.short = {}
        for n in range(1, math.ceil(LEAST)):
            which = np.flatnonzero(self.size == n)
            if len(which):
                gram = np.array([grams(words[i], n)[0] for i in which])
                order = np.argsort(gram, kind="stable")
                keys = Keys(gram)
                self.short[n] = keys, np.append(np.searchsorted(gram[order], keys.keys), len(gram)), which[order]

    def whole(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, item, score, from and to of the first place where a row has all words of a short item."""
        row = row_of(first, len(hashes))
        for n, (keys, bounds, items) in self.short.items():
            g = grams(hashes, n)
            if not len(g):
                continue
            at, key = keys.find(g, within_rows(first, n, len(g)))
            _, one = np.unique(row[at] * len(keys.keys) + key, return_index=True)
            at, key = at[one], key[one]
            count = bounds[key + 1] - bounds[key]
            item = items[np.repeat(bounds[key] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            at = np.repeat(at, count)
            yield row[at], item, np.full(len(at), n, np.float32), at, at + n

    def hits(self, at: np.ndarray, key: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, item and diagonal of the hits, all of a row and an item together and about ``HITS`` at a time."""
        count = self.bounds[key + 1] - self.bounds[key]
        total = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(at):
            b = int(np.searchsorted(total, total[a] + HITS, "right")) - 1
            if b < len(at):
                b = int(np.searchsorted(row, row[b])) if row[b] > row[a] else int(np.searchsorted(row, row[a], "right"))
            parts = max(1, math.ceil((total[b] - total[a]) / HITS))
            for part in range(parts):  # a row with more hits is taken by some of the items at a time
                held, c = [], a
                while c < b:
                    d = min(b, max(c + 1, int(np.searchsorted(total, total[c] + HITS, "right")) - 1))
                    n = count[c:d]
                    posting = np.repeat(self.bounds[key[c:d]] - (total[c:d] - total[c]), n) + np.arange(total[d] - total[c])
                    item, start = self.item[posting], np.repeat(at[c:d], n) - self.place[posting]
                    mine = item % parts == part
                    held.append((np.repeat(row[c:d], n)[mine], item[mine], start[mine]))
                    c = d
                yield tuple(np.concatenate(x) for x in zip(*held))
            a = b

    def runs(self, hashes: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, item, from and to of the runs of words in passages that could reach the score.

        An alignment's words in the document sum to no less than its score,
        up to each of them, so it lies in one run where the sum stays above 0.
        """
        total = np.concatenate([[0], np.cumsum(high - low)])
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
            n = (high - low)[a:b]
            of = np.repeat(np.arange(a, b), n)
            at = np.repeat(low[a:b] - (total[a:b] - total[a]), n) + np.arange(total[b] - total[a])
            name = _of_item(item[of], hashes[at])
            place = np.searchsorted(self.known, name)
            place[place == len(self.known)] = 0
            value = np.where(self.known[place] == name, 1, -COST)
            summed = np.cumsum(value)
            begin = total[a:b] - total[a]
            summed -= np.repeat((summed - value)[begin], n)
            apart = (of - a) * (4.0 * len(of) + 4)  # passages don't see each other's least sums
            least = np.minimum(np.minimum.accumulate(summed - apart) + apart, 0)
            held = summed - least
            up = held > 0
            lead = up.copy()
            lead[1:] &= ~up[:-1] | (of[1:] != of[:-1])
            run = np.cumsum(lead) - 1
            enough = np.flatnonzero(held >= self.need[item[of]])
            some, last = np.unique(run[enough][::-1], return_index=True)
            last = enough[::-1][last]
            lead = np.flatnonzero(lead)[some]
            yield row[of[lead]], item[of[lead]], at[lead], at[last] + 1
            a = b

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, score in words and passage (words from, to) of every copy."""
        hashes, first = _words(data, offsets)
        out = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int64, np.int64)), *self.whole(hashes, first)]
        g = grams(hashes, SEED)
        at = key = np.zeros(0, np.int64)
        if len(g) and len(self.keys.keys):
            at, key = self.keys.find(g, within_rows(first, SEED, len(g)))
        for row, item, start in self.hits(at, key, row_of(first, len(hashes))[at]):
            order = np.lexsort((start, item, row))
            row, item, start = row[order], item[order], start[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.size[item[1:]])
            lead = np.flatnonzero(fresh)
            last = np.append(lead[1:], len(row)) - 1
            row, item, size = row[lead], item[lead], self.size[item[lead]]
            # A copy has no more words added than the item has.
            low = np.maximum(first[row], start[lead] - size)
            high = np.minimum(first[row + 1], start[last] + 2 * size)
            for row, item, low, high in self.runs(hashes, row, item, low, high):  # noqa: B020, PLW2901
                # No copy is longer than two items: long runs are taken in windows that overlap by as much.
                size = 2 * self.size[item]
                windows = np.maximum(1, -(-(high - low) // size) - 1)
                one = np.repeat(np.arange(len(row)), windows)
                low = low[one] + size[one] * (np.arange(len(one)) - np.repeat(np.cumsum(windows) - windows, windows))
                row, item, high = row[one], item[one], np.minimum(high[one], low + 2 * size[one])
                score = align([self.words[i] for i in item], [hashes[a:b] for a, b in zip(low, high)])
                good = score >= self.need[item]
                out.append(tuple(x[good] for x in (row, item, score, low, high)))
        row, item, score, low, high = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((low, -score, item, row))  # the best passage of a document and an item
        row, item, score, low, high = (x[order] for x in (row, item, score, low, high))
        one = np.ones(len(row), bool)
        one[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[one], item[one], score[one], (low - first[row])[one], (high - first[row])[one]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, int]:
    """The items (id, t, block) and the number of blocks of ``BLOCK_BYTES``."""
    items = written(benchmark.select(F.col(item_col).alias("id"), F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("t")).distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    return items.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks))), blocks


def build_index(items: DataFrame, block: int) -> Index:
    """Seeds of the items of one block."""
    rows = items.filter(F.col("block") == block).orderBy("id", "t").collect()
    raw = [r["t"].encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    hashes, first = _words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return Index([r["id"] for r in rows], [hashes[a:b] for a, b in zip(first[:-1], first[1:])])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item of which it holds a copy.

    Columns: id, item id, score (alignment score over the item's words, at
    most 1), passage_start and passage_stop (the document's words compared).
    Null texts are empty; items of fewer than ``LEAST`` words are found where
    all their words stand together, score 1; items without words and empty
    tables give no rows. Repeated items count once, items that share an id
    but not the text are apart, and repeated documents are judged each.
    """
    id_kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"id {id_kind.simpleString()}, item {item_kind.simpleString()}, score double, passage_start long, passage_stop long"
    rows = with_python(docs).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t"))
    items, blocks = item_blocks(benchmark, item_col, item_text)

    def of_block(block: int) -> DataFrame:
        index = build_index(items, block)

        def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = None
            for batch, data, offsets in slices(batches, "t"):
                row, item, score, low, high = index.leaks(data, offsets)
                if len(row):
                    ids = pa.array(index.ids, from_spark(item_kind)) if ids is None else ids
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), ids.take(pa.array(item)), pa.array(np.round(score.astype(np.float64) / index.size[item], 4)), pa.array(low), pa.array(high)],
                        ["id", "item", "score", "passage_start", "passage_stop"])

        found = rows.mapInArrow(leaks, schema)
        return found if blocks == 1 else written(found, "leaks")

    return reduce(DataFrame.unionByName, map(of_block, range(blocks))).withColumnsRenamed({"id": id_col, "item": item_col})


def from_spark(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, all columns as they are."""
    schema, names, lowered = docs.schema, docs.columns, "_lower_" + "_".join(docs.columns)
    items, blocks = item_blocks(benchmark, item_col, item_text)
    texts = with_python(docs).withColumn(lowered, F.lower(F.col(text_col)))
    if blocks == 1:
        index = build_index(items, 0)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches, lowered):
                keep = np.ones(batch.num_rows, bool)
                keep[index.leaks(data, offsets)[0]] = False
                yield batch.filter(pa.array(keep)).select(names)

        return texts.mapInArrow(clean, schema)

    # Whether a row stays rests on its text alone, so texts are told by a digest.
    def of_block(block: int) -> DataFrame:
        index = build_index(items, block)

        def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches, "t"):
                yield batch.select(["digest"]).take(pa.array(np.unique(index.leaks(data, offsets)[0])))

        return written(texts.select(F.md5(lowered).alias("digest"), F.col(lowered).alias("t")).mapInArrow(leaks, "digest string"), "leaks")

    gone = reduce(DataFrame.unionByName, map(of_block, range(blocks))).distinct().withColumnRenamed("digest", lowered)
    return texts.withColumn(lowered, F.md5(lowered)).join(gone, lowered, "left_anti").drop(lowered)
