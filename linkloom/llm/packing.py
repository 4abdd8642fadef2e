"""Operator 4: best-fit packing of tokenised documents, bulk-synchronously.

Documents become pieces of at most ``capacity`` tokens. Pieces are sorted by
length in ranges (every partition numbers its own pieces of each length, and
running totals over the partitions make these global ranks), longest first.
In a round all pieces of a length look for the successor of that length
among the gaps of open sequences: the smallest gap that holds them. Where
more pieces want a gap size than there are such gaps, rank decides: the
first ranks get them, in order, the others sweep on to the next size, and
when none is left they open sequences. Gaps are updated in bulk and the next
length follows. So the result is that of best-fit-decreasing.

Gaps of one size are interchangeable, and so are pieces of one length;
rounds therefore move *runs* (ranks lo..hi of a length to sequences s..t, at
one offset), of which there are as many as the lengths and gap sizes make,
not the rows. Only the histogram of at most ``capacity`` lengths reaches the
driver; every partition then finds its pieces' runs by binary search.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import IS_SPACE, kept, slices, with_python, written

CAPACITY, END = 4096, 1
#: Entries of a worker's memory of encoded words.
REMEMBERED = 500_000

_LETTERS = re.compile("[a-zà-öø-ÿ]+")


def _bytes(*parts: int | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for x in parts:
        out[x] = True
    return out


#: Bytes that a text of plain Latin words (ASCII and À to ÿ but × and ÷, where continuation bytes follow 0xC3) doesn't hold.
_OTHER = _bytes(*range(0x09), *range(0x0E, 0x20), 0x7F, 0x97, 0xB7, *range(0xC0, 0xC3), *range(0xC4, 0x100))
_CAPITAL = _bytes(*range(ord("A"), ord("Z") + 1), *range(0x80, 0x9F))
_LETTER = _CAPITAL | _bytes(*range(ord("a"), ord("z") + 1), *range(0x9F, 0x100))
_SIGN = _bytes(*(ord(c) for c in string.punctuation))
_LOWERED = np.arange(256, dtype=np.uint8) + np.uint8(32) * _CAPITAL
_ASCII_LETTER = _LETTER & (np.arange(256) < 0x80)


def _other_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold other signs, contractions or marks of special tokens."""
    at = [np.flatnonzero(_OTHER[data])]
    for first, second in (("'", _ASCII_LETTER), ("<", _bytes(ord("|")))):
        here = np.flatnonzero(data[:-1] == ord(first))
        at.append(here[second[data[here + 1]]])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
    return out


class Words:
    """Token ids of texts, remembering words.

    White space always parts tokens and is dropped, so a text's ids are its
    words' ids in order; a word is encoded when first met. Texts of plain
    Latin words are lower-cased and their letters parted from the signs that
    follow beforehand, as the tokenizer does, which leaves fewer words. The
    words of many texts are cut and made distinct as arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges for words that need no more than being parted at spaces.
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        rest = list(set(new) - set(letters)) if len(letters) < len(new) else []
        for at in range(0, len(letters), 512):
            some = letters[at:at + 512]
            found = self.lean.encode(" ".join(some), add_special_tokens=False)
            ids, word = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
            cuts = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:
                self.words.update(zip([w.encode() for w in some], [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                rest += some
        self.words.update(zip([w.encode() for w in rest], self.encode(rest)))

    def ids(self, data: np.ndarray, offsets: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of bytes, end to end, and the rows' bounds."""
        ink = ~IS_SPACE[data]
        first = ink.copy()
        first[1:] &= ~(ink[:-1] & ~(_LETTER[data[:-1]] & _SIGN[data[1:]])) if plain else ~ink[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = ink[begins]
        starts = np.flatnonzero(first)
        body = (_LOWERED[data] if plain else data)[ink]
        bounds = np.append((np.cumsum(ink) - 1)[starts], len(body)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)]).dictionary_encode()
        distinct, word = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        found = list(map(self.words.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self.learn([distinct[i].decode() for i in new])
        for i in new:
            found[i] = self.words[distinct[i]]
        if len(self.words) > REMEMBERED:  # words met first are mostly the frequent ones
            for w in list(self.words)[REMEMBERED // 2:]:
                del self.words[w]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[word]
        ends = np.append(0, np.cumsum(n))
        out = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(starts, offsets)]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each row of UTF-8 bytes as little-endian 32-bit numbers."""
        other = _other_rows(data, offsets)
        out = [b""] * len(other)
        for plain in (True, False):
            row = np.flatnonzero(other != plain)
            if len(row):
                n = np.diff(offsets)[row]
                some = data if len(row) == len(other) else data[np.repeat(other != plain, np.diff(offsets))]
                ids, bounds = self.ids(some, np.append(0, np.cumsum(n)), plain)
                raw, bounds = ids.tobytes(), (4 * bounds).tolist()
                for i, a, b in zip(row.tolist(), bounds, bounds[1:]):
                    out[i] = raw[a:b]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        raw = [t.encode() for t in texts]
        return self.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32, part and nth.

    ``nth`` counts the pieces of that length in partition ``part``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(path, lambda: Words(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch, data, offsets in slices(batches, "_text"):
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in enumerate(words.rows(data, offsets)):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[s:s + 4 * capacity]
                    n = len(own) // 4
                    row.append(i), piece.append(k), start.append(s // 4), length.append(n)
                    crc.append(zlib.crc32(own)), nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = with_python(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rounds of best fit over the pieces' lengths; runs by length and first rank.

    A run puts ranks ``rank .. rank + n`` of ``length`` into the sequences
    ``sequence .. sequence + n``, at ``offset``.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # gap size -> (first sequence, sequences)
    sizes: list[int] = []  # of the gaps that there are, in order
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and not gaps[gap]:
            bisect.insort(sizes, gap)
        if gap:
            last = gaps[gap][-1] if gaps[gap] else (0, 0)
            if last[1] and sum(last) == first:
                gaps[gap][-1] = (last[0], last[1] + n)
            else:
                gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                fresh = -(-left // (capacity // length))
                put(capacity, opened, fresh)
                opened += fresh
                continue
            gap = sizes[at]
            taken = []
            while left and gaps[gap]:
                first, n = gaps[gap].popleft()
                if n > left:
                    gaps[gap].appendleft((first + left, n - left))
                    n = left
                runs.append((length, rank, n, first, capacity - gap))
                taken.append((first, n))
                rank, left = rank + n, left - n
            if not gaps[gap]:
                sizes.remove(gap)
            for first, n in taken:
                put(gap - length, first, n)
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "n", "sequence", "offset"), table.T))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with id 1, so null and empty texts are one piece of
    that token; only documents longer than ``capacity`` are cut. Ids may be
    null or repeat; an empty table gives no rows, other columns are not
    looked at. ``path``: the tokenizer's file.
    """
    pieces = written(token_pieces(docs, path, id_col, text_col, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` lengths.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = docs.sparkSession.sparkContext.broadcast(best_fit_runs(counts, capacity))
    kind = docs.schema[id_col].dataType.simpleString()
    wide = np.int64(1) << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        keys = r["length"] * wide + r["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(r["sequence"][at] + rank - r["rank"][at]), pa.array(r["offset"][at])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = with_python(ranked).mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
