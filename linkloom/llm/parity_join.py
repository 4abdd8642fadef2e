"""Operator 8: n-gram Jaccard join by parity sketches.

A document is its set of 5-word shingles. Each shingle's hash is XORed into
one of the blocks of a *parity sketch*, so a block tells which of its bits
are set an odd number of times, and shingles that two documents share cancel
out: sketches differ in at most as many places as the sets differ by. With
Jaccard 3/4 sets of a and b shingles differ by at most d = (a + b) / 7.

*Size bands* (sizes 2^i .. 2^(i+1)) fix the blocks. Of any d + 1 non-empty
blocks of a document at least one is untouched by the differences; taking
each document's first d + 1 in one order for all, two linked documents of a
band have one of these in common (pigeonhole). Larger documents that can be
linked into the band below enter that too. Should a document have too few
non-empty blocks for this, the search is made with more blocks.

Candidates are pruned by size and by the Hamming distance of folded sketches
(a lower bound of the difference), and what is left is verified on the whole
shingle sets. Documents with equal sets are one from the start: a task deals
the blocks of one text of each set. A block that more than ``LIMIT`` documents
share yields pairs with one centre only. Its members that the links don't join
are searched again with all such blocks put last in the order (any order that
is the same for all will do), so that documents meet in rarer blocks. As
soon as so few are left that each can be compared with each, and with what is
still in large groups at the last level, this is done in full, page against page
of the members, so that no task holds a whole group or its pairs: two pages'
whole sets are held, sketches of these tell what needs no look, and of the links
found a task gives one for each two parts that it joins. Tables in between are
deleted when nothing reads them any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import LOWER, grams, maybe_in, mixed, paged_join, release, row_of, slices, with_python, within_rows, without, word_hashes, word_spans, written
from linkloom.llm.components import components

SHINGLE = 5
#: Members of a block up to which all their pairs are candidates (twice and four times as many at later levels,
#: where members that are known to be linked make no pairs).
LIMIT = 16
#: Bytes of a group of block rows, and rows kept before they are dealt out.
GROUP_BYTES, HELD = 12 << 20, 400_000
#: Below this size every shingle has a block of its own.
SINGLE = 64
LEVELS = 5
#: Members of a page at most, bytes of a page's sets, pairs (or bytes of them) held at a time, and pages of a smaller group.
PAGE, PAGE_BYTES, PAIRS, PAGES = 4096, 8 << 20, 1 << 20, 4
#: All that is still in question is compared in full if that is so many times ``limit`` squared comparisons for each document at most.
COMPARED = 8
#: Bits of a sketch for each 2^band: a folded one, and one made of two pages' sets.
FOLDED, WIDE = 4, 16
#: A table is searched for the rows that a join wants before it is shuffled if it has so many times the rows.
FEW = 2
#: Bits of the map of common blocks; a bit that is set for another block only changes the order.
COMMON_BITS = 24

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and the rows' bounds."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(LOWER[data], starts, ends)
    count = np.diff(first)
    g = grams(words, SHINGLE)
    ok = np.flatnonzero(within_rows(first, SHINGLE, len(g)))
    row, value = row_of(first, len(words))[ok], g[ok]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):  # the whole sequence is the one shingle
        whole = np.array([int(grams(words[first[r]:first[r + 1]], count[r])[0]) ^ int(count[r]) for r in short], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, mixed(whole)])
    order = np.argsort(value)
    few = len(offsets) <= 1 << 16  # 16-bit numbers are sorted by radix
    order = order[np.argsort(row[order].astype(np.uint16 if few else np.int64), kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit signature of each row's set; 0 for the empty one."""
    n = np.diff(bounds)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(value ^ _GOLD))])
    return np.where(n > 0, mixed((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(np.uint64)) | np.uint64(1), np.uint64(0))


def _bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, band and largest difference for each band that a row enters."""
    row = np.flatnonzero(n > 0)
    own = np.floor(np.log2(n[row])).astype(np.int64)
    below = (own > 0) & (3 * n[row] <= 4 * ((1 << own) - 1))
    low = row[below]
    return (np.concatenate([row, low]), np.concatenate([own, own[below] - 1]),
            np.concatenate([n[row] // 3, (n[low] + (1 << own[below]) - 1) // 7]))


def _members(value: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the given rows, end to end, and the entry each belongs to."""
    n = (bounds[1:] - bounds[:-1])[row]
    entry = np.repeat(np.arange(len(row)), n)
    at = np.repeat(bounds[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return value[at], entry


def _by_entry(entry: np.ndarray, block: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """Order by entry, ``late`` ones last, and block (41 bits at most): as one number where that fits."""
    if len(entry) and entry.max() >= 1 << 21:
        return np.lexsort((block, entry) if late is None else (block, late, entry))
    if late is not None:
        entry = 2 * entry + late
    return np.argsort((entry << 41) | block)


def block_rows(value: np.ndarray, bounds: np.ndarray, more: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Key, row and band of each document's first d + 1 blocks, ``common`` ones last; how many had too few."""
    row, band, d = _bands(np.diff(bounds))
    x, entry = _members(value, bounds, row)
    x = mixed(x + _GOLD)
    blocks = (2 << band) * more
    many = (np.minimum(blocks, 1 << 40)[entry]).astype(np.uint64)
    block = np.where((2 << band)[entry] <= SINGLE, x >> np.uint64(24), (x >> np.uint64(16)) % many).astype(np.int64)
    order = _by_entry(entry, block)
    x, entry, block = x[order], entry[order], block[order]
    new = np.ones(len(x), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (block[1:] != block[:-1])
    lead = np.flatnonzero(new)
    if not len(lead):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    parity = np.bitwise_xor.reduceat(x, lead)
    entry, block = entry[lead], block[lead]
    key = mixed(parity + mixed(block.astype(np.uint64) * _GOLD + band[entry].astype(np.uint64)))
    if common is not None:
        at = (key & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)
        order = _by_entry(entry, block, (common[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        key, entry = key[order], entry[order]
    first = np.searchsorted(entry, np.arange(len(row) + 1))
    nth = np.arange(len(entry)) - first[entry]
    few = int((np.diff(first) <= d).sum())
    take = nth <= d[entry]
    return key[take], row[entry[take]], band[entry[take]], few


def folded_sketches(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row, band and the bit sketch (4 * 2^band bits, each shingle flips one) for every band entered."""
    row, band, _ = _bands(np.diff(bounds))
    x, entry = _members(value, bounds, row)
    bits = np.maximum(8, FOLDED << band)
    begin = np.concatenate([[0], np.cumsum(bits)])
    at = begin[entry] + ((mixed(x) >> np.uint64(16)) % bits[entry].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=begin[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    cut = (begin // 8).tolist()
    return row, band, [packed[a:b] for a, b in zip(cut[:-1], cut[1:])]


_BLOB = "slot int, keys binary, sigs binary, labels binary, sizes binary, bands binary"


class _Dealer:
    """Gathers block rows of a task and deals them to slots as arrays."""

    def __init__(self, slots: int):
        self.slots, self.held, self.size = slots, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[dict]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= HELD:
            yield from self.deal()

    def deal(self) -> Iterator[dict]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        slot = ((columns[0] >> np.uint64(34)) % np.uint64(self.slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        columns = [c[order] for c in columns]
        some, lead = np.unique(slot[order], return_index=True)
        kinds = (np.uint32, np.int64, np.int64, np.uint32, np.uint8)
        for s, a, b in zip(some.tolist(), lead.tolist(), [*lead[1:].tolist(), len(order)]):
            yield dict(zip(("slot", "keys", "sigs", "labels", "sizes", "bands"), [s, *(c[a:b].astype(t).tobytes() for c, t in zip(columns, kinds))]))


_BLOB_ARROW = pa.schema([("slot", pa.int32()), *((c, pa.binary()) for c in ("keys", "sigs", "labels", "sizes", "bands"))])


def _blobs(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    for x in found:
        yield pa.RecordBatch.from_pylist([x], _BLOB_ARROW)


_FOUND = "a long, b long, band int, size_a int, size_b int, hot boolean"


def _search(limit: int):
    """Candidate pairs of a slot's groups; members (group, signature, key in size_b) of groups over ``limit``."""
    def search(table: pa.Table) -> pa.Table:
        key, sig, label, size, band = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
                                       for c, t in (("keys", np.uint32), ("sigs", np.int64), ("labels", np.int64), ("sizes", np.uint32), ("bands", np.uint8)))
        order = np.argsort(key)
        equal = np.zeros(len(key) + 1, bool)
        equal[1:-1] = key[order][1:] == key[order][:-1]
        order = order[equal[1:] | equal[:-1]]
        order = order[np.lexsort((sig[order], band[order], key[order]))]
        key, sig, label, size, band = (x[order] for x in (key, sig, label, size, band))
        group = np.ones(len(key), bool)
        group[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
        new = group.copy()
        new[1:] |= sig[1:] != sig[:-1]
        key, sig, label, size, band, group = (x[new] for x in (key, sig, label, size, band, group))
        lead = np.flatnonzero(group)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        hot = np.zeros(0, np.int64)
        if len(lead):
            count = np.diff(np.append(lead, len(key)))
            mixed_labels = np.minimum.reduceat(label, lead) != np.maximum.reduceat(label, lead)
            lead, count = lead[mixed_labels], count[mixed_labels]
            for m in np.unique(count[count <= limit]):
                i, j = np.triu_indices(m, 1)
                at = lead[count == m][:, None]
                out.append(((at + i).ravel(), (at + j).ravel()))
            big = count > limit
            for at, m in zip(lead[big], count[big]):
                out.append((np.full(m - 1, at), np.arange(at + 1, at + m)))  # one centre for all
            hot = np.repeat(lead[big] - np.cumsum(count[big]) + count[big], count[big]) + np.arange(int(count[big].sum()))
        a, b = (np.concatenate(x) for x in zip(*out))
        small, large = np.minimum(size[a], size[b]).astype(np.int64), np.maximum(size[a], size[b]).astype(np.int64)
        good = (label[a] != label[b]) & (4 * small >= 3 * large)
        a, b = a[good], b[good]
        pick = np.lexsort((band[a], sig[b], sig[a]))
        a, b = a[pick], b[pick]
        one = np.ones(len(a), bool)
        one[1:] = (sig[a][1:] != sig[a][:-1]) | (sig[b][1:] != sig[b][:-1]) | (band[a][1:] != band[a][:-1])
        a, b = a[one], b[one]
        slot = table.column("slot")[0].as_py() if table.num_rows else 0
        name = mixed(key[hot].astype(np.uint64) + (band[hot].astype(np.uint64) << np.uint64(32)) + np.uint64(slot) * _GOLD).view(np.int64)
        columns = [np.concatenate(x) for x in ((sig[a], name), (sig[b], sig[hot]), (band[a], band[hot]), (size[a], size[hot]), (size[b], key[hot].view(np.int32)))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table([*(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)), pa.array(np.arange(len(a) + len(hot)) >= len(a))],
                        names=["a", "b", "band", "size_a", "size_b", "hot"])
    return search


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature, band and folded sketch of each row's set, and the sketch of the band below if the row enters it."""
    for batch, data, offsets in slices(batches, "t"):
        value, bounds = shingle_sets(data, offsets)
        row, band, sketch = folded_sketches(value, bounds)
        own, high, low = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows, [None] * batch.num_rows
        for r, b, x in zip(row.tolist(), band.tolist(), sketch):  # a row's own band comes first
            if high[r] is None:
                own[r], high[r] = b, x
            else:
                low[r] = x
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(np.diff(bounds)), pa.array(signatures(value, bounds).view(np.int64)),
                                          pa.array(own), pa.array(high, pa.binary()), pa.array(low, pa.binary())],
                                         ["k", "id", "n", "sig", "band", "high", "low"])


def _dealt(slots: int, more: int, few, common):
    """Block rows of documents; labels are the signatures where the rows have none."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = _Dealer(slots), np.zeros(0, np.int64)
        for batch, data, offsets in slices(batches, "t"):
            value, bounds = shingle_sets(data, offsets)
            sig = signatures(value, bounds).view(np.int64)
            label = batch.column("label").to_numpy() if "label" in batch.schema.names else sig
            # Of texts with equal sets a task deals one.
            new, first = np.unique(sig, return_index=True)
            first = np.sort(first[~np.isin(new, seen)])
            seen = np.concatenate([seen, sig[first]])
            value, _ = _members(value, bounds, first)
            n = np.diff(bounds)[first]
            key, row, band, lacking = block_rows(value, np.append(0, np.cumsum(n)), more, common.value)
            if lacking:
                few.add(lacking)
            yield from _blobs(dealer.add(key, sig[first][row], label[first][row], n[row], band))
        yield from _blobs(dealer.deal())
    return dealt


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are no further apart than linked sets can be."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        most = (batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()) // 7
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
            keep[i] = np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum() <= most[i]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _wide_sketches(value: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Each row's bit sketch, all of one width."""
    step = max(1, (1 << 23) // bits)
    at = ((mixed(value) >> np.uint64(16)) % np.uint64(bits)).astype(np.int64)
    out = np.empty((len(bounds) - 1, bits // 8), np.uint8)
    for r in range(0, len(out), step):
        cuts = bounds[r:r + step + 1]
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        odd = np.bincount(row * bits + at[cuts[0]:cuts[-1]], minlength=(len(cuts) - 1) * bits) & 1
        out[r:r + step] = np.packbits(odd.astype(np.uint8)).reshape(-1, bits // 8)
    return out


class _Parts:
    """Which labels are joined: a forest, the root of each tree its name."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.above))], np.int64)


def _page_pairs(table: pa.Table) -> pa.Table:
    """Linked pairs of two pages of a group (or within one): one for each two parts, not known to be joined, that links join."""
    table = table.combine_chunks()
    page, sig = table.column("page").to_numpy(), table.column("sig").to_numpy()
    i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    names, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
    sets = [shingle_sets(data, offsets) for _, data, offsets in slices(iter(table.select(["t"]).to_batches()), "t")]
    value = np.concatenate([v for v, _ in sets])
    size = np.concatenate([np.diff(b) for _, b in sets])
    bounds = np.append(0, np.cumsum(size))
    narrow, wide = (_wide_sketches(value, bounds, max(8, bits << band)) for bits in (FOLDED, WIDE))
    left, right = np.flatnonzero(page == i), np.flatnonzero(page == j)
    parts, out = _Parts(len(names)), []
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        a, b = (x.ravel() for x in np.meshgrid(left[at:at + step], right, indexing="ij"))
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        part = parts.roots()[label]
        good = (part[a] != part[b]) & (4 * small >= 3 * large)
        if i == j:
            good &= a < b
        a, b, most = a[good], b[good], ((small + large) // 7)[good]
        for sketch in (narrow, wide):
            held = max(1, 8 * PAIRS // sketch.shape[1])
            near = [np.bitwise_count(sketch[a[c:c + held]] ^ sketch[b[c:c + held]]).sum(1, dtype=np.int64) <= most[c:c + held] for c in range(0, len(a), held)]
            near = np.concatenate(near) if near else np.zeros(0, bool)
            a, b, most = a[near], b[near], most[near]
        for x, y in zip(a.tolist(), b.tolist()):
            if parts.root(label[x]) == parts.root(label[y]):
                continue
            mine, theirs = value[bounds[x]:bounds[x + 1]], value[bounds[y]:bounds[y + 1]]
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * both >= 75 * (len(mine) + len(theirs) - both):
                parts.join(label[x], label[y])
                out.append((x, y))
    a, b = (sig[np.array(x, np.int64)] for x in (zip(*out) if out else ([], [])))
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _paged_pairs(members: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """Linked pairs that join each group's members (e, of one band; sig, band, label), page against page; ``texts``: sig, t of all of them."""
    # Groups with the same members are one.
    groups = (members.groupBy("e", "band").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("marks"),
                                               F.min("label").alias("low"), F.max("label").alias("high"))
              .filter("low <> high").groupBy("band", "c", "marks").agg(F.min("e").alias("e")))
    # A set of the band has 2^(band + 1) numbers of 8 bytes at most.
    most = F.floor(F.lit(PAGE_BYTES >> 4) / F.pow(F.lit(2.0), F.col("band")))
    page = F.greatest(F.lit(1), F.least(F.lit(PAGE), most, F.greatest(F.lit(PAGE >> 4), F.ceil(F.col("c") / PAGES))))
    groups = groups.select("e", "c", F.ceil(F.col("c") / page).cast("int").alias("pages"))
    rows = paged_join(members, groups, ["e"], "c", total, F.xxhash64("sig")).drop("c")
    rows = rows.withColumn("page", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("pages")).cast("int")).join(texts, "sig")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    rows = rows.select("e", F.least("page", "other").alias("i"), F.greatest("page", "other").alias("j"), "page", "sig", "label", "band", "t")
    return rows.groupBy("e", "i", "j").applyInArrow(_page_pairs, "a long, b long")


def _one_each(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """One row of each run of equal texts, and the run of each row: a centre comes once for all its pairs in a row."""
    run = np.zeros(len(column), np.int64)
    if len(column) > 1:
        run[1:] = np.cumsum(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False))
    return column.take(pa.array(np.unique(run, return_index=True)[1])), run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        centres, run = _one_each(batch.column("x"))
        lead = np.searchsorted(run, np.arange(len(centres) + 1))
        at = 0
        for some, data, offsets in slices(iter([pa.RecordBatch.from_arrays([centres], ["x"])]), "x"):
            mine, bounds = shingle_sets(data, offsets)
            pairs, to = lead[at], lead[at + some.num_rows]
            for part, other, cuts in slices(iter([batch.slice(pairs, to - pairs)]), "y"):
                theirs, limits = shingle_sets(other, cuts)
                for i in range(part.num_rows):
                    j = run[pairs + i] - at
                    x, y = mine[bounds[j]:bounds[j + 1]], theirs[limits[i]:limits[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[pairs + i] = 100 * both >= 75 * (len(x) + len(y) - both)
                pairs += part.num_rows
            at += some.num_rows
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _wanted(rows: DataFrame, total: int, pairs: DataFrame, side: str, n: int) -> DataFrame:
    """``rows`` (sig, ...; ``total`` of them) under the name of ``side`` in the ``n`` pairs; without most that these don't name, if they are few."""
    rows = rows.withColumnRenamed("sig", side)
    return maybe_in(rows, pairs.select(side), side, n) if FEW * n < total else rows


def _with_centres(pairs: DataFrame, counts: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` with what ``held`` has of their centres ``a``; a centre of many pairs (``counts``) is split, and goes once to each page of them."""
    total = counts.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    return paged_join(pairs, counts.join(held, keys), keys, "pairs", total, F.xxhash64("b")).drop("pairs")


def _verify(pairs: DataFrame, texts_of, sketches: DataFrame, total: int) -> DataFrame:
    """Those of ``pairs`` that are linked. What a pair carries through a shuffle is b's sketch or text; the centre's meets it after."""
    number = F.count(F.lit(1)).alias("pairs")
    pairs = written(pairs.select("a", "b", "band", "size_a", "size_b").distinct(), "pairs")
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    counts = written(pairs.groupBy("a", "band").agg(number), "centres")
    both = pairs.join(_wanted(sketches.withColumnRenamed("sketch", "y"), total, pairs, "b", n), ["b", "band"])
    both = _with_centres(both, counts, _wanted(sketches.withColumnRenamed("sketch", "x"), total, pairs, "a", n), ["a", "band"])
    near = written(both.mapInArrow(_near, "a long, b long").distinct(), "near", PAGE_BYTES)
    release(pairs, counts)
    counts = written(near.groupBy("a").agg(number), "centres")
    named = written(near.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "named")
    texts = written(texts_of(named, named.count(), "x"), "texts")
    both = near.join(texts.select(F.col("sig").alias("b"), F.col("x").alias("y")), "b")
    both = _with_centres(both, counts, texts.withColumnRenamed("sig", "a"), ["a"])
    links = written(both.mapInArrow(_verified, "a long, b long"), "links", PAGE_BYTES)
    release(near, counts, named, texts)
    return links


def _with_common(common: np.ndarray | None, hot: DataFrame) -> np.ndarray:
    """The map of common blocks with those of ``hot`` (key) set; 2 MB however many there are."""
    at = F.col("key").cast("long").bitwiseAND(F.lit((1 << COMMON_BITS) - 1))
    words = (hot.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
             .groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << COMMON_BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    out = out.view(np.uint8)
    return out if common is None else out | common


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = LIMIT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    component_id is the smallest id that links lead to, the row's own
    included; null ids are never smaller. Texts without words (null, empty)
    have no shingles and link with nothing: component_id is their own id.
    Repeated rows and texts with equal sets link; an empty table gives no
    rows and other columns are not looked at. Sets are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = with_python(docs).select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id"), text.alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    profiles = written(named.mapInArrow(_profiles, f"k long, id {kind}, n long, sig long, band int, high binary, low binary"), "profiles")
    # Rows of a class have the same set, and so the same size, band and sketches.
    classes = written(profiles.filter("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least"), F.min("k").alias("k"), F.max("n").alias("n"),
                                                                  *(F.any_value(x).alias(x) for x in ("band", "high", "low"))), "classes")
    total, shingles = profiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = classes.count()
    repeated = not profiles.groupBy("k").count().filter("count > 1").isEmpty()  # rows that repeat id and text
    entered = F.filter(F.array(F.struct("band", F.col("high").alias("sketch")), F.struct((F.col("band") - 1).alias("band"), F.col("low").alias("sketch"))),
                       lambda x: x["sketch"].isNotNull())
    sketches = classes.select("sig", F.inline(entered))

    common = None

    def searched(rows: DataFrame, shingles: int, limit: int) -> DataFrame:
        """Blocks dealt to slots and searched; once more with more blocks where a document had too few."""
        more, known = 1, spark.sparkContext.broadcast(common)
        while True:
            few = spark.sparkContext.accumulator(0)
            slots = max(1, math.ceil(shingles * 10 / group_bytes))  # about 0.45 rows of 25 bytes a shingle
            blobs = rows.mapInArrow(_dealt(slots, more, few, known), _BLOB)
            out = written(blobs.groupBy("slot").applyInArrow(_search(limit), _FOUND), "candidates")
            if not few.value:
                return out
            release(out)
            more *= 4

    def texts_of(some: DataFrame, n: int, text: str = "t") -> DataFrame:
        """``some`` (sig, once each, ...; ``n`` rows) with one text of each set; most other texts aren't shuffled, if these are few."""
        keys, rows = some.join(classes.select("sig", "k"), "sig"), named.select("k", F.col("t").alias(text))
        rows = (maybe_in(rows, keys, "k", n) if FEW * n < total else rows).join(keys, "k")
        return rows.groupBy(some.columns).agg(F.any_value(text).alias(text)) if repeated else rows.drop("k")

    def relabelled(labels: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """``labels`` with the links among ``pairs``; as they are where there is none."""
        return joined(labels, _verify(pairs, texts_of, sketches, sets))

    def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        if labels is not None and links.isEmpty():
            release(links)
            return labels
        out = components(links, labels)
        release(links, labels)
        return out

    found = searched(named.select("t"), shingles, limit)
    labels = relabelled(None, found.filter("not hot"))
    for level in range(1, LEVELS + 1):
        hot = written(found.filter("hot").select(F.col("a").alias("e"), F.col("b").alias("sig"), F.col("size_b").alias("key")).distinct(), "hot")
        release(found)
        found = None
        if hot.isEmpty():
            release(hot)
            break
        common = _with_common(common, hot)
        # Groups that the links don't join: the rest need no further search.
        known = hot.select("e", "sig").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("e", "sig", F.coalesce("label", "sig").alias("label"))
        apart = known.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("e", "c")
        apart = written(apart, "apart")
        members = written(paged_join(known, apart, ["e"], "c", total, F.xxhash64("sig")).select("sig", "label").distinct(), "open")
        release(hot, apart)
        size, n = members.join(classes.select("sig", "n"), "sig").agg(F.sum("n"), F.count(F.lit(1))).first()
        if not size:
            release(members)
            break
        if n * n <= COMPARED * limit * limit * total:  # whoever of a linked pair is not joined yet is among these
            each = members.join(classes.select("sig", F.inline(entered)).drop("sketch"), "sig").withColumn("e", F.col("band").cast("long"))
            labels = joined(labels, written(_paged_pairs(each, texts_of(members.select("sig"), n), total), "links"))
            release(members)
            break
        found = searched(texts_of(members, n), size, limit * min(4, 2 ** level))
        release(members)
        labels = relabelled(labels, found.filter("not hot"))
    else:
        large = found.filter("hot").select(F.col("a").alias("e"), F.col("b").alias("sig"), "band").distinct()
        large = written(large.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")), "large")
        release(found)
        some = written(large.select("sig").distinct(), "sets")
        labels = joined(labels, written(_paged_pairs(large, texts_of(some, some.count()), total), "links"))
        release(large, some)
    named_classes = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = named_classes.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.min("least").alias("component_id"))
    ready = paged_join(named_classes, least, ["label"], "sets", total, F.xxhash64("sig")).select("sig", "c", "component_id")
    some = paged_join(profiles.filter("n > 0"), ready, ["sig"], "c", total, F.xxhash64("k")).select("id", "n", "component_id")
    none = profiles.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; same columns.

    Rows are told by id: rows without one stay, and rows that share one stay
    if any of them is its component's.
    """
    found = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_ll_id"), (F.col(id_col) == F.col("component_id")).alias("stays"))
    gone = written(found.groupBy("_ll_id").agg(F.max("stays").alias("stays")).filter("not stays").select("_ll_id"), "gone")
    gone = gone.withColumnRenamed("_ll_id", id_col)
    return without(docs.filter(F.col(id_col).isNotNull()), gone, gone.count()).unionByName(docs.filter(F.col(id_col).isNull()))
