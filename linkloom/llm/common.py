"""What several of the operators share: written tables, word and gram arrays.

Tables between jobs go to the shared folder that ``spark.checkpoint.dir``
names, as Parquet: a lost executor costs a re-read, never a recomputation of
everything before, and nothing rests on one machine's disk.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from linkloom.session import checkpoint_dir, ship_package

#: Bytes of text that a Python task looks at together; a longer document is looked at alone.
SLICE_BYTES = 2 << 20
#: Rows that a Python task gets at once, in bytes (one row at least): as much again is held by its executor, outside the heap.
BATCH_BYTES = 8 << 20
#: White space of the word contracts: space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GRAM = np.uint64(0x9E3779B97F4A7C15)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: glibc's; other C libraries do without.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/linkloom-{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that needed them has ended: what it wrote is read from the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, batch_bytes: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    ``batch_bytes``: the most that a Python task of this write gets at once
    (one row at least), where rows carry texts.
    """
    spark, path, schema = df.sparkSession, shared_path(df.sparkSession, name), df.schema
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        if getattr(table, "written_to", None):
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def with_python(df: DataFrame) -> DataFrame:
    """``df``, with this package on the Python workers' path and no more than ``BATCH_BYTES`` sent to them at once."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if _as_bytes(conf.get(_BATCH)) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def _as_bytes(size: str) -> int:
    """A size of Spark's settings, like 64MB, in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * ("kmgtp".index(unit) + 1 if unit else 0)


def give_back() -> None:
    """What this worker has freed goes back to the machine: other tasks of the executor need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: What this worker keeps for the next task of a stage, by the stage's number.
_KEPT: dict[int, dict] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` has made in this worker for an earlier task of the stage, or makes now; other stages' things go."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    for other in [x for x in _KEPT if x != stage]:
        del _KEPT[other]
    own = _KEPT.setdefault(stage, {})
    if name not in own:
        own[name] = make()
    return own[name]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their text bytes end to end and the rows' offsets.

    A run has at most ``limit`` bytes, or one row. Null text has no bytes.
    """
    kept("", lambda: None)  # what an earlier stage has left
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], (bounds[at:to + 1] - bounds[at])
            at = to
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mixed(length.astype(np.uint64) + _GRAM)
    live = np.arange(len(starts))
    step = 0
    while len(live):
        left = length[live] - 8 * step
        value = eights[starts[live] + 8 * step]
        short = left < 8
        keep = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        value = np.where(short, value & keep, value)
        out[live] = mixed((out[live] ^ value) * _GRAM + np.uint64(step))
        live, step = live[left > 8], step + 1
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position; len - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for j in range(1, n):
        out *= _GRAM
        out += hashes[j:j + size]
    return mixed(out)


def within_rows(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` n-gram positions lie in one row; ``first``: each row's first word."""
    ok = np.ones(max(size, 0), bool)
    for back in range(1, n):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < size)]
        ok[at] = False
    return ok


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n positions."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


#: A key shared by more rows than a page is dealt to several pages; at most so many keys can be.
HOT_KEYS, PAGE_ROWS = 100_000, 1024


def paged_join(many: DataFrame, few: DataFrame, keys: list[str], count: str, total: int, spread, page_rows: int | None = None) -> DataFrame:
    """``many`` joined to ``few``, which has one row per key and in ``count`` the rows of ``many`` with it.

    Keys of more than a page of rows are split: their rows of ``many`` go to
    pages by ``spread`` (a hash column), their row of ``few`` to every page.
    Fewer than total / page_rows <= HOT_KEYS keys are so frequent, which
    bounds the table of them that is broadcast.
    """
    from pyspark.sql import functions as F

    page_rows = page_rows or max(PAGE_ROWS, total // HOT_KEYS)
    pages = F.ceil(F.col(count) / page_rows).cast("int")
    hot = F.broadcast(few.filter(F.col(count) > page_rows).select(*keys, pages.alias("_pages")))
    left = many.join(hot, keys, "left").withColumn("_page", F.pmod(spread, F.coalesce("_pages", F.lit(1))).cast("int")).drop("_pages")
    right = few.withColumn("_page", F.explode(F.sequence(F.lit(0), pages - 1)))
    return left.join(right, [*keys, "_page"]).drop("_page")


#: Bits of ``maybe_in``'s map for each key, and at most so many in all (2^25 are 4 MB).
KEY_BITS, MAP_BITS = 8, 25


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, n_keys: int, how: str = "left_semi") -> DataFrame:
    """Those of ``rows`` whose ``key``, a well-spread long, may be among ``keys``; all that are, and few others. With left_anti all the rest.

    The low bits of ``keys`` (about ``n_keys`` of them) are marked in one
    broadcast row of bounded size, so rows that a join would drop needn't be
    shuffled for it. A full map only lets more rows through.
    """
    from pyspark.sql import functions as F

    bits = min(MAP_BITS, max(6, (KEY_BITS * n_keys).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(at, 6).cast("int"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    blank = rows.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("marks"))
    words = keys.select(word.alias("w"), bit.alias("marks")).unionByName(blank).groupBy("w").agg(F.bit_or("marks").alias("marks"))
    marked = words.agg(F.sort_array(F.collect_list(F.struct("w", "marks"))).getField("marks").alias("_marked"))
    return rows.join(F.broadcast(marked), F.get("_marked", word).bitwiseAND(bit) != 0, how)


def without(rows: DataFrame, gone: DataFrame, n_gone: int) -> DataFrame:
    """``rows`` whose id (no null ones) is not in ``gone``; of the others only the few that the map can't tell from these are shuffled."""
    from pyspark.sql import functions as F

    own, (id_col,) = "_ll_key", gone.columns
    keyed = rows.withColumn(own, F.xxhash64(id_col))
    marks = gone.select(F.xxhash64(id_col).alias(own))
    in_doubt = maybe_in(keyed, marks, own, n_gone).join(gone, id_col, "left_anti").select(*rows.columns)
    return maybe_in(keyed, marks, own, n_gone, "left_anti").select(*rows.columns).unionByName(in_doubt)
