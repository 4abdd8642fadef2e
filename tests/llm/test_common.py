import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from linkloom.llm import common
from linkloom.llm.anchors import byte_grams, window_runs
from linkloom.llm.common import grams, slices, within_rows, word_hashes, word_spans

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab c\n\té\x1c", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_of_slices(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    found = []
    for part, data, offsets in slices(iter([batch]), "t", limit):
        assert part.num_rows == len(offsets) - 1
        starts, ends, first = word_spans(data, offsets)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts, ends)]
        hashes = word_hashes(data, starts, ends)
        assert len({*words}) == len({*hashes.tolist()})
        ok = within_rows(first, 3, len(grams(hashes, 3)))
        assert ok.sum() == sum(max(0, b - a - 2) for a, b in zip(first[:-1], first[1:]))
        found += [words[a:b] for a, b in zip(first[:-1], first[1:])]
    assert found == [brute.WORD.findall(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=5))
def test_runs_hold_every_window_once_and_equal_windows_share_an_anchor(texts):
    window, k = 20, 8
    rows = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    row, anchor, content, low, n = window_runs(byte_grams(np.frombuffer(b"".join(rows), np.uint8), k), offsets, window, k)
    seen = {}
    for r, a, c, lo, size in zip(row, anchor, content, low, n):
        for s in range(lo, lo + size):
            assert (r, s) not in seen
            seen[r, s] = a
    assert set(seen) == {(r, s) for r, b in enumerate(rows) for s in range(len(b) - window + 1)}
    by_window = {}
    for (r, s), a in seen.items():
        assert by_window.setdefault(rows[r][s:s + window], a) == a


def test_a_worker_keeps_things_for_one_stage(monkeypatch):
    made, stage = [], [1]
    monkeypatch.setattr(common.TaskContext, "get", lambda: type("Context", (), {"stageId": lambda self: stage[0]})())
    make = lambda: made.append(stage[0]) or object()
    first = common.kept("words", make)
    assert common.kept("words", make) is first
    stage[0] = 2
    list(common.slices(iter([]), "text"))
    stage[0] = 1
    assert common.kept("words", make) is not first and made == [1, 1]


def test_python_tasks_get_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, held in (("64MB", 8 << 20), ("1g", 8 << 20), ("1048576b", 1 << 20), ("3m", 3 << 20)):
            spark.conf.set(name, given)
            common.with_python(spark.range(1))
            assert common._as_bytes(spark.conf.get(name)) == held
        spark.conf.set(name, "64MB")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        rows = common.with_python(spark.range(0, 400, 1, 1).selectExpr("id n", "repeat('x', 100000) t"))
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 30e6 and max(found) < 10e6
    finally:
        spark.conf.set(name, before)
