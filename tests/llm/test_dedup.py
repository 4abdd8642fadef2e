"""Operators 1, 3, 8 and 10 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from linkloom.llm import common, exact_dedup, parity_join
from linkloom.llm.common import maybe_in
from linkloom.llm.components import components
from linkloom.llm.exact_dedup import drop_copies, exact_groups
from linkloom.llm.parity_join import drop_near_duplicates, near_duplicates
from linkloom.llm.suffix_arrays import byte_unit, remove_repeated_bytes
from linkloom.llm.suffix_trees import remove_repeated_words, word_unit

WORDS = [f"w{i}x" for i in range(60)] + ["É", "the", "The"]


def table(spark, rows):
    # Columns that the operators use for themselves.
    extra = "doc_id long, text string, id string, k long, t string, n int, kept boolean, page int, label string, marks int, _id long"
    return spark.createDataFrame([(i, t, "x", 7, "y", 1, True, 2, "z", 3, 4) for i, t in rows], extra)


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, edits, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(5)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, rows, base = text(90), [], None
    for i in range(60):
        words = text(rng.randint(1, 220))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(10):rng.randrange(60, 90)]
        if i % 5 == 0 and base:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        base = words
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (64, " \n"), (65, "one two"), (66, "one two"), (67, "one"),
             (68, " ".join(text(40)) * 60), (3, rows[3][1]), (69, "a\x00b " * 300)]
    return rows


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize("poor", [False, True])
def test_exact_groups(spark, corpus, poor):
    key = (lambda c: F.length(c) % 7) if poor else None  # unequal texts that share a key are chained
    rows = [(None, "one"), (None, "null ids"), (None, "null ids"), *corpus]
    got = exact_groups(table(spark, rows), key=key, capacity=8, page_rows=3).collect()
    assert len(got) == len(rows)
    groups = expected_groups(rows)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(groups)
    import hashlib
    for text, ids in groups.items():
        found = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id for r in found), key=repr) == sorted(ids, key=repr)
        assert {(r.keep_id, r.group_size) for r in found} == {(top, len(ids))}
        assert [r.doc_id for r in found if r.kept] == [top]


def test_texts_of_lone_keys_stay_where_they_are(spark, monkeypatch):
    moved = []

    def counted(rows, *args):
        out = maybe_in(rows, *args)
        moved.append((rows.count(), sorted(r.t for r in out.select("t").collect())))
        return out

    monkeypatch.setattr(exact_dedup, "maybe_in", counted)
    rows = [(i, f"alone {i}") for i in range(2000)] + [(i, f"copy {i % 10}") for i in range(2000, 2030)]
    got = exact_groups(table(spark, rows)).collect()
    assert sum(r.kept for r in got) == 2010 and {r.group_size for r in got if r.doc_id >= 2000} == {3}
    (before, after), = moved
    assert before == 2030 and len(after) < 600 and [t for t in after if t.startswith("copy")] == sorted(t for _, t in rows[2000:])


def test_map_of_keys_loses_none(spark):
    rows = spark.range(-3000, 3000).select("id", F.xxhash64("id").alias("h"))
    for keys, n in ((rows.filter("id % 20 = 0"), 300), (rows, 2), (rows.filter("false"), 0)):
        found = {r.id for r in maybe_in(rows, keys.select("h"), "h", n).collect()}
        wanted = {r.id for r in keys.collect()}
        assert wanted <= found and len(found) <= (2000 if n == 300 else len(wanted))


@pytest.mark.parametrize("op", [drop_copies, drop_near_duplicates])
def test_rows_that_surely_stay_are_not_joined(spark, monkeypatch, op):
    doubtful = []

    def counted(rows, *args):
        out = maybe_in(rows, *args)
        if "doc_id" in rows.columns and "left_anti" not in args:
            doubtful.append(out.count())
        return out

    monkeypatch.setattr(common, "maybe_in", counted)
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)] + [(None, "no id"), (1000, rows[20][1])]
    kept = op(table(spark, rows))
    assert len(kept.columns) == 11
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    if op is drop_copies:
        # 1000 has two texts, that of 0 and that of 20, and is the larger id of both.
        assert ids == sorted([*range(10, 20), *range(21, 400), *range(1000, 1010), 1000, None], key=repr)
    else:
        assert ids == sorted([*range(400), None], key=repr)
    assert doubtful and max(doubtful) < 100


def test_drop_copies(spark, corpus):
    rows = [(None, "null ids"), (None, "null ids"), *corpus, *corpus[:5]]
    docs = table(spark, rows)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    groups = expected_groups(rows)
    same(kept.select("doc_id", F.coalesce("text", F.lit(""))), [(max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()])


@pytest.mark.parametrize("unit", [None, byte_unit(window=48, gram=16), byte_unit(window=48, gram=16, shard=2000, hot=300)])
def test_repeated_bytes(spark, corpus, unit):
    same(remove_repeated_bytes(table(spark, corpus), unit=unit), brute.suffix_bytes(corpus, unit.window if unit else 400))


@pytest.mark.parametrize("unit", [None, word_unit(window=9, gram=3), word_unit(window=9, gram=3, group=300, hot=60)])
def test_repeated_words(spark, corpus, unit):
    same(remove_repeated_words(table(spark, corpus), unit=unit), brute.suffix_words(corpus, unit.window if unit else 35))


def test_kept_text_is_returned(spark):
    rows = [(1, "a " * 30 + "left"), (2, "a " * 30)]
    got = {r.doc_id: bytes(r.kept).decode() for r in remove_repeated_words(table(spark, rows), unit=word_unit(window=9, gram=3), with_text=True).collect()}
    assert got == {1: "left", 2: ""}


@pytest.mark.parametrize("limit", [16, 4])
def test_near_duplicates(spark, corpus, limit):
    same(near_duplicates(table(spark, corpus), limit=limit, group_bytes=40_000), brute.near(corpus))


def test_near_duplicates_of_a_large_group(spark):
    """More near copies than a block's limit, beside unrelated texts that share a passage."""
    rng = random.Random(9)
    base, line = [rng.choice(WORDS) for _ in range(120)], [rng.choice(WORDS) for _ in range(25)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(i, " ".join(line + [f"u{i}_{j}" for j in range(rng.randint(40, 60))])) for i in range(40)]
    same(near_duplicates(table(spark, rows), limit=6), brute.near(rows))


def test_rows_that_repeat_id_and_text_have_one_text(spark, monkeypatch):
    """A third of all rows is one row, near to others: its text is kept and compared once."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(80)]
    rows = [(None, " ".join(base))] * 60 + [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1:])) for i in range(60)] + [(100 + i, f"other {i} " * 9) for i in range(60)]
    kept = {}
    real = parity_join.written
    monkeypatch.setattr(parity_join, "written", lambda df, name, *more: kept.setdefault(name, real(df, name, *more)) if name == "texts" else real(df, name, *more))
    monkeypatch.setattr(parity_join, "release", lambda *tables: None)
    same(near_duplicates(table(spark, rows)), brute.near(rows))
    assert kept["texts"].count() == kept["texts"].select("sig").distinct().count()


@pytest.mark.parametrize("ids", [range(10, 3010), [None] * 3000])
def test_copies_deal_their_blocks_once(spark, monkeypatch, ids):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, dealt = [(i, text(100)) for i in range(10)], spark.sparkContext.accumulator(0)
    copied = text(100)
    real = parity_join._dealt

    def counting(*given):
        deal = real(*given)

        def of(batches):
            for blob in deal(batches):
                dealt.add(sum(len(x) // 4 for x in blob.column("keys").to_pylist()))
                yield blob
        return of

    monkeypatch.setattr(parity_join, "_dealt", counting)
    rows = [*rows, *((i, copied) for i in ids)]
    same(near_duplicates(table(spark, rows).repartition(4)), brute.near(rows))
    assert 0 < dealt.value < 100 * 40


@pytest.mark.parametrize("few", [0, 2])
def test_few_wanted_texts_are_shuffled(spark, monkeypatch, few):
    """Of 600 texts that share blocks only those that near pairs name are read for verification."""
    rng = random.Random(12)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows = [(i, " ".join(text(60))) for i in range(600)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(20)] + [(2000, "one"), (2001, "ONE"), (2002, None)]
    seen = []

    def counted(table_, *args):
        out = maybe_in(table_, *args)
        if "sketch" not in table_.columns and "x" in table_.columns and "band" not in table_.columns:
            seen.append((table_.count(), out.count()))
        return out

    monkeypatch.setattr(parity_join, "maybe_in", counted)
    monkeypatch.setattr(parity_join, "FEW", few)
    shared = " ".join(text(12))
    rows = [(i, t and f"{t} {shared}") for i, t in rows]
    same(near_duplicates(table(spark, rows)), brute.near(rows))
    assert seen and all(after < before / 2 for before, after in seen)


def test_orders_by_entry_are_alike():
    rng = np.random.default_rng(3)
    entry, block, late = np.sort(rng.integers(0, 50, 4000)), rng.integers(0, 1 << 40, 4000), rng.integers(0, 2, 4000).astype(np.uint8)
    np.testing.assert_array_equal(parity_join._by_entry(entry, block), np.lexsort((block, entry)))
    np.testing.assert_array_equal(parity_join._by_entry(entry, block, late), np.lexsort((block, late, entry)))
    np.testing.assert_array_equal(parity_join._by_entry(entry << 18, block, late), np.lexsort((block, late, entry)))


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Texts that share three quarters of their shingles meet in common blocks at every level; some are linked."""
    rng = random.Random(10)
    template, rows = [f"t{i}" for i in range(90)], []
    for i in range(60):
        own = [f"o{i // 2 if i < 20 else i}_{j}" for j in range(rng.randint(24, 28))]
        rows.append((i, " ".join(template + own + ([f"last{i}"] if i < 20 else []))))
    pairs = []
    real = parity_join._search

    def search(limit):
        pairs.append(limit)
        return real(limit)

    monkeypatch.setattr(parity_join, "_search", search)
    monkeypatch.setattr(parity_join, "PAGE", 16)
    compared = spark.sparkContext.accumulator(0)
    whole = parity_join._page_pairs

    def counted(table):
        compared.add(1)
        assert table.num_rows < 60
        return whole(table)

    monkeypatch.setattr(parity_join, "_page_pairs", counted)
    want = brute.near(rows)
    assert 40 <= len({c for _, _, c in want}) < 60
    same(near_duplicates(table(spark, rows), limit=2), want)
    assert len(pairs) == parity_join.LEVELS + 1 and None not in pairs and compared.value > 1


@pytest.mark.parametrize("compared", [0, 8])
def test_a_family_of_near_copies_makes_few_pairs(spark, monkeypatch, compared):
    """Texts about as alike as linked ones: a task gives its links' forest, not all pairs that sketches can't tell apart."""
    rng = random.Random(14)
    base, rows = [f"b{i}" for i in range(40)], []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(40), 2 if i < 75 else 1):
            words[at] = f"w{i}_{at}"
        rows.append((i, " ".join(words)))
    made, searched = spark.sparkContext.accumulator(0), []
    whole, real = parity_join._page_pairs, parity_join._search

    def counted(table):
        out = whole(table)
        made.add(out.num_rows)
        assert out.num_rows < table.num_rows
        return out

    def search(limit):
        searched.append(limit)
        return real(limit)

    monkeypatch.setattr(parity_join, "_page_pairs", counted)
    monkeypatch.setattr(parity_join, "_search", search)
    monkeypatch.setattr(parity_join, "COMPARED", compared)
    want = brute.near(rows)
    assert 2 < len({c for _, _, c in want}) < 100
    same(near_duplicates(table(spark, rows), limit=8), want)
    assert made.value < 2 * len(rows) and (len(searched) == parity_join.LEVELS + 1) == (not compared)


def test_drop_near_duplicates(spark, corpus):
    docs = table(spark, corpus)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    stay = {i for i, _, c in brute.near(corpus) if i == c}
    same(kept.select("doc_id"), [(i,) for i, _ in corpus if i in stay])


@pytest.mark.parametrize("op", [exact_groups, drop_copies, remove_repeated_bytes, remove_repeated_words, near_duplicates, drop_near_duplicates])
def test_empty_tables(spark, op):
    assert op(table(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(139, 200), (7, 7), (5, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 200: 100}
