"""Operators 11 to 13 against brute force and the sentencepiece library."""

import hashlib
import math
import random

import numpy as np
import pytest

import brute
from linkloom.llm import pieces, prefix_trie
from linkloom.llm.hard_negatives import Block, hard_negatives
from linkloom.llm.pieces import decode_ids, decode_run, encode_run, encode_texts, load_model, merge_words
from linkloom.llm.queries import QUERIES, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


# ── 11: hard negatives ──────────────────────────────────────────────────────

def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "x", 2) for i, label, v in rows], "vec_id long, label int, vector array<double>, key int, v string, length int")


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    rows = []
    for i in range(700):
        centre, scale = i % 3, rng.choice([0.2, 1.0, 3.0])
        rows.append((i, rng.randrange(4), [scale * (rng.gauss(0, 0.5) + (1.0 if j == centre else 0.0)) for j in range(8)]))
    # A third of all rows are one vector; ties, odd lengths, missing and non-finite values, repeated rows and ids.
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(350)]
    rows += [(2000, None, [1.0] * 8), (2100, 1, None), (2200, 1, [1.0, None] + [0.0] * 6), (2300, 1, [math.nan] + [0.0] * 7), (2400, 1, [math.inf] * 8),
             (None, 1, [1.0] * 8), (2500, 1, []), (2501, 2, [1.0]), (2600, 1, [1.0] * 9), rows[0], rows[0], (100, 3, [0.25] * 8), (2700, 9, [0.1] * 8), (2800, 0, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("shape", [{}, {"block_rows": 64, "tile_anchors": 3}])
def test_hard_negatives(spark, points, shape):
    same(hard_negatives(vectors(spark, points), **shape), brute.negatives(points))


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives(vectors(spark, [(0, 1, [1.0])]).limit(0)).collect() == []
    for rows in ([(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])], [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [0.0])], [(0, 1, [0.0]), (1, 1, [3.0]), (2, 2, [1.0])]):
        same(hard_negatives(vectors(spark, rows)), brute.negatives(rows))


def test_scores_beyond_53_bits_are_exact(spark):
    rows = [(0, 1, [8_000_000.1, 0.5]), (1, 1, [8_000_000.3, 0.25]), (2, 2, [6_000_000.7, 3.0]), (3, 2, [6_000_000.7, 3.25])]
    same(hard_negatives(vectors(spark, rows)), brute.negatives(rows))
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(vectors(spark, [(0, 1, [1e15]), (1, 1, [1e15])])).collect()


def test_candidates_hold_every_row_above_the_threshold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (500, 6)) * rng.integers(0, 3, (500, 1))
    block = Block(np.arange(500), np.zeros(500), rows)
    pruned = 0
    for query in rows[:60]:
        score = rows @ query
        for least in (1, int(np.quantile(score, 0.9)), int(score.max()), int(score.max()) + 1):
            at = block.candidates(query, least)
            if at is not None:
                assert set(np.flatnonzero(score >= least)) <= set(at.tolist())
                pruned += len(at) < 250
    assert pruned > 50  # the ranges do cut


def test_op11_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(QUERIES["op11_hard_negatives"](spark, sf), brute.negatives(rows))


# ── 12: pieces ──────────────────────────────────────────────────────────────

@pytest.fixture(scope="module")
def model():
    return load_model(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def equal_to_library(model, library, texts):
    data = [t.encode() for t in texts]
    ids, bounds = encode_run(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    shown = decode_run(model, ids, bounds)
    for i, t in enumerate(texts):
        expected = library.encode(t)
        assert ids[bounds[i]:bounds[i + 1]].tolist() == expected
        assert shown[i] == library.decode(expected)


def test_pieces_equal_the_library(model, library):
    rng = random.Random(2)
    words = ["the", "abab", "aaaa", "  ", "\n", "ﬁé́", "🙂", "▁", "▁▁x", "日本", "\x00", "antidisestablishmentarianism", "0" * 30]
    equal_to_library(model, library, ["", " ", "a", "", *("".join(rng.choice(words) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(300))])
    equal_to_library(model, library, ["".join(rng.choice("etaoinsh ▁") for _ in range(rng.randint(0, 200))) for _ in range(500)])
    equal_to_library(model, library, ["".join(chr(c) for c in range(a, a + 997) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 997)])


def test_long_words_are_finished_from_the_heap(model, library, monkeypatch):
    rng = random.Random(4)
    texts = [" " * 1500, "ab" * 700 + " " * 300, "".join(rng.choice("aeinrst") for _ in range(4000))]
    equal_to_library(model, library, texts)
    monkeypatch.setattr(pieces, "ROUNDS", 0)
    equal_to_library(model, library, [*texts, "the cat sat on the mat"])


def test_one_merge_a_round_gives_the_same(model):
    """Merging several places of a word at once equals merging one by one."""
    rng = random.Random(8)
    for _ in range(200):
        word = [int(model.symbol_of[ord(c)]) for c in "".join(rng.choice("aabbnst▁") for _ in range(rng.randint(1, 40)))]
        merged, _ = merge_words(model, np.array(word), np.array([len(word)]))
        assert merged.tolist() == pieces._by_heap(model, list(word))


def test_decoding_any_ids(model, library):
    rng = random.Random(6)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705]) for _ in range(rng.randint(0, 25))]
        assert decode_run(model, np.array(ids, np.int64), np.array([0, len(ids)])) == [library.decode(ids)]


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "one  two"), (None, "null id"), (2, None), (3, ""), (4, "x" * 50_000 + " y"), (1, "one  two"), (5, "É ß")]
    docs = spark.createDataFrame([(i, t, 7, "i", 1) for i, t in rows], "doc_id long, text string, id int, ids string, t int")
    coded = encode_texts(docs, MODEL, decoded=True)
    same(coded.select("doc_id", "ids", "decoded"), [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows])
    back = decode_ids(coded.drop("decoded").withColumn("size", coded.doc_id), MODEL)
    same(back.select("doc_id", "size", "decoded"), [(i, i, t or "") for i, t in rows])
    assert encode_texts(docs.limit(0), MODEL).collect() == []
    with pytest.raises(Exception, match="no piece"):
        decode_ids(spark.createDataFrame([([32000],)], "ids array<int>"), MODEL).collect()


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(pieces, "SPACE", ord("_"))
    with pytest.raises(ValueError):
        load_model(MODEL)


def test_op12_query(spark, sf, library):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in ((i, library.encode(t)) for i, t in rows)]
    same(QUERIES["op12_pieces"](spark, sf), expected)


# ── 13: prefix trie ─────────────────────────────────────────────────────────

def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, n int")


@pytest.fixture(scope="module")
def dialogues():
    rng = random.Random(7)
    rows = []
    for c in range(120):
        same_start = c % 3 == 0  # a third begin alike
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), "hello there you" if same_start and t < 4 else rng.choice(["a b", "a  b c", "", None, "x\ny"])))
    rows += [(140, t, "user", f"turn {t} of many") for t in range(70)]  # a long one, and its copies
    rows += [(c, t, "user", f"turn {t} of many" + (" end" if t == 50 + c - 141 else "")) for c in range(141, 145) for t in range(70)]
    rows += [(200, None, "user", "no number"), (200, 1, "user", "one"), (None, 1, "user", "no id"), (-7, 0, "user", "minus"), (401, 0, None, None)]
    rows += [(r[0] + 1000, *r[1:]) for r in rows if r[0] is not None and r[0] < 60 and r[0] >= 0]
    return rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_prefix_trie(spark, dialogues, piece, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    same(prefix_trie.prefix_trie(talk(spark, dialogues)), brute.trie(dialogues))


def test_small_tries(spark):
    assert prefix_trie.prefix_trie(talk(spark, [(1, 1, "u", "x")]).limit(0)).collect() == []
    # Conversations whose rebuilt form has no turn, alone and beside others; repeated rows.
    turnless = next(c for c in range(1, 100) if c % 20 and not brute.conversations([(c, 0, "u", "x")])[c])
    for rows in ([(turnless, 0, "u", "x")], [(turnless, 0, "u", "x"), (0, 0, "u", "a b"), (0, 0, "u", "a b")], [(20, 5, None, None)]):
        same(prefix_trie.prefix_trie(talk(spark, rows)), brute.trie(rows))


def test_op13_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    same(QUERIES["op13_prefix_trie"](spark, sf), brute.trie(rows))
