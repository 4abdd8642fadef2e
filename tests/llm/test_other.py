"""Operators 2, 4, 5, 6, 7 and 9, and the pipeline."""

import gc
import random
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from linkloom.llm import decontaminate
from linkloom.llm.decontaminate import align, drop_leaks, find_leaks
from linkloom.llm.language_id import TextModel, fit_text, identify_languages
from linkloom.llm.packing import Words, best_fit_runs, pack
from linkloom.llm.perspectives import rotate_perspectives
from linkloom.llm.quality_cnn import Model, fit_quality, keep_quality, score_quality
from linkloom.llm.queries import URL_RULES, table, tokenizer_path
from linkloom.llm.url_filter import judge_urls

DOCS = "doc_id long, text string, score double, id int, t string, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", 2) for i, t in rows], DOCS)


# 2 ------------------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert all(held) and len(got) > 80
    assert (got.predicted == got.quality).mean() > 0.93
    assert got.predicted[got.quality == 1].mean() > 0.95 and got.predicted[got.quality == 0].mean() < 0.35


def test_quality_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "words here. " * 20), (4, "a"), (4, "a"), (5, "long " * 30_000)]
    docs = docs_of(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, none)
    got = score_quality(docs, model)
    assert sorted((r.score, r.predicted) for r in got.collect()) == [(0.5, 1)] * 6
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == 6
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (5, 1, 0)], none.schema)
    assert fit_quality(docs, labels).score(np.zeros(0, np.uint8), np.array([0, 0]))[0] > 0.9
    assert score_quality(docs_of(spark, []), model).collect() == []


def test_quality_does_not_depend_on_neighbours():
    model, rng = Model(3), np.random.default_rng(1)
    texts = [rng.integers(32, 120, n).astype(np.uint8) for n in (0, 1, 255, 256, 257, 513, 5000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = model.score(np.concatenate(texts), offsets)
    alone = [model.score(t, np.array([0, len(t)]))[0] for t in texts]
    np.testing.assert_allclose(together, alone, atol=1e-6)


# 4 ------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_words_equal_the_tokenizer(tokenizer):
    texts = ["Plain words, and signs... (a-b)!", "Ünïcode'S don't ’x’ <|endoftext|> 123 a1b İstanbul ΣΑΣ é 　 日本語 \x1c q", "", " \n", "é\x85b\xa0c",
             "hello,world ab<|endoftext|>cd", "THER!! ATNTNT,!! a.b,c ''x x' y'' _a_b 12.5%", "ÀÉß.Ö,\x0bx\x0cy z-w", "e\u0301 x"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, "<u4").tolist() for b in Words(tokenizer_path())(texts)]
    assert got == expected


def test_words_of_any_signs_are_cut_as_arrays(tokenizer):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aZéÀßÿ .,'<|>!12_-\t÷×\x0b\x1c\x7f\x00\x85\xa0日’İ́Σª" if i % 2 else "aZéÀßÿ .,!12_-\n") for _ in range(rng.randint(0, 40)))
             for i in range(3000)]
    raw = [t.encode() for t in texts]
    got = Words(tokenizer_path()).rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def best_fit_decreasing(sizes, cap):
    gaps = []
    for s in sorted(sizes, reverse=True):
        best = min((g for g in gaps if g >= s), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((cap if best is None else best) - s)
    return len(gaps)


def test_pack(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "two,", "Three", "trés"]) for _ in range(rng.choice([1, 5, 40, 300, 1500])))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "w " * 9000), (3, rows[3][1]), (None, "no id")]
    got = [r.asDict() for r in pack(docs_of(spark, rows).repartition(5), tokenizer_path()).collect()]
    pieces = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(i, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(pieces, key=repr)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= best_fit_decreasing([p[3] for p in pieces], 4096) + 1
    assert pack(docs_of(spark, []), tokenizer_path()).collect() == []


def test_best_fit_runs_equal_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        cap = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 200))]
        runs = best_fit_runs({s: sizes.count(s) for s in set(sizes)}, cap)
        fill = {}
        for length, n, first, offset in sorted(zip(runs["length"], runs["n"], runs["sequence"], runs["offset"]), key=lambda x: x[3]):
            for s in range(first, first + n):
                assert fill.get(s, 0) == offset
                fill[s] = offset + length
        assert sum(fill.values()) == sum(sizes) and all(v <= cap for v in fill.values())
        assert len(fill) <= best_fit_decreasing(sizes, cap) * 1.02 + 1


# 5 ------------------------------------------------------------------------------------------------------------------

def test_rotation_of_odd_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann B", "hi <|im_end|>"), (1, 2, "Bob", None), (1, 2, "Bob", None), (1, None, "Ann B", "first"),
            (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 1, "Ann", "x"), (None, 0, "Bob", "y")]
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    texts = {}
    for r in sorted(got, key=lambda r: r.pos):
        text, masks = texts.setdefault((r.conv_id, r.perspective), ["", []])
        assert r.start == len(text) and r.stop == r.start + len(r.segment)
        texts[r.conv_id, r.perspective][0] = text + r.segment
        if r.mask_start is not None:
            masks.append((r.mask_start, r.mask_stop))
    assert set(texts) == {(1, "Ann_B"), (1, "Bob"), (1, "unknown"), (None, "Ann"), (None, "Bob")}
    text, masks = texts[1, "Ann_B"]
    assert text.startswith("<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>system\nbe kind")
    assert [text[a:b] for a, b in masks] == ["first<|im_end|>", "hi < |im_end|><|im_end|>"]
    assert text.count("user name=Bob\n<|im_end|>") == 2
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


def test_rotation_over_many_blocks(spark):
    rows = [(7, i, "ab"[i % 2], "t" * (i % 9)) for i in range(3000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).filter("perspective = 'a'").orderBy("pos").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [r.pos for r in got] == list(range(3000)) and [r.turn for r in got] == list(range(3000))
    assert all(x.stop == y.start for x, y in zip(got, got[1:]))


# 6 ------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1 << 25, 24])  # 24: several cascades, one after the other
def test_urls(spark, bits):
    urls = {None: ("", "", None, "allow"), "no scheme.net/": ("", "", None, "allow"), "http://a.NET": ("a.net", "", None, "allow"),
            "http://a.NET/x?y": ("a.net", "/x", "net/", "block"), "https://net/#": ("net", "/", "net/", "block"), "http://xnet/": ("xnet", "/", None, "allow"),
            "http://example.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"), "http://b.example.net/EN/1": ("b.example.net", "/EN/1", "net/", "block"),
            "x://w.example.com/de/?q": ("w.example.com", "/de/", "example.com/de/", "block"), "http://example.com/de": ("example.com", "/de", None, "allow"),
            "http://é.org/fr/é": ("é.org", "/fr/é", "org/fr/", "allow"), "://?": ("", "", None, "allow"), "http://a.net:80/": ("a.net:80", "/", None, "allow")}
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id int, url string, host string, rule string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("org", "/fr/", "other")], "host string, path string, verdict string")
    got = judge_urls(pages, rules, max_bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *x) for i, x in enumerate(urls.values())] * 2, key=repr)
    assert judge_urls(pages.limit(0), rules, max_bits=bits).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_of_many_keys(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.{rng.choice('abc')}.com" for i in range(3000)]
    listed = {h: rng.choice(["block", "allow"]) for h in rng.sample(hosts, 700)}
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id int, url string")
    rules = spark.createDataFrame([(h, "/", v) for h, v in listed.items()], "host string, path string, verdict string")
    got = {r.host: (r.rule, r.verdict) for r in judge_urls(pages, rules, default="none").collect()}
    assert got == {h: (h + "/" if h in listed else None, listed.get(h, "none")) for h in hosts}


def test_half_a_million_rules(spark):
    """One cascade, one binary literal: in two minutes at most, and no join in the plan."""
    import time

    n = 500_000
    rules = spark.range(n).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 5 == 0, "allow").otherwise("block").alias("verdict"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") * 77, F.lit(".net/x")).alias("url"))
    began = time.time()
    df = judge_urls(pages, rules, default="none")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().replace("array_join", "")
    got = {r.page_id: (r.rule, r.verdict) for r in df.collect()}
    assert time.time() - began < 120
    listed = lambda i: i * 77 % 2 == 0 and i * 77 < 2 * n
    assert got == {i: (f"h{i * 77}.net/", "allow" if i * 77 // 2 % 5 == 0 else "block") if listed(i) else (None, "none") for i in range(20_000)}


# 7 ------------------------------------------------------------------------------------------------------------------

def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(8)
    pairs = [(rng.integers(2, 9, rng.integers(1, 40)).astype(np.uint64), rng.integers(2, 9, rng.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
    got = align([a for a, _ in pairs], [b for _, b in pairs])
    np.testing.assert_allclose(got, [brute.smith_waterman(a.tolist(), b.tolist()) for a, b in pairs])


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(80))
    item = [word() for _ in range(30)]
    fill = lambda n: [word() for _ in range(n)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    rows = [(1, " ".join(fill(50) + item + fill(50))), (2, " ".join(fill(9) + edited + fill(9)).upper()), (3, " ".join(fill(200))), (4, None), (5, ""),
            (6, "; ".join(item[:29])), (7, " ".join(fill(20_000) + item)), (8, " ".join(item[:9] + fill(60))), (1, " ".join(item)), (9, " ".join(item + edited))]
    items = spark.createDataFrame([(10, " ".join(item), "x"), (10, " ".join(item), "y"), (11, "too short"), (12, None), (13, " ".join(fill(40)))][:2] + [], "item_id long, text string, id string")
    items = items.unionByName(spark.createDataFrame([(11, "too short", "x"), (12, None, "x"), (13, " ".join(fill(40)), "x")], items.schema))
    docs = docs_of(spark, rows)
    got = find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 10) for i in (1, 1, 2, 6, 7, 9)]
    assert max(r.score for r in got) == 1.0
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert find_leaks(docs, items.limit(0)).collect() == [] and find_leaks(docs.limit(0), items).collect() == []


@pytest.mark.parametrize("copies", [9, 100, 3000])
def test_leaks_of_a_copy_in_many_documents(spark, copies):
    item = [f"w{i}" for i in range(40)]
    edited = [f"other{i}" if i in (5, 14, 23, 32) else w for i, w in enumerate(item)]
    for passage, score in ((item[:28], 0.7), (edited, 0.85)):
        rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(9)), *passage, *(f"b{i}x{j}" for j in range(9))])) for i in range(copies)]
        # Stock phrases of the item are no copy.
        stock = [(copies + i, " ".join(w for j in (0, 2, 3, 5, 6, 8) for w in [*item[3 * j:3 * j + 3], *(f"c{j}y{k}" for k in range(7))])) for i in range(20)]
        items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        got = find_leaks(docs_of(spark, rows + stock), items).collect()
        assert sorted((r.doc_id, r.score) for r in got) == [(i, score) for i in range(copies)]
        assert drop_leaks(docs_of(spark, rows + stock), items).count() == len(stock)


def test_leaks_equal_alignment_of_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    items = [[word() for _ in range(rng.randint(12, 40))] for _ in range(25)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 150))]
        edited = [w for x in items[i % 25] for w in ([x], [x, word()], [word()], [])[rng.choices(range(4), (8, 2, 1, 1))[0]]]
        docs.append(text + edited + [word() for _ in range(rng.randint(0, 400))])
    got = find_leaks(docs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    triples = lambda x: {tuple(x[j:j + 3]) for j in range(len(x) - 2)}
    want = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            score = brute.smith_waterman(x, d)
            if triples(x) & triples(d) and score >= max(6, len(x) / 2):
                want[i, j] = round(score / len(x), 4)
    assert len(want) > 40 and {(r.doc_id, r.item_id): r.score for r in got.collect()} == want


def test_leaks_of_short_items(spark):
    docs = docs_of(spark, [(1, "x One, two three four five y one two three four five"), (2, "one two three four six"), (3, "two three"), (4, "three"), (5, "two"), (6, "three four five"), (7, None)])
    items = spark.createDataFrame([(1, "one two three four FIVE"), (2, "two three"), (3, "two three"), (4, "six"), (5, ""), (6, None), (7, "a b c d e f")], "item_id long, text string")
    got = sorted(tuple(r) for r in find_leaks(docs, items).collect())
    assert got == [(1, 1, 1.0, 1, 6), (1, 2, 1.0, 2, 4), (1, 3, 1.0, 2, 4), (2, 2, 1.0, 1, 3), (2, 3, 1.0, 1, 3), (2, 4, 1.0, 4, 5), (3, 2, 1.0, 0, 2), (3, 3, 1.0, 0, 2)]
    assert sorted(r.doc_id for r in drop_leaks(docs, items).collect()) == [4, 5, 6, 7]


def test_leaks_block_by_block(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    want, kept = sorted(map(tuple, find_leaks(docs, items).collect())), sorted(map(tuple, drop_leaks(docs, items).collect()), key=repr)
    real, made, others = decontaminate.Index.__init__, [], []

    def init(self, *given):
        gc.collect()
        others.append(sum(r() is not None for r in made))
        made.append(weakref.ref(self))
        real(self, *given)

    monkeypatch.setattr(decontaminate.Index, "__init__", init)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == want
    got = drop_leaks(docs, items)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=repr) == kept
    assert len(made) > 5 and max(others) <= 1  # blocks that the driver still holds while it makes another


def test_leaked_items_of_the_table_are_found(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    verbatim = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert verbatim and verbatim <= got


# 9 ------------------------------------------------------------------------------------------------------------------

def test_languages_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = table(spark, sf, "pages")
    got = identify_languages(pages, fit_text(table(spark, sf, "documents")))
    # The path names the language; it is no evidence.
    both = got.join(pages.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("true")), "page_id").toPandas()
    assert (both.lang == both.true).mean() > 0.97
    assert both.probability.between(0, 1).all()


def test_evidence_is_fused(spark):
    model = TextModel([b"the cat and the dog " * 40, "le chat et le chien é ".encode() * 40], ["en", "fr"])
    rows = [(i, f"http://a.fr/{i}", "<p>le chat et le chien</p>") for i in range(30)]
    rows += [(100, "http://a.fr/x", ""), (101, None, None), (102, "http://b.com/", '<HTML class=x lang="EN-us"><p></p>'), (103, "http://b.com/", "<script>le chat</script>the dog"), (103, "http://b.com/", "<script>le chat</script>the dog")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id int, url string, html string, host string, lang string")
    got = {r.page_id: r for r in identify_languages(pages, model).collect()}
    assert got[100].lang == "fr" and got[0].lang == "fr" and got[102].declared == "en" and got[103].lang == "en" and got[103].text_lang == "en"
    assert got[101].host == "" and identify_languages(pages, model).count() == len(rows)
    assert identify_languages(pages.limit(0), model).collect() == []
    assert {r.lang for r in identify_languages(pages, TextModel([], [])).collect()} == {None}


# pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline(spark, sf, tokenizer):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    seen, now = [set(rows)], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        kept = now.collect()
        assert all(r == rows[r.doc_id] for r in kept)
        seen.append({r.doc_id for r in kept})
    start, good, exact, near, clean = seen
    groups = {}
    for i in good:
        groups[rows[i].text] = max(i, groups.get(rows[i].text, i))
    assert exact == set(groups.values())
    assert near == {i for i, _, c in brute.near([(i, rows[i].text) for i in sorted(exact)]) if i == c}
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    leaked = {i for i in near if any(t in rows[i].text for t in items)}
    assert leaked and not leaked & clean and len(clean) >= len(near) - 3 * len(leaked)
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in good) > 0.95 * sum(v == 1 for v in labels.values())
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == clean
    assert sum(r.length for r in got) == sum(len(tokenizer.encode(rows[i].text, add_special_tokens=False).ids) + 1 for i in clean)
