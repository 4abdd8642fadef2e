"""Operator 9: language of pages by Bayesian evidence fusion.

For every page the logarithms of these are added, for every language:

* the text's likelihood: byte triples of the text outside the markup, counted
  by language on a bounded sample of labelled documents. Triples that overlap
  are not independent, so a text counts as at most ``WORTH`` of them;
* how likely the declared language (``lang`` of the ``html`` tag) and the
  address suffix are in pages of that language;
* the host's prior: the languages of the host's other pages, smoothed by
  those of its domain, and these by all pages'.

The last three are estimated from all pages by grouped aggregation of what
the texts say, a page's own text left out of its host, domain and suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import paged_join, slices, with_python, written
from linkloom.llm.url_filter import host_and_path

#: Labelled documents to fit on, and the longest of them in bytes.
SAMPLE, SAMPLE_BYTES = 3000, 16_384
BUCKETS = 1 << 16
WORTH = 40.0
#: Pages that a domain's or all pages' languages count for in a prior.
HOST_WEIGHT, DOMAIN_WEIGHT, SUFFIX_WEIGHT, TAG_WEIGHT = 4.0, 20.0, 20.0, 2.0


def _triples(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


class TextModel:
    """Log probabilities of byte triples by language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        counts = np.full((len(self.langs), BUCKETS), 0.5)
        for text, lang in zip(texts, langs):
            if len(text) > 2:
                counts[self.langs.index(lang)] += np.bincount(_triples(np.frombuffer(text, np.uint8)), minlength=BUCKETS)
        self.log = np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of every row's languages, by its text alone; equal for texts without triples."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.langs)))
        if len(data) > 2 and self.langs:
            log = self.log[_triples(data)]
            whole = np.ones(len(log), bool)
            for back in (1, 2):
                at = offsets[1:-1] - back
                whole[at[(at >= 0) & (at < len(log))]] = False
            total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(log * whole[:, None], 0, dtype=np.float64)])
            n = np.maximum(np.diff(offsets) - 2, 0)
            a, b = np.minimum(offsets[:-1], len(log)), np.minimum(offsets[:-1] + n, len(log))
            out = (total[b] - total[a]) * (np.minimum(n, WORTH) / np.maximum(n, 1))[:, None]
        out = np.exp(out - out.max(1, keepdims=True, initial=-np.inf)) if self.langs else out
        return out / out.sum(1, keepdims=True)


def fit_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """A model of the first ``sample`` labelled documents by hash of the id (null ids and labels left out)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("t") <= SAMPLE_BYTES))
    # The ids first: sorting would send every partition's first texts to the driver.
    picked = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = known.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("lang", "t")).alias("x")).orderBy("id").select("x.*").collect()
    return TextModel([r["t"].encode() for r in rows], [r["lang"] for r in rows])


def page_text(html: Column) -> Column:
    """What stands outside tags, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    """The first part of the html tag's ``lang``, lower-cased; empty without one."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]+)""", 1)
    return F.lower(tag)





def identify_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, lang, probability, text_lang, declared, host.

    Null url or html are empty: no host, no declaration, no text, so that
    the other evidence decides; a page without any has the most frequent
    language. Of equally likely languages the first by name is given. Rows
    may repeat; a model without languages gives null. Other columns are not
    looked at.
    """
    langs, kind = model.langs, pages.schema[id_col].dataType.simpleString()
    cols = [f"p{i}" for i in range(len(langs))]
    host, _ = host_and_path(F.col(url_col))
    seen = pages.select(F.struct(F.col(id_col).alias("id"), host.alias("host"), declared_language(F.col(html_col)).alias("declared")).alias("who"),
                        page_text(F.col(html_col)).alias("t"))
    if not langs:
        none = F.lit(None)
        return seen.select(F.col("who.id").alias(id_col), none.cast("string").alias("lang"), none.cast("double").alias("probability"),
                           none.cast("string").alias("text_lang"), F.col("who.declared").alias("declared"), F.col("who.host").alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "t"):
            p = np.round(model.probabilities(data, offsets), 9)
            yield pa.RecordBatch.from_arrays([batch.column("who"), *(pa.array(p[:, i]) for i in range(len(langs)))], ["who", *cols])

    who = f"who struct<id: {kind}, host: string, declared: string>"
    labels = F.split("host", r"\.")
    read_pages = with_python(seen).mapInArrow(read, ", ".join([who, *(f"{c} double" for c in cols)])).select("who.*", *cols)
    tag = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared") == "", "").otherwise("other")
    table = written(read_pages.withColumn("tag", tag).withColumn("suffix", F.element_at(labels, -1))
                    .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("rid", F.monotonically_increasing_id()), "texts")

    def sums(df: DataFrame, key: str, *more) -> DataFrame:
        return df.groupBy(key).agg(*more, *(F.sum(c).alias(c) for c in cols))

    n_here = F.count(F.lit(1)).alias("n")
    hosts = written(table.groupBy("domain", "suffix", "host").agg(n_here, *(F.sum(c).alias(c) for c in cols)), "hosts")
    n_up = F.sum("n").alias("n")
    total = hosts.agg(n_up, *(F.sum(c).alias(c) for c in cols)).first()
    pages_n = total["n"] or 0
    every = [(total[c] or 0) + 1.0 for c in cols]
    every = [x / sum(every) for x in every]
    # Declarations: as many kinds as languages, and two.
    tags = {r["tag"]: r for r in sums(table, "tag").collect()}
    kinds = [*langs, "", "other"]

    def tag_given(i: int) -> Column:
        # Before any page is seen, a declaration is taken to be right more often than not.
        counts = {k: (tags[k][cols[i]] if k in tags else 0.0) + TAG_WEIGHT * (2.0 if k == langs[i] else 0.2) for k in kinds}
        out = F.lit(counts["other"] / sum(counts.values()))
        for k in kinds[:-1]:
            out = F.when(F.col("tag") == k, counts[k] / sum(counts.values())).otherwise(out)
        return out

    def with_sums(df: DataFrame, few: DataFrame, key: str, to: str) -> DataFrame:
        few = few.select(key, F.col("n").alias(f"{to}_n"), *(F.col(c).alias(f"{to}_{c}") for c in cols))
        return paged_join(df, few, [key], f"{to}_n", pages_n, F.xxhash64("rid"))

    joined = with_sums(table, sums(hosts, "host", n_up), "host", "h")
    joined = with_sums(joined, sums(hosts, "domain", n_up), "domain", "d")
    joined = with_sums(joined, sums(hosts, "suffix", n_up), "suffix", "s")
    logs = []
    for i, c in enumerate(cols):
        rest = lambda to, c=c: F.greatest(F.col(f"{to}_{c}") - F.col(c), F.lit(0.0))  # noqa: E731  the page itself left out
        domain = (rest("d") + DOMAIN_WEIGHT * every[i]) / (F.col("d_n") - 1 + DOMAIN_WEIGHT)
        prior = (rest("h") + HOST_WEIGHT * domain) / (F.col("h_n") - 1 + HOST_WEIGHT)
        # How much likelier the suffix is in this language than in all pages.
        suffix = (rest("s") + SUFFIX_WEIGHT * every[i]) / (F.col("s_n") - 1 + SUFFIX_WEIGHT) / every[i]
        logs.append(F.log(F.col(c) + 1e-9) + F.log(tag_given(i)) + F.log(prior + 1e-12) + F.log(suffix + 1e-12))
    best = joined.select("id", "declared", "host", F.array(*cols).alias("text"), F.array(*logs).alias("logs"))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda values: F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    shares = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))), F.lit(0.0), lambda a, x: a + x)
    return best.select(F.col("id").alias(id_col), pick(F.col("logs")).alias("lang"), F.round(1 / shares, 6).alias("probability"),
                       pick(F.col("text")).alias("text_lang"), "declared", "host")
