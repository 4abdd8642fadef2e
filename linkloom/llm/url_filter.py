"""Operator 6: URL rules by Bloom filter cascades.

A rule is (host, path, verdict); it fits its host and all subdomains when
the url's path starts with the rule's path, and the longest fitting rule
wins. A url is looked up by its *candidate keys*: each host ending with as
many labels as some rule has, followed by each path prefix as long as some
rule's path. For each verdict a cascade answers "is this key listed?":
level 0 holds the listed keys, level 1 the keys of the corpus that level 0
wrongly takes for listed, level 2 the listed keys that level 1 wrongly
takes, and so on until no key is wrong. Over all keys that occur in the
corpus (the universe the cascade is built for) the answer is exact, and
looking up is arithmetic on literal bit arrays: no join.

The levels together have about ``1.44 * n * log2(universe / n)`` bits for n
listed keys; a level is one binary literal. A list whose first level would
have more than ``MAX_BITS`` is cut into parts by a hash of the key: a cascade
for each part, looked up one part after the other over the same urls. So a
plan's literals are bounded, and however long the list is nothing is joined.
Everything is DataFrame code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written

#: Bits that the first level of a cascade may have in a plan (4 MiB); the others are smaller.
MAX_BITS = 1 << 25


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The url's host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys under which a rule could be listed that fits the url, longest first."""
    ends = F.filter(F.array(*[F.lit(k) for k in labels]), lambda k: (_labels(host) >= k) & (F.length(host) > 0))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(ends, lambda k: F.transform(cuts, lambda n: F.concat(F.call_function("substring_index", host, F.lit("."), -k), F.call_function("substring", path, F.lit(1), n)))))
    return F.transform(F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))), lambda x: x["key"])


class Level:
    """One Bloom filter: positions of a key, and its bits once built."""

    def __init__(self, n: int, rate: float, seed: int):
        self.size = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
        self.hashes = max(1, round(self.size / max(1, n) * math.log(2))) if rate < 0.5 else 1
        self.hashes, self.seed, self.bits = min(self.hashes, 30), seed, None

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 100 + i)), F.lit(self.size)) for i in range(self.hashes)]

    def build(self, keys: DataFrame) -> Level:
        """Sets the bits of ``keys`` (key); at most size / 64 words come back."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).collect()
        bits = np.zeros(self.size // 64, "<i8")
        for w, b in words:
            bits[w] = b
        self.bits = bits.tobytes()
        return self

    def holds(self, key: Column) -> Column:
        bits, yes = F.lit(self.bits), F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.call_function("substring", bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            yes = yes & (F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return yes


def first_level(n: int, universe: int, seed: int) -> Level:
    """The first level of a cascade for n keys listed of a universe of so many."""
    return Level(n, min(0.5, n / (math.sqrt(2) * max(n, universe))), seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Level]:
    """Levels that tell ``listed`` (key, distinct) from the rest of ``universe`` (key)."""
    n = listed.count()
    if not n:
        return []
    levels = [first_level(n, universe.agg(F.approx_count_distinct("key")).first()[0], seed).build(listed)]
    inside, other = listed, universe
    while True:
        # What the last level takes wrongly: first from the universe, then from the two sides in turn.
        wrong = other.filter(levels[-1].holds(F.col("key")))
        if len(levels) == 1:
            wrong = wrong.distinct().join(listed, "key", "left_anti")
        wrong = written(wrong, "cascade")
        n = wrong.count()
        if not n:
            return levels
        levels.append(Level(n, 0.5, seed + len(levels)).build(wrong))
        inside, other = wrong, inside


def in_cascade(levels: list[Level], key: Column) -> Column:
    answer = F.lit(False)
    for level in reversed(levels):
        answer = level.holds(key) & ~answer
    return answer


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *,
               default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``rules``: host, path (null: ``/``), verdict (allow or block). A url
    that no listed key fits isn't in any cascade and gets ``default``; its
    rule is null. A rule listed as both is taken as block; rules with a null
    or empty host or another verdict fit nothing. Null urls and urls without
    ``://`` have empty host and path and fit nothing. No rules, no pages and
    further columns are fine.
    """
    rules = written(rules.filter("host <> '' and verdict in ('allow', 'block')").select(
        F.lower("host").alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("host", "path")), "rules")
    # Label counts and path lengths of rules: as many as a host has labels or a path letters.
    labels = sorted(r[0] for r in rules.select(_labels(F.col("host"))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not labels:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    largest = max([0, *(r[0] for r in rules.groupBy("verdict").count().select("count").collect())])
    parts = math.ceil(first_level(largest, universe.agg(F.approx_count_distinct("key")).first()[0], 0).size / max(1, max_bits))
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    keyed = keyed.withColumn("hit", none)
    for part in range(parts):
        mine = lambda k: F.lit(True) if parts == 1 else F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts)) == part  # noqa: E731,B023
        own = rules.filter(mine(F.col("key")))
        block, allow = (build_cascade(own.filter(F.col("verdict") == v).select("key"), universe.filter(mine(F.col("key"))), seed)
                        for seed, v in ((0, "block"), (1000, "allow")))
        verdict_of = lambda k: F.when(in_cascade(block, k), "block").when(in_cascade(allow, k), "allow")  # noqa: E731,B023
        found = F.transform(F.filter("keys", mine), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict_of(k).alias("verdict")))
        hit = F.get(F.filter(found, lambda x: x["verdict"].isNotNull()), F.lit(0))  # keys come longest first
        keyed = keyed.withColumn("hit", F.greatest("hit", hit) if parts > 1 else hit)
        if parts > 1:
            keyed = written(keyed, "judged")
    return keyed.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
