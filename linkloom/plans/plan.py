"""Crawl plans: prompt text, parsing of model responses, plan application
and plan display (L1-L3, L8).

Model calls are a seam: responses arrive as a table (job_id, seed_urls,
raw). Parsing reproduces the reference's three outcomes with VARIANT:
  * ``fallback``   - the text is not JSON (or has text after the value):
                     summary "AI plan unavailable", every given seed at 0.5;
  * ``plan_error`` - JSON but not a usable plan (not an object, a seed
                     without url, a score that is null or not a number):
                     the crawl runs unplanned;
  * ``ok``         - the plan, with defaults (score 0.5, reason '', lists []).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import format_fixed
from ..functions.json import json_value

# The reference's fallback summary, default seed score and mode line.
FALLBACK_SUMMARY = "AI plan unavailable"
DEFAULT_SEED_SCORE = 0.5
EXTERNAL_MODE_LINE = "Mode: external-first (aggregator site)"


def ascii_escape(text: Column) -> Column:
    """Non-ASCII characters as ``\\uXXXX`` (surrogate pairs above U+FFFF), as
    Python's ``json.dumps`` writes them by default."""
    chars = F.regexp_extract_all(text, F.lit(r"(?s)."), 0)  # one element per code point

    def one(c):
        cp = F.ascii(c)
        hx = lambda v: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(v), 4, "0")))
        hi = F.lit(0xD800) + F.shiftright(cp - F.lit(0x10000), 10)
        lo = F.lit(0xDC00) + ((cp - F.lit(0x10000)) % F.lit(1024))
        return F.when(cp < 128, c).when(cp <= 0xFFFF, hx(cp)).otherwise(F.concat(hx(hi), hx(lo)))

    return F.array_join(F.transform(chars, one), "")


def json_string_list(arr) -> Column:
    """Python ``json.dumps(list_of_str)``: '["a", "b"]' with ", " between
    items and non-ASCII characters escaped."""
    a = F.col(arr) if isinstance(arr, str) else arr
    items = F.transform(a, lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""))
    return ascii_escape(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def plan_prompts(jobs: DataFrame) -> DataFrame:
    """L1: one prompt per job from goal, seed list (JSON) and max depth."""
    prompt = F.concat(
        F.lit("Goal: "), F.coalesce(F.col("goal"), F.lit("")), F.lit("\nSeed URLs: "), json_string_list("seed_urls"),
        F.lit("\nMax depth: "), F.col("max_depth").cast("string"), F.lit("\n\nProduce the crawl plan JSON."))
    return jobs.select("job_id", prompt.alias("prompt"))


def _vtype(v: Column) -> Column:
    return F.when(v.isNull(), F.lit(None)).otherwise(F.schema_of_variant(v))


def _truthy(v: Column) -> Column:
    """Python ``bool()`` of a JSON value (absent → False)."""
    t = _vtype(v)
    return (F.when(v.isNull(), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "VOID", F.lit(False))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), F.to_json(v) != "{}")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False))))


def _seed_score(s: Column) -> Column:
    """``float(s.get("score", 0.5))``; NULL marks a value float() rejects."""
    sc = F.try_variant_get(s, "$.score", "variant")
    t = _vtype(sc)
    as_text = F.try_variant_get(sc, "$", "string")
    return (F.when(sc.isNull(), F.lit(DEFAULT_SEED_SCORE))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(sc, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(t == "STRING", F.trim(as_text).try_cast("double"))
            .when(t.isin("VOID") | t.startswith("ARRAY") | t.startswith("OBJECT"), F.lit(None).cast("double"))
            .otherwise(F.try_variant_get(sc, "$", "double")))


def parse_plans(responses: DataFrame) -> DataFrame:
    """L2: responses (job_id, seed_urls, raw) → outcome + plan columns
    (summary, prioritized_seeds array<struct<url, score, reason>>,
    avoid_patterns, focus_patterns, prefer_external). plan_error rows carry
    NULL plan columns."""
    raw = F.col("raw")
    p = responses.select("job_id", "seed_urls", raw, json_value(raw).alias("_v"))
    pv = F.col("_v")
    is_obj = _vtype(pv).startswith("OBJECT")
    seeds_v = F.try_variant_get(pv, "$.prioritized_seeds", "variant")
    seeds_t = _vtype(seeds_v)
    seed_items = F.try_variant_get(seeds_v, "$", "array<variant>")
    seeds = F.transform(seed_items, lambda s: F.struct(
        F.try_variant_get(s, "$.url", "string").alias("url"), _seed_score(s).alias("score"),
        F.coalesce(F.try_variant_get(s, "$.reason", "string"), F.lit("")).alias("reason"),
        (_vtype(s).startswith("OBJECT") & F.try_variant_get(s, "$.url", "variant").isNotNull()).alias("_has_url")))
    bad_seed = F.exists(seeds, lambda s: ~s["_has_url"] | s["score"].isNull())
    seeds_ok = seeds_v.isNull() | (seeds_t.startswith("ARRAY") & ~F.coalesce(bad_seed, F.lit(False)))
    p = p.withColumn("_seeds", seeds)
    outcome = (F.when(pv.isNull(), F.lit("fallback"))
               .when(~is_obj | ~seeds_ok, F.lit("plan_error"))
               .otherwise(F.lit("ok")))
    strs = "array<string>"
    fallback_seeds = F.transform("seed_urls", lambda u: F.struct(
        u.alias("url"), F.lit(DEFAULT_SEED_SCORE).alias("score"), F.lit("").alias("reason")))
    ok_seeds = F.transform(F.coalesce(F.col("_seeds"), F.array()), lambda s: F.struct(
        s["url"].alias("url"), s["score"].alias("score"), s["reason"].alias("reason")))
    empty = F.array().cast(strs)
    out = p.select(
        "job_id", "seed_urls", outcome.alias("outcome"),
        F.coalesce(F.try_variant_get(pv, "$.summary", "string"), F.lit("")).alias("_summary"),
        ok_seeds.alias("_ok_seeds"), fallback_seeds.alias("_fb_seeds"),
        F.coalesce(F.try_variant_get(pv, "$.avoid_patterns", strs), empty).alias("_avoid"),
        F.coalesce(F.try_variant_get(pv, "$.focus_patterns", strs), empty).alias("_focus"),
        _truthy(F.try_variant_get(pv, "$.prefer_external", "variant")).alias("_pe"))
    o = F.col("outcome")
    return out.select(
        "job_id", "outcome",
        F.when(o == "ok", F.col("_summary")).when(o == "fallback", F.lit(FALLBACK_SUMMARY)).alias("summary"),
        F.when(o == "ok", F.col("_ok_seeds")).when(o == "fallback", F.col("_fb_seeds")).alias("prioritized_seeds"),
        F.when(o == "ok", F.col("_avoid")).when(o == "fallback", empty).alias("avoid_patterns"),
        F.when(o == "ok", F.col("_focus")).when(o == "fallback", empty).alias("focus_patterns"),
        F.when(o == "ok", F.col("_pe")).when(o == "fallback", F.lit(False)).alias("prefer_external"))


def usable_plans(parsed: DataFrame) -> DataFrame:
    """L3: plans that apply to a crawl (plan_error → the job runs unplanned)."""
    return parsed.filter(F.col("outcome") != "plan_error")


def plan_view(plans: DataFrame) -> DataFrame:
    """The plan as display lines (summary, focus, avoid, mode, seeds with
    '%.1f' scores as Python prints them)."""
    def seed_line(s):
        reason = F.when(s["reason"] != "", F.concat(F.lit("  "), s["reason"])).otherwise(F.lit(""))
        return F.concat(F.lit("  "), format_fixed(s["score"], 1), F.lit("  "), s["url"], reason)

    seeds = F.coalesce(F.col("prioritized_seeds"), F.array())
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Summary: "), F.col("summary")),
        F.when(F.size("focus_patterns") > 0, F.concat(F.lit("Focus: "), F.array_join("focus_patterns", ", "))),
        F.when(F.size("avoid_patterns") > 0, F.concat(F.lit("Avoid: "), F.array_join("avoid_patterns", ", "))),
        F.when(F.col("prefer_external"), F.lit(EXTERNAL_MODE_LINE)),
        F.when(F.size(seeds) > 0, F.concat(F.lit("Seeds:\n"), F.array_join(F.transform(seeds, seed_line), "\n"))))
    return plans.select("job_id", lines.alias("view"))
