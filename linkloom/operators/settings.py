"""F7 on raw text: a session's settings as they are typed.

Each row is one ``key value`` pair. The key is looked up, the text is turned
into the key's type, and the rules are applied to the value; the first of
these that fails gives the message. All of this is row-local but for the two
delays: each is compared with the value of the other that was accepted last,
so the delays of a session (few rows) are walked in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .jobs import VALID_CACHE, VALID_FILTERS, VALID_PROVIDERS, VALID_STRATEGIES, parse_bool

# The keys a session accepts, the setting of each and its type; default delays.
SETTING_KEYS = (("provider", "provider", "text"), ("max-pages", "max_pages", "int"), ("max-depth", "max_depth", "int"), ("min-delay", "min_delay", "float"),
                ("max-delay", "max_delay", "float"), ("strategy", "strategy", "text"), ("filter", "filter", "text"), ("bm25-threshold", "bm25_threshold", "float"),
                ("cache", "cache", "text"), ("stealth", "stealth", "bool"), ("headless", "headless", "bool"), ("score-threshold", "score_threshold", "float"),
                ("include-external", "include_external", "bool"))
DEFAULT_DELAYS = (1.0, 3.0)
INT_RE = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
FLOAT_RE = r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)$"


def quoted(raw: Column) -> Column:
    """Text in quotes as messages show it: single ones, double ones where it holds a single one only."""
    return F.when(raw.contains("'") & ~raw.contains('"'), F.concat(F.lit('"'), raw, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(raw, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _number(raw: Column) -> Column:
    plain = F.lower(F.replace(raw, F.lit("_"), F.lit("")))
    named = F.regexp_replace(plain, r"^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(plain.rlike("nan$"), F.lit(float("nan"))).otherwise(named.try_cast("double"))


def typed_settings(settings: DataFrame) -> DataFrame:
    """``settings`` (key, raw) with field, number, flag and the message of the first row-local rule that fails."""
    key, raw = F.lower(F.trim("key")), F.trim(F.coalesce("raw", F.lit("")))
    find = lambda i: F.element_at(F.create_map(*[F.lit(x) for k in SETTING_KEYS for x in (k[0], k[i])]), key)
    df = settings.withColumns({"key": key, "raw": raw, "field": find(1), "_kind": find(2)})
    key, raw, field, kind = F.col("key"), F.col("raw"), F.col("field"), F.col("_kind")
    is_int, is_float = raw.rlike(INT_RE), raw.rlike(FLOAT_RE)
    df = df.withColumns({"number": F.when(((kind == "int") & is_int) | ((kind == "float") & is_float), _number(raw)), "flag": F.when(kind == "bool", parse_bool(raw))})
    n = F.col("number")
    invalid = lambda what: F.concat(F.lit("Invalid value for '"), key, F.lit("': "), what)
    between = lambda name, low, high, shown: F.when((field == name) & ~((n >= low) & (n <= high) & ~F.isnan(n)), F.lit(f"{name} must be between {shown}"))
    one_of = lambda name, valid: F.when((field == name) & ~raw.isin(*valid), F.lit(f"{name} must be one of: {', '.join(valid)}"))
    message = F.coalesce(
        F.when(field.isNull(), F.concat(F.lit("Unknown key '"), key, F.lit(f"'.  Valid keys: {', '.join(k[0] for k in SETTING_KEYS)}"))),
        F.when((kind == "bool") & F.col("flag").isNull(), invalid(F.concat(F.lit("expected true/false, got '"), raw, F.lit("'")))),
        F.when((kind == "int") & ~is_int, invalid(F.concat(F.lit("invalid literal for int() with base 10: "), quoted(raw)))),
        F.when((kind == "float") & ~is_float, invalid(F.concat(F.lit("could not convert string to float: "), quoted(raw)))),
        one_of("provider", VALID_PROVIDERS), one_of("strategy", VALID_STRATEGIES), one_of("filter", VALID_FILTERS), one_of("cache", VALID_CACHE),
        between("max_depth", 0, 10, "0 and 10"), between("max_pages", 1, 10000, "1 and 10000"), between("min_delay", 0, 60, "0 and 60"),
        between("max_delay", 0, 60, "0 and 60"), F.when((field == "bm25_threshold") & (n <= 0), F.lit("bm25_threshold must be > 0")),
        between("score_threshold", 0, 1, "0.0 and 1.0"))
    return df.withColumn("message", message).drop("_kind")


def _walk_delays(batches: Iterator) -> Iterator:
    """Messages of delays that cross the other one; rows come by session, in order."""
    import pandas as pd

    session, low, high = object(), *DEFAULT_DELAYS
    for pdf in batches:
        out = []
        for s, field, value in zip(pdf["session_id"], pdf["field"], pdf["number"]):
            if s != session:
                session, low, high = s, *DEFAULT_DELAYS
            crossed = value > high if field == "min_delay" else value < low
            out.append(None if not crossed else "min_delay must be <= max_delay" if field == "min_delay" else "max_delay must be >= min_delay")
            if not crossed and field == "min_delay":
                low = value
            elif not crossed:
                high = value
        yield pd.DataFrame({"session_id": pdf["session_id"], "seq": pdf["seq"], "crossed": pd.Series(out, dtype=object)})


def settings_outcomes(settings: DataFrame) -> DataFrame:
    """One row per setting (session_id, seq, key, raw): field, message ('' when it is accepted), number, flag.

    ``seq`` orders a session's settings (distinct within one); sessions begin
    with the default delays. Only delays in their own range are compared.
    """
    ship_package(settings.sparkSession)
    typed = typed_settings(settings)
    delays = typed.filter(F.col("field").isin("min_delay", "max_delay") & F.col("message").isNull()).select(F.col("session_id").cast("string").alias("session_id"), "seq", "field", "number")
    walked = delays.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(_walk_delays, "session_id string, seq long, crossed string")
    j = typed.withColumn("_s", F.col("session_id").cast("string")).join(walked.withColumnRenamed("session_id", "_s"), ["_s", "seq"], "left")
    return j.select("session_id", "seq", "key", "raw", "field", F.coalesce("message", "crossed", F.lit("")).alias("message"), "number", "flag")


def session_config(outcomes: DataFrame) -> DataFrame:
    """The accepted settings that hold in the end: per session and field the raw text accepted last."""
    ok = outcomes.filter((F.col("message") == "") & F.col("field").isNotNull())
    return ok.groupBy("session_id", "field").agg(F.max_by("raw", "seq").alias("raw"))
