"""Strict JSON: text that is exactly one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(raw: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing more, else NULL.

    The variant parser stops after the first value, so the text is parsed as
    the only element of a list and as the last member of an object: what
    follows the value breaks one or the other. NaN and Infinity, which
    Python's parser also takes, are not JSON here.
    """
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")) == 1
    last = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.when(alone & last, F.try_parse_json(raw))
