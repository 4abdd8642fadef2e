"""Text helpers: cuts, tokens (P9, B2 tokens)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def snippet(text, n: int, newline_to_space: bool = False) -> Column:
    """First ``n`` characters; newlines replaced *after* the cut."""
    c = F.substring(F.coalesce(_col(text), F.lit("")), 1, n)
    if newline_to_space:
        c = F.replace(c, F.lit("\n"), F.lit(" "))
    return c


def tokens(text) -> Column:
    """Lower-cased letter/digit runs, no stemming."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RE), 0)


def goal_terms(goal: str) -> list[str]:
    """Distinct goal tokens in first-seen order (query terms of B2).

    Runs on the driver over one short goal string, not over data.
    """
    import regex

    seen: list[str] = []
    for t in regex.findall(r"[\p{L}\p{N}]+", goal.lower()):
        if t not in seen:
            seen.append(t)
    return seen
