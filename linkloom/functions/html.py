"""Page html → text, title and blocks, as Column expressions.

Regexes are written for both Java regex and RE2 (no back-references, no
look-arounds) so the same definitions run in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags removed before text is made (the reference's excluded tags),
# and the parts a cleaned page has already lost.
EXCLUDED_TAGS = ("nav", "footer", "header", "aside")
CLEANED_TAGS = ("head", "script", "style")

# Block-level tags that split a page into text blocks (our definition, SURVEY §7.3).
BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|article|section|main|table|tr|td|th|blockquote|pre|br|body|html"
BLOCK_SEP = "\u0001"
BLOCK_TAG_RE = r"</?(?:" + BLOCK_TAGS + r")\b[^>]*>"

TAG_RE = r"<[^>]+>"
# A start or end tag (no comment or doctype); elements that have no content.
ANY_TAG_RE = r"</?[A-Za-z][^>]*>"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
COMMENT_RE = r"(?s)<!--.*?-->"
WS_RE = r"(?U)\s+"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
TEXT_CAP = 10_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def element_re(tag: str) -> str:
    """Non-greedy open..close pair of one tag, case-insensitive, across lines."""
    return r"(?is)<" + tag + r"\b[^>]*>.*?</" + tag + r"\s*>"


def drop_flat(html, tags) -> Column:
    """Remove each listed element up to its first end tag: right for elements that cannot nest."""
    c = _col(html)
    for t in tags:
        c = F.regexp_replace(c, element_re(t), " ")
    return c


def _is_flat(html: Column, tags) -> Column:
    """Whether the listed tags only occur as start and end tag of one element after another."""
    names = "|".join(tags)
    seen = F.lower(F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<(/?(?:" + names + r"))\b"), 1), ";"))
    return seen.rlike("^(?:" + "|".join(f"{t};/{t}(?:;|$)" for t in tags) + ")*$")


def drop_subtrees(html, tags=EXCLUDED_TAGS) -> Column:
    """Remove each listed element to its own end.

    A fold over the page's tags with the stack of open elements: an end tag
    closes the nearest open element of its name and all that is open within,
    one without an open element closes nothing. So an element that holds
    others of its name ends at its own end tag, and one that is never closed
    ends with the element around it, or with the page.
    """
    c = _col(html)
    tag = F.regexp_extract_all(c, F.lit(ANY_TAG_RE), 0)
    texts = F.split(c, ANY_TAG_RE, -1)
    events = F.transform(tag, lambda t, i: F.struct(
        t.alias("tag"), F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1)).alias("name"), t.startswith("</").alias("end"),
        F.element_at(texts, i + 2).alias("text")))

    def state(stack, base, out):
        return F.struct(stack.alias("stack"), base.cast("int").alias("base"), out.alias("out"))

    def step(at, e):
        back = F.array_position(F.reverse(at["stack"]), e["name"]).cast("int")
        place = F.when(back > 0, F.size(at["stack"]) - back + 1).otherwise(0)  # of the element that an end tag closes
        shown = F.concat(e["tag"], e["text"])
        closed = state(F.slice(at["stack"], 1, place - 1), F.when((at["base"] > 0) & (place > at["base"]), at["base"]).otherwise(0),
                       F.when((at["base"] > 0) & (place > at["base"]), at["out"]).when((at["base"] > 0) & (place == at["base"]), F.concat(at["out"], F.lit(" "), e["text"]))
                       .when(at["base"] > 0, F.concat(at["out"], F.lit(" "), shown)).otherwise(F.concat(at["out"], shown)))
        unmoved = state(at["stack"], at["base"], F.when(at["base"] > 0, at["out"]).otherwise(F.concat(at["out"], shown)))
        deeper = F.concat(at["stack"], F.array(e["name"]))
        begun = state(deeper, F.size(deeper), at["out"])
        opened = state(deeper, at["base"], unmoved["out"])
        return (F.when(e["end"] & (place > 0), closed).when(e["end"] | e["name"].isin(*VOID_TAGS), unmoved)
                .when((at["base"] == 0) & e["name"].isin(*tags), begun).otherwise(opened))

    start = state(F.array().cast("array<string>"), F.lit(0), F.element_at(texts, 1))
    return F.aggregate(events, start, step, lambda at: F.when(at["base"] > 0, F.concat(at["out"], F.lit(" "))).otherwise(at["out"]))


def drop_elements(html, tags=EXCLUDED_TAGS) -> Column:
    """Remove each listed element with its content (P1); a space takes its place.

    ``head``, ``script`` and ``style`` cannot nest and end at their first end
    tag (unclosed ones stay). For the others a page where they only follow
    one another, as nearly all do, is cut by pattern; any other by
    ``drop_subtrees``. Both give the same where both apply.
    """
    c = drop_flat(html, [t for t in tags if t in CLEANED_TAGS])
    nesting = [t for t in tags if t not in CLEANED_TAGS]
    if not nesting:
        return c
    # The array of one names the text, so that it is made once for the test and the removal.
    return F.get(F.transform(F.array(c), lambda x: F.when(_is_flat(x, nesting), drop_flat(x, nesting)).otherwise(drop_subtrees(x, nesting))), F.lit(0))


def clean_html(html, excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> Column:
    """Comments plus the given elements removed (default: head, script, style
    and the four excluded tags)."""
    return drop_elements(F.regexp_replace(_col(html), COMMENT_RE, " "), excluded)


def collapse_ws(text) -> Column:
    """Python's ``" ".join(s.split())``: whitespace runs → one space, trimmed."""
    return F.trim(F.regexp_replace(_col(text), WS_RE, " "))


def strip_tags(html) -> Column:
    """Every tag → space, whitespace collapsed."""
    return collapse_ws(F.regexp_replace(_col(html), TAG_RE, " "))


def page_text(fit=None, raw=None, html=None, cap: int = TEXT_CAP) -> Column:
    """First non-empty of fit text (verbatim), raw text (collapsed),
    stripped html; then the first ``cap`` characters."""
    parts = []
    if fit is not None:
        parts.append(F.nullif(_col(fit), F.lit("")))
    if raw is not None:
        parts.append(F.nullif(collapse_ws(raw), F.lit("")))
    if html is not None:
        parts.append(F.nullif(strip_tags(html), F.lit("")))
    parts.append(F.lit(""))
    return F.substring(F.coalesce(*parts), 1, cap)


def title_of(html) -> Column:
    """P8 title from the html <title> element ('' when absent)."""
    return collapse_ws(F.regexp_extract(_col(html), TITLE_RE, 1))


def block_pieces(html, excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> Column:
    """B1: array of raw html pieces between block tags, in document order."""
    cleaned = clean_html(html, excluded)
    marked = F.regexp_replace(cleaned, BLOCK_TAG_RE, BLOCK_SEP)
    return F.split(marked, BLOCK_SEP)


def blocks(html, excluded=CLEANED_TAGS + EXCLUDED_TAGS) -> Column:
    """B1: array<struct<piece, text>> of non-empty blocks in document order;
    the array index is the block position."""
    pieces = F.transform(block_pieces(html, excluded), lambda p: F.struct(p.alias("piece"), strip_tags(p).alias("text")))
    return F.filter(pieces, lambda b: b["text"] != F.lit(""))
