"""URL functions: authority, href resolution, avoid filters, scorers
(C1-C4, F1, F2, F6, P4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
# Library form accepts double-quoted, single-quoted and bare href values.
HREF_RE = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

# The reference's default avoid patterns (regex search, case-sensitive).
DEFAULT_AVOID_PATTERNS = (
    r"/login\b", r"/logout\b", r"/signin\b", r"/signup\b", r"/register\b",
    r"/vote[?/]", r"/upvote\b", r"/downvote\b",
    r"/hide[?/]", r"/flag[?/]", r"/report\b",
    r"/user[?/]", r"/profile[?/]", r"/account[?/]",
    r"/from\?", r"/submit\b",
    r"/faq\b", r"/guidelines\b", r"/legal\b", r"/privacy\b", r"/terms\b",
    r"^mailto:",
)
DEFAULT_AVOID_RE = "|".join(DEFAULT_AVOID_PATTERNS)

# Scorer constants.
SEED_HOST_BASE, OTHER_HOST_BASE, FOCUS_BONUS = 0.2, 0.9, 0.3
FOCUS_HIT, FOCUS_MISS = 0.8, 0.4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def authority(url) -> Column:
    """Lower-cased netloc, keeping port and userinfo ('' when relative)."""
    return F.lower(F.regexp_extract(_col(url), AUTHORITY_RE, 1))


def resolve(href, base) -> Column:
    """Resolve an href against its page url."""
    h, b = _col(href), _col(base)
    origin = F.regexp_extract(b, ORIGIN_RE, 0)
    scheme = F.regexp_extract(b, SCHEME_RE, 0)
    path = F.regexp_extract(b, PATH_RE, 1)
    directory = F.regexp_replace(path, r"[^/]*$", "")
    directory = F.when(directory == "", F.lit("/")).otherwise(directory)
    return (F.when(h.rlike(SCHEME_RE), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("#"), h)
            .otherwise(F.concat(origin, directory, h)))


def hrefs(html) -> Column:
    """Raw href values of <a> tags in document order (quotes removed)."""
    raw = F.regexp_extract_all(_col(html), F.lit(HREF_RE), 1)

    def unquote(v):
        quoted = v.startswith('"') | v.startswith("'")
        return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return F.transform(raw, unquote)


def out_links(html, url) -> Column:
    """Resolved links, internal first then external, empty hrefs skipped,
    no dedupe. array<struct<ext:boolean, pos:int, href:string, url:string>>,
    sorted so that the array index is the link position."""
    src_auth = authority(url)
    items = F.transform(hrefs(html), lambda h, i: F.struct(
        (authority(resolve(h, url)) != src_auth).alias("ext"),
        i.alias("pos"), h.alias("href"), resolve(h, url).alias("url")))
    items = F.filter(items, lambda s: s["href"] != F.lit(""))
    return F.array_sort(items)


def avoided_by_default(url) -> Column:
    """any default avoid regex found in the url."""
    return _col(url).rlike(DEFAULT_AVOID_RE)


def contains_any(url, patterns) -> Column:
    """Literal substring test against an array column of patterns.
    An empty or null list matches nothing."""
    u = _col(url)
    return F.coalesce(F.exists(_col(patterns), lambda p: u.contains(p)), F.lit(False))


def in_hosts(url, hosts) -> Column:
    """The URL's authority is in the array column ``hosts``."""
    return F.coalesce(F.array_contains(_col(hosts), authority(url)), F.lit(False))


def external_first_score(url, is_seed_host, focus) -> Column:
    """0.2 when ``is_seed_host`` (boolean column) else 0.9; +0.3 (capped
    at 1.0) on a focus hit."""
    base = F.when(F.coalesce(_col(is_seed_host), F.lit(False)), F.lit(SEED_HOST_BASE)).otherwise(F.lit(OTHER_HOST_BASE))
    return F.when(contains_any(url, focus), F.least(base + F.lit(FOCUS_BONUS), F.lit(1.0))).otherwise(base)


def focus_score(url, focus) -> Column:
    """0.8 on a focus hit else 0.4."""
    return F.when(contains_any(url, focus), F.lit(FOCUS_HIT)).otherwise(F.lit(FOCUS_MISS))


def url_score(url, prefer_external, is_seed_host, focus) -> Column:
    """C4: external-first scorer, else focus scorer when there are focus
    patterns, else no scorer (0.0)."""
    has_focus = F.coalesce(F.size(_col(focus)), F.lit(0)) > 0
    return (F.when(F.coalesce(_col(prefer_external), F.lit(False)), external_first_score(url, is_seed_host, focus))
            .when(has_focus, focus_score(url, focus))
            .otherwise(F.lit(0.0)))
