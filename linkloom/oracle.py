"""DuckDB twins of the catalogue: for each query name, one SQL statement over
the driver's tables (pre-registered views). Written independently of the
Spark code, from the same definitions, patterns included (RE2-compatible: no
back-references), so that a pattern lost there shows here."""

from __future__ import annotations

# Page and url patterns.
CLEANED_TAGS = ("head", "script", "style")
EXCLUDED_TAGS = ("nav", "footer", "header", "aside")
BLOCK_TAG_RE = r"</?(?:p|div|h[1-6]|li|ul|ol|article|section|main|table|tr|td|th|blockquote|pre|br|body|html)\b[^>]*>"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
AUTHORITY_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
# The default avoid patterns.
DEFAULT_AVOID_RE = (r"/login\b|/logout\b|/signin\b|/signup\b|/register\b|/vote[?/]|/upvote\b|/downvote\b|/hide[?/]|/flag[?/]|/report\b|"
                    r"/user[?/]|/profile[?/]|/account[?/]|/from\?|/submit\b|/faq\b|/guidelines\b|/legal\b|/privacy\b|/terms\b|^mailto:")

SQL: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ── SQL building blocks ─────────────────────────────────────────────────────

def collapse(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip_tags(x):
    return collapse(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def drop_el(x, tags):
    for t in tags:
        x = f"regexp_replace({x}, {q('(?is)<' + t + chr(92) + 'b[^>]*>.*?</' + t + chr(92) + 's*>')}, ' ', 'g')"
    return x


def clean(x, excluded=CLEANED_TAGS + EXCLUDED_TAGS):
    return drop_el(f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')", excluded)


def auth(x):
    return f"lower(regexp_extract({x}, {q(AUTHORITY_RE)}, 1))"


def resolve(h, b):
    origin = f"regexp_extract({b}, {q(ORIGIN_RE)}, 0)"
    scheme = f"regexp_extract({b}, {q(SCHEME_RE)}, 0)"
    d = f"regexp_replace(regexp_extract({b}, {q(PATH_RE)}, 1), '[^/]*$', '')"
    d = f"(CASE WHEN {d} = '' THEN '/' ELSE {d} END)"
    return (f"(CASE WHEN regexp_matches({h}, {q(SCHEME_RE)}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '#') THEN {h} "
            f"ELSE {origin} || {d} || {h} END)")


def r4(x):
    """Spark's round(double, 4): HALF_UP on the shortest decimal form."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE)"


def fmt2(x):
    return f"printf('%.2f', {x})"


def label(e):
    pairs = [("403", "forbidden"), ("404", "not found"), ("429", "rate limited"), ("500", "server error"),
             ("503", "service unavailable"), ("timeout", "timed out"), ("fetch_failed", "connection failed")]
    whens = " ".join(f"WHEN contains(lower({e}), '{c}') THEN '{lab}'" for c, lab in pairs)
    return f"(CASE {whens} ELSE {e} END)"


HREF_SQL = r'(?i)<a\b[^>]*?\bhref="([^"]*)"'

RESULTS_V = """results_v AS (
  SELECT event_id AS seq, user_id AS job_id,
    'http://h' || CAST(user_id % 7 AS VARCHAR) || '.example.com/p/' || CAST(event_id % 499 AS VARCHAR) AS url,
    CAST(event_id % 4 AS INTEGER) AS depth,
    ([0.0, 0.2, 0.4, 0.5, 0.8, 0.9, 1.0]::DOUBLE[])[event_id % 7 + 1] AS score,
    CASE WHEN event_type = 'error'
      THEN (['403', 'fetch_failed:404', 'timeout:429', 'unknown_error:500', '503 x', 'Timeout', 'net::ERR'])[event_id % 7 + 1]
      ELSE '' END AS error,
    CASE WHEN event_id % 3 = 0 THEN 's' ELSE '' END AS summary,
    coalesce(props, '') AS text,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Page ' || CAST(event_id % 499 AS VARCHAR) END AS title,
    CAST(event_id % 5 AS BIGINT) AS links_count,
    CASE WHEN event_type = 'error' THEN 0 ELSE 200 END AS status_code,
    CASE WHEN event_id % 11 = 0 THEN props WHEN event_id % 11 = 1 THEN 'raw: ' || props ELSE '' END AS extracted_content,
    ts
  FROM events)"""

DEDUPED = """deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM results_v WHERE error = '') WHERE rn = 1)"""


def top_sql(n, order, min_score=0.0):
    where = f"WHERE score >= {min_score}" if min_score > 0 else ""
    return f"""WITH {RESULTS_V}, {DEDUPED}
SELECT row_number() OVER (ORDER BY {order}) AS rank, seq, url, score, depth
FROM deduped {where} ORDER BY {order} LIMIT {n}"""


# ── pages ───────────────────────────────────────────────────────────────────

CLEAN_TEXT = strip_tags(clean("html"))

SQL["page_title"] = f"SELECT page_id, {collapse(f'regexp_extract(html, {q(TITLE_RE)}, 1)')} AS title FROM pages"

SQL["page_text"] = f"""SELECT page_id, substring(t, 1, 10000) AS text, CAST(length(t) AS BIGINT) AS full_len
FROM (SELECT page_id, {CLEAN_TEXT} AS t FROM pages)"""

LINKS = f"""h AS (SELECT page_id, url, regexp_extract_all(html, {q(HREF_SQL)}, 1) AS hs FROM pages),
u AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(len(hs))) AS i FROM h),
r AS (SELECT page_id, url, href, i, {resolve('href', 'url')} AS dst_url FROM u WHERE href <> ''),
links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ({auth('dst_url')} <> {auth('url')}), i) - 1 AS BIGINT) AS pos,
  href, dst_url, {auth('dst_url')} = {auth('url')} AS is_internal FROM r)"""

SQL["page_links"] = f"WITH {LINKS} SELECT page_id, pos, href, dst_url, is_internal FROM links"

SQL["links_resolved"] = f"""WITH {LINKS}
SELECT page_id, count(*) AS links_count, count(*) FILTER (WHERE is_internal) AS internal_count,
  arg_min(dst_url, pos) AS first_link FROM links GROUP BY page_id"""

SQL["page_rows"] = f"""WITH {LINKS}, lc AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
SELECT p.page_id, p.url, {collapse(f'regexp_extract(p.html, {q(TITLE_RE)}, 1)')} AS title,
  substring({strip_tags(clean('p.html'))}, 1, 10000) AS text,
  CAST(coalesce(lc.n, 0) AS BIGINT) AS links_count, {auth('p.url')} AS host
FROM pages p LEFT JOIN lc ON lc.page_id = p.page_id"""

SQL["doc_snippets"] = """SELECT doc_id,
  replace(substring(coalesce(text, ''), 1, 500), chr(10), ' ') AS s500,
  replace(substring(coalesce(text, ''), 1, 200), chr(10), ' ') AS s200,
  replace(substring(coalesce(text, ''), 1, 120), chr(10), ' ') AS s120,
  CAST(length(substring(coalesce(text, ''), 1, 10000)) AS BIGINT) AS kept_len
FROM documents"""

# ── results ─────────────────────────────────────────────────────────────────

SQL["error_labels"] = f"WITH {RESULTS_V} SELECT seq, error, {label('error')} AS label FROM results_v WHERE error <> ''"

SQL["error_breakdown"] = f"""WITH {RESULTS_V}
SELECT {label('error')} AS label, count(*) AS n FROM results_v WHERE error <> '' GROUP BY 1"""

SQL["page_error_codes"] = f"""WITH {RESULTS_V}, e AS (
  SELECT seq, CASE WHEN error = '' THEN ''
    ELSE (CASE seq % 3 WHEN 0 THEN 'unknown_error' WHEN 1 THEN 'net::ERR_FAILED' ELSE 'Timeout' END)
      || (CASE WHEN seq % 2 = 0 AND seq % 600 <> 0 THEN ':' || CAST(seq % 600 AS VARCHAR) ELSE '' END) END AS page_error
  FROM results_v)
SELECT seq, page_error, {label('page_error')} AS label FROM e"""

PAD3 = "CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, ' ') ELSE CAST(n AS VARCHAR) END"

SQL["progress_lines"] = f"""WITH {RESULTS_V}, nn AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM results_v)
SELECT job_id, seq, n,
  (CASE WHEN error <> '' THEN '✗' ELSE '✓' END) || ' [' || ({PAD3}) || '] depth=' || CAST(depth AS VARCHAR)
  || ' score=' || {fmt2('score')} || '  ' || substring(url, 1, 80)
  || (CASE WHEN error <> '' THEN '  (' || {label('error')} || ')' ELSE '' END) AS line
FROM nn"""

SQL["top_results_score"] = top_sql(10, "score DESC, seq")
SQL["top_results_depth"] = top_sql(25, "depth, seq")
SQL["min_score_results"] = top_sql(50, "score DESC, seq", 0.8)

SQL["top_results_per_job"] = f"""WITH {RESULTS_V}, {DEDUPED}
SELECT * FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, seq) AS rank, seq, url, score
  FROM deduped) WHERE rank <= 3"""

SQL["dedupe_first"] = f"WITH {RESULTS_V}, {DEDUPED} SELECT url, seq, job_id, score, depth FROM deduped"

SQL["pages_done"] = f"""WITH {RESULTS_V}
SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS pages_done FROM results_v"""

SQL["paginate_results"] = f"""WITH {RESULTS_V}, jr AS (
  SELECT job_id, seq, url, depth, substring(text, 1, 500) AS text_snippet, links_count, score,
    row_number() OVER (PARTITION BY job_id ORDER BY seq) AS position,
    count(*) OVER (PARTITION BY job_id) AS total
  FROM results_v WHERE error = '')
SELECT job_id, position, seq, url, depth, text_snippet, links_count, score, total,
  CAST(2 AS BIGINT) AS page, CAST(5 AS BIGINT) AS per_page
FROM jr WHERE position > 5 AND position <= 10"""

SQL["needs_summary_rows"] = f"""WITH {RESULTS_V}, {DEDUPED}, t AS (
  SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, * FROM deduped ORDER BY score DESC, seq LIMIT 20)
SELECT rank, seq, url FROM t WHERE summary = '' AND text <> ''"""

SQL["result_view"] = f"""WITH {RESULTS_V}, {DEDUPED}, t AS (
  SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, * FROM deduped ORDER BY score DESC, seq LIMIT 10)
SELECT rank, url, {fmt2('score')} AS score_text, depth, links_count,
  coalesce(nullif(summary, ''), replace(substring(text, 1, 120), chr(10), ' ')) AS line FROM t"""

SQL["results_jsonl_rows"] = f"""WITH {RESULTS_V}
SELECT seq, url, depth, score, title, summary, error, links_count, substring(text, 1, 500) AS text_snippet,
  status_code, extracted_content FROM results_v"""

SQL["export_csv_rows"] = f"""WITH {RESULTS_V}
SELECT seq, url, depth, score, links_count, title, summary,
  replace(substring(text, 1, 500), chr(10), ' ') AS text_snippet FROM results_v WHERE error = ''"""

SQL["export_md_rows"] = f"""WITH {RESULTS_V}, ok AS (
  SELECT *, row_number() OVER (ORDER BY seq) AS rank FROM results_v WHERE error = '')
SELECT seq, rank, '## ' || CAST(rank AS VARCHAR) || '. ' || coalesce(nullif(title, ''), url)
  || chr(10) || chr(10) || '- **URL:** ' || url
  || chr(10) || '- **Score:** ' || {fmt2('score')}
  || chr(10) || '- **Depth:** ' || CAST(depth AS VARCHAR)
  || chr(10) || '- **Links:** ' || CAST(links_count AS VARCHAR) || chr(10) || chr(10)
  || coalesce(coalesce(nullif(summary, ''), nullif(substring(text, 1, 500), '')) || chr(10) || chr(10), '')
  || '---' || chr(10) || chr(10) AS md
FROM ok"""

SQL["crawl_summary"] = f"""WITH {RESULTS_V}
SELECT count(*) FILTER (WHERE error = '') AS good, count(*) FILTER (WHERE error <> '') AS errors, count(*) AS total
FROM results_v"""

SQL["job_stats"] = f"""WITH {RESULTS_V}
SELECT job_id, count(*) FILTER (WHERE error = '') AS pages_crawled, count(*) FILTER (WHERE error <> '') AS pages_error,
  count(*) FILTER (WHERE error = '') AS results_count FROM results_v GROUP BY job_id"""

SQL["page_top_focus"] = f"""WITH {LINKS}, lc AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id),
rows AS (SELECT p.page_id, p.url, {collapse(f'regexp_extract(p.html, {q(TITLE_RE)}, 1)')} AS title,
  substring({strip_tags(clean('p.html'))}, 1, 10000) AS text, CAST(coalesce(lc.n, 0) AS BIGINT) AS links_count,
  CASE WHEN contains(p.url, '/en/') THEN 0.8 ELSE 0.4 END::DOUBLE AS score
  FROM pages p LEFT JOIN lc ON lc.page_id = p.page_id)
SELECT row_number() OVER (ORDER BY score DESC, page_id) AS rank, page_id, url, title, score, links_count,
  substring(text, 1, 120) AS snippet FROM rows ORDER BY score DESC, page_id LIMIT 10"""

# ── relevance ───────────────────────────────────────────────────────────────

GOAL_TERMS = "['the', 'of', 'thand', 'reheed', 'thention']"


def blocks_cte(excluded=CLEANED_TAGS + EXCLUDED_TAGS):
    marked = f"regexp_replace({clean('html', excluded)}, {q(BLOCK_TAG_RE)}, chr(1), 'g')"
    return f"""pb AS (SELECT page_id, string_split({marked}, chr(1)) AS pieces FROM pages),
rawb AS (SELECT page_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM pb),
bl AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos, piece, t AS text
  FROM (SELECT page_id, i, piece, {strip_tags('piece')} AS t FROM rawb) WHERE t <> '')"""


BM25 = f"""{blocks_cte()},
tk AS (SELECT page_id, pos, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM bl),
st AS (SELECT page_id, count(*) AS nb, avg(len(toks)) AS avgdl FROM tk GROUP BY page_id),
qt AS (SELECT unnest({GOAL_TERMS}) AS term),
tf AS (SELECT tk.page_id, tk.pos, qt.term, len(list_filter(tk.toks, lambda x: x = qt.term)) AS tf, len(tk.toks) AS dl
  FROM tk CROSS JOIN qt),
dfq AS (SELECT page_id, term, count(*) FILTER (WHERE tf > 0) AS n FROM tf GROUP BY page_id, term),
sc AS (SELECT tf.page_id, tf.pos,
  coalesce(sum(CASE WHEN tf.tf > 0 THEN ln((st.nb - dfq.n + 0.5) / (dfq.n + 0.5) + 1) * tf.tf * 2.5
    / (tf.tf + 1.5 * (0.25 + 0.75 * coalesce(tf.dl / nullif(st.avgdl, 0), 0))) ELSE 0 END), 0) AS s
  FROM tf JOIN st USING (page_id) JOIN dfq USING (page_id, term) GROUP BY tf.page_id, tf.pos),
scored AS (SELECT tk.page_id, tk.pos, tk.text, {r4('coalesce(sc.s, 0)')} AS score FROM tk LEFT JOIN sc USING (page_id, pos))"""

SQL["page_blocks"] = f"WITH {blocks_cte()} SELECT page_id, pos, text FROM bl"

SQL["bm25_blocks"] = f"WITH {BM25} SELECT page_id, pos, text, score, score >= 1.2 AS kept FROM scored"

SQL["bm25_fit_text"] = f"""WITH {BM25}, fit AS (
  SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE score >= 1.2), '') AS fit_text
  FROM scored GROUP BY page_id)
SELECT p.page_id, coalesce(fit.fit_text, '') AS fit_text,
  substring(coalesce(nullif(fit.fit_text, ''), {strip_tags(clean('p.html'))}), 1, 10000) AS text
FROM pages p LEFT JOIN fit ON fit.page_id = p.page_id"""

PRUNE = f"""{blocks_cte(CLEANED_TAGS)},
an AS (SELECT page_id, pos, piece, text, regexp_extract_all(piece, {q('(?is)<a' + chr(92) + 'b[^>]*>(.*?)</a' + chr(92) + 's*>')}, 1) AS anchors FROM bl),
ps AS (SELECT page_id, pos, text,
  0.5 * coalesce(length(text) / nullif(length(piece), 0), 0)
  + 0.4 * (1 - coalesce(coalesce(list_sum(list_transform(anchors, lambda a: length({strip_tags('a')}))), 0) / nullif(length(text), 0), 0))
  + 0.1 * least(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) / 10.0, 1.0) AS s FROM an)"""

SQL["pruned_blocks"] = f"WITH {PRUNE} SELECT page_id, pos, {r4('s')} AS score, {r4('s')} >= 0.48 AS kept FROM ps"

SQL["pruned_text"] = f"""WITH {PRUNE}, agg AS (
  SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE {r4('s')} >= 0.48), '') AS fit_text,
    count(*) FILTER (WHERE {r4('s')} >= 0.48) AS kept_blocks, count(*) AS blocks,
    string_agg(text, ' ' ORDER BY pos) AS whole FROM ps GROUP BY page_id)
SELECT p.page_id, coalesce(agg.fit_text, '') AS fit_text,
  substring(coalesce(nullif(agg.fit_text, ''), nullif(agg.whole, ''), ''), 1, 10000) AS text,
  coalesce(agg.kept_blocks, 0) AS kept_blocks, coalesce(agg.blocks, 0) AS blocks
FROM pages p LEFT JOIN agg ON agg.page_id = p.page_id"""

SQL["content_none_text"] = f"SELECT page_id, substring({strip_tags(clean('html'))}, 1, 10000) AS text FROM pages"

# ── crawl ───────────────────────────────────────────────────────────────────

LINK_GRAPH = f"""np AS (SELECT count(*) AS n FROM pages),
lg0 AS (SELECT p.page_id AS src_id, p.url AS src_url, j, (p.page_id * 3 + j * j) % (np.n + 5) AS k
  FROM pages p, np, range(1, 5) t(j)),
lg1 AS (SELECT lg0.*, coalesce(d.url, 'http://missing.example.org/' || CAST(lg0.k AS VARCHAR)) AS base
  FROM lg0 LEFT JOIN pages d ON d.page_id = lg0.k),
lg AS (SELECT src_id, src_url, CASE WHEN j = 4 AND k % 5 = 0 THEN base || '/login' ELSE base END AS dst_url,
  CAST(j - 1 AS INTEGER) AS pos FROM lg1),
lgi AS (SELECT *, {auth('dst_url')} = {auth('src_url')} AS is_internal FROM lg)"""

SEEDS = f"""seeds AS (SELECT 'job-' || {auth('url')} AS job_id,
  CAST(row_number() OVER (PARTITION BY {auth('url')} ORDER BY page_id) - 1 AS INTEGER) AS seed_pos, url FROM pages)"""


def walk_sql(include_external=True, max_depth=3, planned="true"):
    ext = "" if include_external else "AND l.is_internal"
    return f"""walks(job_id, seed_pos, url, depth, path) AS (
  SELECT job_id, seed_pos, url, 0, []::INTEGER[] FROM seeds
  UNION ALL
  SELECT w.job_id, w.seed_pos, l.dst_url, w.depth + 1, list_append(w.path, l.pos)
  FROM walks w JOIN lgi l ON l.src_url = w.url
  WHERE w.depth < {max_depth} AND w.url IN (SELECT url FROM pages)
    AND NOT regexp_matches(l.dst_url, {q(DEFAULT_AVOID_RE)}) AND NOT (({planned}) AND contains(l.dst_url, '/de/')) {ext}),
best AS (SELECT job_id, seed_pos, url, depth, path FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, seed_pos, url ORDER BY depth, path) AS rk FROM walks) WHERE rk = 1)"""


def score_sql(prefer_external):
    if prefer_external:
        return f"""(CASE WHEN {auth('b.url')} IN (SELECT {auth('s.url')} FROM seeds s WHERE s.job_id = b.job_id)
      THEN (CASE WHEN contains(b.url, '/en/') THEN 0.5 ELSE 0.2 END)
      ELSE (CASE WHEN contains(b.url, '/en/') THEN 1.0 ELSE 0.9 END) END)::DOUBLE"""
    return "(CASE WHEN contains(b.url, '/en/') THEN 0.8 ELSE 0.4 END)::DOUBLE"


def crawl_sql(order="seed_pos, depth, path", prefer_external=False, include_external=True, max_pages=500,
              threshold=0.0, max_depth=3, planned="true"):
    emitted = f"score >= {threshold}" if threshold > 0 else "true"
    return f"""WITH RECURSIVE {LINK_GRAPH}, {SEEDS}, {walk_sql(include_external, max_depth, planned)},
rows AS (SELECT b.job_id, b.seed_pos, b.url, b.depth, b.path, b.url IN (SELECT url FROM pages) AS ok,
  CASE WHEN {planned} THEN {score_sql(prefer_external)} ELSE 0.0 END AS score FROM best b),
capped AS (SELECT * FROM (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY job_id, seed_pos ORDER BY {order}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(ok AS INTEGER) AS ok_before FROM rows) WHERE ok_before < {max_pages}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {order}) AS pages_done, {emitted} AS emitted FROM capped),
stops AS (SELECT job_id, min(pages_done) AS stop FROM numbered WHERE emitted AND pages_done >= {max_pages} GROUP BY job_id)
SELECT n.job_id, n.seed_pos, n.url, n.depth, array_to_string(n.path, '.') AS path, n.ok,
  CASE WHEN n.ok THEN '' ELSE 'fetch_failed' END AS error, n.score, n.pages_done,
  s.stop IS NOT NULL AS budget_hit, CASE WHEN s.stop IS NOT NULL THEN 'cancelled' ELSE 'completed' END AS status
FROM numbered n LEFT JOIN stops s ON s.job_id = n.job_id
WHERE n.emitted AND (s.stop IS NULL OR n.pages_done <= s.stop)"""


def bestfirst_sql(batch=10, max_pages=500, max_depth=3):
    """Rounds as a recursive CTE: each round's working table is all that is known, with the round of what was emitted."""
    allowed = f"NOT regexp_matches(l.dst_url, {q(DEFAULT_AVOID_RE)}) AND NOT contains(l.dst_url, '/de/')"
    score = "(CASE WHEN contains({0}, '/en/') THEN 0.8 ELSE 0.4 END)::DOUBLE"
    return f"""WITH RECURSIVE {LINK_GRAPH}, {SEEDS}, known AS (
  SELECT 0 AS n, job_id, seed_pos, url, 0 AS depth, []::INTEGER[] AS path, {score.format('url')} AS score, url IN (SELECT url FROM pages) AS ok,
    CAST(NULL AS INTEGER) AS round, CAST(NULL AS BIGINT) AS place FROM seeds
  UNION ALL (
  WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, seed_pos, round IS NULL ORDER BY score DESC, depth, path) AS rk,
      sum(CASE WHEN round IS NOT NULL AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, seed_pos) AS n_ok FROM known),
  marked AS (SELECT * EXCLUDE (rk, n_ok), round IS NULL AND rk <= {batch} AND n_ok < {max_pages} AS taken, rk FROM ranked),
  found AS (SELECT job_id, seed_pos, l.dst_url AS url, m.depth + 1 AS depth, list_append(m.path, l.pos) AS path
    FROM marked m JOIN lgi l ON l.src_url = m.url WHERE m.taken AND m.ok AND m.depth < {max_depth} AND {allowed}),
  new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, seed_pos, url ORDER BY depth, path) AS nth FROM found) WHERE nth = 1)
  SELECT n + 1, job_id, seed_pos, url, depth, path, score, ok, CASE WHEN taken THEN n ELSE round END, CASE WHEN taken THEN rk ELSE place END
  FROM marked WHERE EXISTS (SELECT 1 FROM marked WHERE taken)
  UNION ALL SELECT (SELECT max(n) FROM marked) + 1, f.job_id, f.seed_pos, f.url, f.depth, f.path, {score.format('f.url')}, f.url IN (SELECT url FROM pages), NULL, NULL
  FROM new f WHERE NOT EXISTS (SELECT 1 FROM marked k WHERE k.job_id = f.job_id AND k.seed_pos = f.seed_pos AND k.url = f.url))),
rows AS (SELECT * FROM known WHERE n = (SELECT max(n) FROM known) AND round IS NOT NULL),
capped AS (SELECT * FROM (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY job_id, seed_pos ORDER BY round, place
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(ok AS INTEGER) AS ok_before FROM rows) WHERE ok_before < {max_pages}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seed_pos, round, place) AS pages_done FROM capped)
SELECT job_id, seed_pos, url, depth, array_to_string(path, '.') AS path, ok, score, round, pages_done FROM numbered WHERE pages_done <= {max_pages}"""


SQL["default_avoid"] = f"""WITH v AS (SELECT page_id, unnest([
  'login', 'logout', 'signin', 'signup', 'register', 'vote', 'upvote', 'downvote', 'hide', 'flag', 'report', 'user', 'profile', 'account',
  'from', 'submit', 'faq', 'guidelines', 'legal', 'privacy', 'terms']) AS word, url FROM pages),
t AS (SELECT page_id, rtrim(url, '/') || '/' || word || tail AS url FROM v, (SELECT unnest(['', '?a=1', '/x', 's', '_x', '-x', '.html']) AS tail)
  UNION ALL SELECT page_id, head || url FROM pages, (SELECT unnest(['mailto:', 'x-mailto:', '/mailto:']) AS head))
SELECT page_id, url, regexp_matches(url, {q(DEFAULT_AVOID_RE)}) AS avoided FROM t"""

SQL["links_from_pages"] = f"""WITH {LINKS}
SELECT p.url AS src_url, l.dst_url, CAST(l.pos AS INTEGER) AS pos, l.is_internal FROM links l JOIN pages p USING (page_id)"""

SQL["crawl_result_rows"] = f"""WITH c AS ({crawl_sql(max_pages=20)}),
one AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
pr AS (SELECT * FROM ({SQL['page_rows']}) WHERE page_id IN (SELECT page_id FROM one))
SELECT c.job_id, c.pages_done, c.url, c.depth, c.score, coalesce(pr.title, '') AS title, coalesce(pr.text, '') AS text,
  coalesce(pr.links_count, 0) AS links_count, c.error, CASE WHEN c.ok THEN 200 ELSE 0 END AS status_code
FROM c LEFT JOIN pr ON pr.url = c.url AND c.ok"""

SQL["crawl_jobs"] = f"""WITH a AS ({crawl_sql(max_pages=30, include_external=False, max_depth=2)}),
b AS ({crawl_sql(order="seed_pos, path", max_pages=25, threshold=0.5)})
SELECT a.*, 'bfs' AS strategy FROM a WHERE length(job_id) % 2 = 0
UNION ALL SELECT b.*, 'dfs' AS strategy FROM b WHERE length(job_id) % 2 <> 0"""

SQL["crawl_bfs"] = crawl_sql()
SQL["crawl_external_first"] = crawl_sql(prefer_external=True)
SQL["crawl_dfs"] = crawl_sql(order="seed_pos, path")
SQL["crawl_internal_only"] = crawl_sql(include_external=False)
SQL["crawl_budget"] = crawl_sql(max_pages=20)
SQL["crawl_bestfirst"] = bestfirst_sql()
SQL["crawl_score_threshold"] = crawl_sql(max_pages=30, threshold=0.5)
SQL["page_events"] = f"""SELECT job_id, 'page' AS event, url, depth, pages_done FROM ({crawl_sql(max_pages=40, threshold=0.5)})"""

SQL["frontier_hop"] = f"""WITH {LINK_GRAPH}
SELECT CAST(src_id AS INTEGER) AS seed_pos, dst_url AS url, 1 AS depth, pos FROM lgi
WHERE src_url IN (SELECT url FROM pages) AND NOT regexp_matches(dst_url, {q(DEFAULT_AVOID_RE)})"""

SQL["fetch_from_store"] = f"""WITH {LINK_GRAPH}
SELECT l.src_id, l.pos, l.dst_url AS url, p.page_id AS dst_page_id,
  CASE WHEN p.page_id IS NULL THEN 'fetch_failed' ELSE '' END AS error
FROM lgi l LEFT JOIN pages p ON p.url = l.dst_url"""

SQL["cache_misses"] = f"""WITH {LINK_GRAPH}
SELECT src_id, pos, dst_url AS url FROM lgi
WHERE dst_url NOT IN (SELECT url FROM pages WHERE starts_with(url, 'https://'))"""

SQL["fetch_schedule"] = f"""WITH {LINKS}, fu AS (
  SELECT dst_url AS url, page_id, pos, (CASE WHEN contains(dst_url, '/en/') THEN 0.8 ELSE 0.4 END)::DOUBLE AS score,
    {auth('dst_url')} AS host FROM links),
fr AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id, pos) AS host_rank FROM fu)
SELECT url, page_id, pos, host, host_rank, (host_rank - 1) * 2.0 AS planned_s, (host_rank - 1) * 1.0 AS earliest_s,
  (host_rank - 1) * 3.0 AS latest_s FROM fr"""

# ── jobs ────────────────────────────────────────────────────────────────────

JOB_REQUESTS_V = """jr AS (SELECT 'job-' || CAST(c_custkey AS VARCHAR) AS job_id, c_mktsegment AS goal,
  CASE WHEN c_custkey % 10 = 0 THEN []::VARCHAR[]
    ELSE ['https://' || lower(replace(c_name, '#', '-')) || '.example.com/'] END AS seed_urls,
  CAST(c_custkey % 14 AS INTEGER) AS max_depth,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 12000 AS INTEGER) END AS max_pages,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_acctbal % 70) / 10 END AS min_delay_seconds,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 50 AS DOUBLE) END AS max_delay_seconds,
  CASE WHEN c_custkey % 9 = 0 THEN 'gemini' WHEN c_custkey % 9 = 1 THEN NULL ELSE 'claude' END AS ai_provider,
  (['bfs', 'dfs', 'bestfirst', 'random'])[c_custkey % 4 + 1] AS strategy,
  CASE c_custkey % 5 WHEN 0 THEN 'pruning' WHEN 1 THEN NULL WHEN 2 THEN 'none' ELSE 'bm25' END AS content_filter,
  CASE WHEN c_custkey % 8 = 0 THEN 0.0::DOUBLE END AS bm25_threshold,
  CASE WHEN c_custkey % 3 = 0 THEN 'enabled' END AS cache_mode,
  CASE WHEN c_custkey % 7 = 0 THEN 1.5::DOUBLE WHEN c_custkey % 7 = 1 THEN 0.5::DOUBLE END AS score_threshold,
  CASE WHEN c_custkey % 2 = 0 THEN false END AS include_external
  FROM customer),
acc_all AS (SELECT job_id, coalesce(goal, '') AS goal, coalesce(seed_urls, []::VARCHAR[]) AS seed_urls,
  coalesce(max_depth, 3) AS max_depth, coalesce(max_pages, 500) AS max_pages,
  coalesce(min_delay_seconds, 1.0::DOUBLE) AS min_delay_seconds, coalesce(max_delay_seconds, 3.0::DOUBLE) AS max_delay_seconds,
  coalesce(ai_provider, 'claude') AS ai_provider, coalesce(strategy, 'bfs') AS strategy,
  coalesce(content_filter, 'bm25') AS content_filter, coalesce(bm25_threshold, 1.2::DOUBLE) AS bm25_threshold,
  coalesce(cache_mode, 'bypass') AS cache_mode, false AS stealth, true AS headless,
  coalesce(score_threshold, 0.0::DOUBLE) AS score_threshold, coalesce(include_external, true) AS include_external
  FROM jr),
acc AS (SELECT *, 'pending' AS status FROM acc_all WHERE len(seed_urls) > 0)"""

SQL["job_defaults"] = f"""WITH {JOB_REQUESTS_V}
SELECT job_id, goal, array_to_string(seed_urls, ',') AS seeds, max_depth, max_pages, min_delay_seconds,
  max_delay_seconds, ai_provider, strategy, content_filter, bm25_threshold, cache_mode, stealth, headless,
  score_threshold, include_external, status FROM acc"""

SQL["job_rejects"] = f"""WITH {JOB_REQUESTS_V} SELECT job_id, 'seed_urls required' AS error FROM acc_all WHERE len(seed_urls) = 0"""

SQL["config_violations"] = f"""WITH {JOB_REQUESTS_V}, v AS (
  SELECT job_id, 'provider' AS field, CASE WHEN ai_provider NOT IN ('claude', 'gemini') THEN 'provider must be one of: claude, gemini' END AS message FROM acc
  UNION ALL SELECT job_id, 'strategy', CASE WHEN strategy NOT IN ('bfs', 'bestfirst', 'dfs') THEN 'strategy must be one of: bfs, bestfirst, dfs' END FROM acc
  UNION ALL SELECT job_id, 'filter', CASE WHEN content_filter NOT IN ('bm25', 'pruning', 'none') THEN 'filter must be one of: bm25, pruning, none' END FROM acc
  UNION ALL SELECT job_id, 'cache', CASE WHEN cache_mode NOT IN ('enabled', 'bypass') THEN 'cache must be one of: enabled, bypass' END FROM acc
  UNION ALL SELECT job_id, 'max_depth', CASE WHEN max_depth < 0 OR max_depth > 10 THEN 'max_depth must be between 0 and 10' END FROM acc
  UNION ALL SELECT job_id, 'max_pages', CASE WHEN max_pages < 1 OR max_pages > 10000 THEN 'max_pages must be between 1 and 10000' END FROM acc
  UNION ALL SELECT job_id, 'min_delay', CASE WHEN min_delay_seconds < 0 OR min_delay_seconds > 60 THEN 'min_delay must be between 0 and 60'
    WHEN min_delay_seconds > max_delay_seconds THEN 'min_delay must be <= max_delay' END FROM acc
  UNION ALL SELECT job_id, 'max_delay', CASE WHEN max_delay_seconds < 0 OR max_delay_seconds > 60 THEN 'max_delay must be between 0 and 60'
    WHEN max_delay_seconds < min_delay_seconds THEN 'max_delay must be >= min_delay' END FROM acc
  UNION ALL SELECT job_id, 'bm25_threshold', CASE WHEN bm25_threshold <= 0 THEN 'bm25_threshold must be > 0' END FROM acc
  UNION ALL SELECT job_id, 'score_threshold', CASE WHEN score_threshold < 0.0 OR score_threshold > 1.0 THEN 'score_threshold must be between 0.0 and 1.0' END FROM acc)
SELECT job_id, field, message FROM v WHERE message IS NOT NULL"""

CRAWL_EVENTS_V = """ev AS (SELECT user_id AS job_id, event_id AS seq, ts,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'status' ELSE 'page' END AS event,
  CASE WHEN event_type = 'signup' THEN 'planning' WHEN event_type = 'purchase' THEN 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'fetch_failed:404' ELSE '' END AS error FROM events),
last_status AS (SELECT job_id, status, epoch_us(ts) / 1e6 AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rk FROM ev WHERE event = 'status') WHERE rk = 1)"""

SQL["job_status"] = f"WITH {CRAWL_EVENTS_V} SELECT job_id, status, updated_at FROM last_status"
SQL["done_events"] = f"""WITH {CRAWL_EVENTS_V}
SELECT job_id, 'done' AS event, status FROM last_status WHERE status IN ('completed', 'cancelled', 'error')"""
SQL["running_stats"] = f"""WITH {CRAWL_EVENTS_V}
SELECT job_id, count(*) FILTER (WHERE error = '') AS pages_crawled, count(*) FILTER (WHERE error <> '') AS pages_error
FROM ev WHERE event = 'page' GROUP BY job_id"""
SQL["job_elapsed"] = f"""WITH {CRAWL_EVENTS_V}
SELECT job_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_s FROM ev GROUP BY job_id"""

SQL["job_list"] = f"""WITH {JOB_REQUESTS_V}, {RESULTS_V}, {CRAWL_EVENTS_V},
st AS (SELECT 'job-' || CAST(job_id AS VARCHAR) AS job_id, count(*) FILTER (WHERE error = '') AS pages_crawled,
  count(*) FILTER (WHERE error <> '') AS pages_error, count(*) FILTER (WHERE error = '') AS results_count
  FROM results_v GROUP BY 1),
ls AS (SELECT 'job-' || CAST(job_id AS VARCHAR) AS job_id, status, updated_at FROM last_status)
SELECT a.job_id, a.goal, coalesce(ls.status, a.status) AS status, coalesce(st.pages_crawled, 0) AS pages_crawled,
  coalesce(st.pages_error, 0) AS pages_error, coalesce(st.results_count, 0) AS results_count, ls.updated_at
FROM acc a LEFT JOIN st ON st.job_id = a.job_id LEFT JOIN ls ON ls.job_id = a.job_id"""

# ── plans ───────────────────────────────────────────────────────────────────

SQL["plan_prompts"] = f"""WITH {JOB_REQUESTS_V}
SELECT job_id, 'Goal: ' || goal || chr(10) || 'Seed URLs: ['
  || array_to_string(list_transform(seed_urls, lambda s: '"' || s || '"'), ', ') || ']' || chr(10)
  || 'Max depth: ' || CAST(max_depth AS VARCHAR) || chr(10) || chr(10) || 'Produce the crawl plan JSON.' AS prompt FROM acc"""

PLAN_RESPONSES_V = """pr AS (SELECT 'job-' || CAST(c_custkey AS VARCHAR) AS job_id,
  ['https://' || lower(replace(c_name, '#', '-')) || '.example.com/'] AS seed_urls,
  CASE (c_custkey + 5) % 10
    WHEN 0 THEN '{"summary": "Plan for ' || lower(c_mktsegment) || '", "prioritized_seeds": [{"url": "https://c'
      || CAST(c_custkey AS VARCHAR) || '.example.com/", "score": 0.9, "reason": "main site"}, {"url": "https://d'
      || CAST(c_custkey AS VARCHAR) || '.example.org/", "score": 0.45}], "avoid_patterns": ["/cart", "/de/"], "focus_patterns": ["/pricing", "/'
      || lower(c_mktsegment) || '"], "prefer_external": false}'
    WHEN 1 THEN 'Sorry, no plan for ' || c_name
    WHEN 2 THEN '{"summary": "s", "prioritized_seeds": [{"score": 0.5}]}'
    WHEN 3 THEN '{"summary": "n' || CAST(c_custkey AS VARCHAR) || '", "prioritized_seeds": [{"url": "https://e'
      || CAST(c_custkey AS VARCHAR) || '.example.net/", "score": "0.7"}], "prefer_external": 1}'
    WHEN 4 THEN '{"summary": "x", "prioritized_seeds": [{"url": "https://x.example.com/", "score": "high"}]}'
    WHEN 5 THEN '{"prioritized_seeds": [{"url": "https://y.example.com/", "score": null}]}'
    WHEN 6 THEN '[{"url": "https://z.example.com/"}]'
    WHEN 7 THEN '{"summary": "t' || CAST(c_custkey AS VARCHAR) || '"} trailing words'
    WHEN 8 THEN '{"summary": "y", "focus_patterns": ["/' || CAST(c_nationkey AS VARCHAR) || '/"], "prefer_external": "false"}'
    ELSE '{}' END AS raw
  FROM customer),
pj AS (SELECT *, json_valid(raw) AS valid, CASE WHEN json_valid(raw) THEN json_type(raw) END AS jt,
  CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN json_extract(raw, '$.prioritized_seeds') END AS ps FROM pr),
seedrows AS (SELECT job_id, e, i FROM (
  SELECT job_id, unnest(json_extract(ps, '$[*]')) AS e, unnest(range(CAST(json_array_length(ps) AS BIGINT))) AS i
  FROM pj WHERE ps IS NOT NULL AND json_type(ps) = 'ARRAY')),
seedvals AS (SELECT job_id, i, json_type(e) = 'OBJECT' AND json_extract(e, '$.url') IS NOT NULL AS has_url,
  json_extract_string(e, '$.url') AS url,
  CASE WHEN json_extract(e, '$.score') IS NULL THEN 0.5::DOUBLE
    WHEN json_type(json_extract(e, '$.score')) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(e, '$.score') AS DOUBLE)
    WHEN json_type(json_extract(e, '$.score')) = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string(e, '$.score')) AS DOUBLE)
    WHEN json_type(json_extract(e, '$.score')) = 'BOOLEAN' THEN CASE WHEN json_extract_string(e, '$.score') = 'true' THEN 1.0 ELSE 0.0 END
    END AS score,
  coalesce(json_extract_string(e, '$.reason'), '') AS reason FROM seedrows),
seedagg AS (SELECT job_id, bool_or(NOT has_url OR score IS NULL) AS bad,
  list(struct_pack(url := url, score := score, reason := reason) ORDER BY i) AS seeds FROM seedvals GROUP BY job_id),
pe AS (SELECT job_id, json_extract(raw, '$.prefer_external') AS x FROM pj WHERE valid AND jt = 'OBJECT'),
pet AS (SELECT job_id, CASE WHEN x IS NULL THEN false
    WHEN json_type(x) = 'BOOLEAN' THEN json_extract_string(x, '$') = 'true'
    WHEN json_type(x) = 'NULL' THEN false
    WHEN json_type(x) = 'VARCHAR' THEN length(json_extract_string(x, '$')) > 0
    WHEN json_type(x) = 'ARRAY' THEN json_array_length(x) > 0
    WHEN json_type(x) = 'OBJECT' THEN CAST(x AS VARCHAR) <> '{}'
    ELSE CAST(json_extract_string(x, '$') AS DOUBLE) <> 0 END AS pe FROM pe),
parsed AS (SELECT pj.job_id, pj.seed_urls,
  CASE WHEN NOT pj.valid THEN 'fallback'
    WHEN pj.jt <> 'OBJECT' THEN 'plan_error'
    WHEN pj.ps IS NOT NULL AND (json_type(pj.ps) <> 'ARRAY' OR coalesce(sa.bad, false)) THEN 'plan_error'
    ELSE 'ok' END AS outcome,
  coalesce(CASE WHEN pj.valid AND pj.jt = 'OBJECT' THEN json_extract_string(pj.raw, '$.summary') END, '') AS summary0, coalesce(sa.seeds, []) AS seeds0,
  CASE WHEN pj.valid AND pj.jt = 'OBJECT' THEN coalesce(TRY_CAST(json_extract(pj.raw, '$.avoid_patterns') AS VARCHAR[]), []) END AS avoid0,
  CASE WHEN pj.valid AND pj.jt = 'OBJECT' THEN coalesce(TRY_CAST(json_extract(pj.raw, '$.focus_patterns') AS VARCHAR[]), []) END AS focus0,
  coalesce(pet.pe, false) AS pe0
  FROM pj LEFT JOIN seedagg sa ON sa.job_id = pj.job_id LEFT JOIN pet ON pet.job_id = pj.job_id),
plans AS (SELECT job_id, outcome,
  CASE outcome WHEN 'ok' THEN summary0 WHEN 'fallback' THEN 'AI plan unavailable' END AS summary,
  CASE outcome WHEN 'ok' THEN seeds0 WHEN 'fallback' THEN list_transform(seed_urls, lambda u: struct_pack(url := u, score := 0.5::DOUBLE, reason := '')) END AS seeds,
  CASE outcome WHEN 'ok' THEN avoid0 WHEN 'fallback' THEN []::VARCHAR[] END AS avoid,
  CASE outcome WHEN 'ok' THEN focus0 WHEN 'fallback' THEN []::VARCHAR[] END AS focus,
  CASE outcome WHEN 'ok' THEN pe0 WHEN 'fallback' THEN false END AS prefer_external
  FROM parsed)"""

SQL["plans_parsed"] = f"""WITH {PLAN_RESPONSES_V}
SELECT job_id, outcome, summary,
  array_to_string(list_transform(seeds, lambda s: concat_ws('|', s.url, printf('%.4f', s.score), s.reason)), ';') AS seeds,
  array_to_string(avoid, ',') AS avoid, array_to_string(focus, ',') AS focus, prefer_external FROM plans"""

SQL["seeds_resolved"] = f"""WITH {JOB_REQUESTS_V}, {PLAN_RESPONSES_V},
chosen AS (SELECT a.job_id, CASE WHEN len(coalesce(p.seeds, [])) > 0 THEN list_transform(p.seeds, lambda s: s.url)
  ELSE a.seed_urls END AS s FROM acc a LEFT JOIN (SELECT * FROM plans WHERE outcome <> 'plan_error') p ON p.job_id = a.job_id)
SELECT job_id, CAST(seed_pos AS INTEGER) AS seed_pos, url FROM (
  SELECT job_id, unnest(s) AS url, unnest(range(len(s))) AS seed_pos FROM chosen)"""

SQL["plan_view"] = f"""WITH {PLAN_RESPONSES_V}
SELECT job_id, concat_ws(chr(10), 'Summary: ' || summary,
  CASE WHEN len(focus) > 0 THEN 'Focus: ' || array_to_string(focus, ', ') END,
  CASE WHEN len(avoid) > 0 THEN 'Avoid: ' || array_to_string(avoid, ', ') END,
  CASE WHEN prefer_external THEN 'Mode: external-first (aggregator site)' END,
  CASE WHEN len(seeds) > 0 THEN 'Seeds:' || chr(10) || array_to_string(list_transform(seeds, lambda s:
    '  ' || printf('%.1f', s.score) || '  ' || s.url || CASE WHEN s.reason <> '' THEN '  ' || s.reason ELSE '' END), chr(10)) END) AS view
FROM plans WHERE outcome <> 'plan_error'"""

SQL["summary_prompts"] = f"""SELECT page_id, 'Goal: find pricing pages' || chr(10) || 'URL: ' || url || chr(10) || chr(10)
  || 'Page text:' || chr(10) || substring({strip_tags(clean('html'))}, 1, 10000) AS prompt FROM pages"""

SQL["extraction_prompts"] = f"""SELECT page_id, 'Goal: find pricing pages' || chr(10) || 'URL: ' || url || chr(10)
  || 'Extract: navigation links with their targets'
  || CASE WHEN h <> '' THEN chr(10) || chr(10) || 'Page HTML:' || chr(10) || h ELSE '' END
  || chr(10) || chr(10) || 'Produce the extraction schema JSON.' AS prompt
FROM (SELECT page_id, url, substring({clean('html')}, 1, 15000) AS h FROM pages)"""

SQL["extracted_parsed"] = f"""WITH {RESULTS_V}
SELECT seq, json_valid(extracted_content) AS is_json,
  CASE WHEN json_valid(extracted_content) THEN NULL ELSE substring(extracted_content, 1, 2000) END AS shown,
  CASE WHEN json_valid(extracted_content) THEN CAST(json_extract(extracted_content, '$.k') AS BIGINT) END AS k
FROM results_v WHERE extracted_content <> ''"""

SQL["nav_records"] = f"""WITH li AS (SELECT page_id, regexp_extract_all(html, {q(r'(?is)<li\b[^>]*>(.*?)</li>')}, 1) AS items FROM pages),
u AS (SELECT page_id, unnest(items) AS inner_html, unnest(range(len(items))) AS rec_no FROM li)
SELECT page_id, rec_no, {strip_tags('inner_html')} AS text,
  nullif(regexp_extract(inner_html, {q(HREF_SQL)}, 1), '') AS href FROM u"""

SQL["seed_hosts"] = f"""WITH {JOB_REQUESTS_V}
SELECT job_id, array_to_string(list_sort(list_distinct(list_transform(seed_urls, lambda u: {auth('u')}))), ',') AS hosts
FROM jr WHERE len(seed_urls) > 0"""

# ── URL filters and scorers on the link graph ───────────────────────────────

SQL["avoid_default"] = f"""WITH {LINK_GRAPH}
SELECT src_id, pos, dst_url AS url, regexp_matches(dst_url, {q(DEFAULT_AVOID_RE)}) AS avoided FROM lgi"""

SQL["avoid_plan"] = f"""WITH {LINK_GRAPH}
SELECT src_id, pos, dst_url AS url,
  contains(dst_url, '/de/') OR contains(dst_url, 'example.org/1') OR contains(dst_url, 'a.b') AS avoided FROM lgi"""

SQL["filter_stats"] = f"""WITH {LINK_GRAPH}, {SEEDS}, f AS (
  SELECT 'job-' || {auth('src_url')} AS job_id,
    NOT regexp_matches(dst_url, {q(DEFAULT_AVOID_RE)}) AND NOT contains(dst_url, '/de/') AS ok FROM lgi)
SELECT job_id, 'exclusion' AS filter, count(*) FILTER (WHERE ok) AS accepted,
  count(*) FILTER (WHERE NOT ok) AS rejected FROM f WHERE job_id IN (SELECT job_id FROM seeds) GROUP BY job_id"""

SQL["focus_scores"] = f"""WITH {LINK_GRAPH}
SELECT src_id, pos, dst_url AS url, (CASE WHEN contains(dst_url, '/en/') THEN 0.8 ELSE 0.4 END)::DOUBLE AS score FROM lgi"""

SQL["external_first_scores"] = f"""WITH {LINK_GRAPH}, {SEEDS}, c AS (
  SELECT 'job-' || {auth('src_url')} AS job_id, src_id, pos, dst_url AS url FROM lgi)
SELECT b.src_id, b.pos, b.url, {score_sql(True)} AS score FROM c b WHERE b.job_id IN (SELECT job_id FROM seeds)"""

SQL["job_result_rows"] = f"""WITH {RESULTS_V}
SELECT job_id, seq, url, depth, substring(text, 1, 500) AS text_snippet, links_count, score
FROM results_v WHERE error = ''"""

SQL["session_append"] = f"""WITH {RESULTS_V}, m AS (SELECT max(seq) AS s FROM results_v)
SELECT seq, url, error FROM results_v
UNION ALL
SELECT m.s + row_number() OVER (ORDER BY r.seq) AS seq, r.url, '' AS error FROM results_v r, m WHERE r.error <> ''"""

SQL["doc_bm25"] = f"""WITH dl AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
du AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM dl),
bl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(line) AS text FROM du WHERE trim(line) <> ''),
tk AS (SELECT doc_id, pos, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM bl),
st AS (SELECT doc_id, count(*) AS nb, avg(len(toks)) AS avgdl FROM tk GROUP BY doc_id),
qt AS (SELECT unnest({GOAL_TERMS}) AS term),
tf AS (SELECT tk.doc_id, tk.pos, qt.term, len(list_filter(tk.toks, lambda x: x = qt.term)) AS tf, len(tk.toks) AS dl
  FROM tk CROSS JOIN qt),
dfq AS (SELECT doc_id, term, count(*) FILTER (WHERE tf > 0) AS n FROM tf GROUP BY doc_id, term),
sc AS (SELECT tf.doc_id, tf.pos,
  coalesce(sum(CASE WHEN tf.tf > 0 THEN ln((st.nb - dfq.n + 0.5) / (dfq.n + 0.5) + 1) * tf.tf * 2.5
    / (tf.tf + 1.5 * (0.25 + 0.75 * coalesce(tf.dl / nullif(st.avgdl, 0), 0))) ELSE 0 END), 0) AS s
  FROM tf JOIN st USING (doc_id) JOIN dfq USING (doc_id, term) GROUP BY tf.doc_id, tf.pos),
scored AS (SELECT tk.doc_id, tk.pos, tk.text, coalesce(sc.s, 0) AS s FROM tk LEFT JOIN sc USING (doc_id, pos)),
agg AS (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE {r4('s')} >= 1.2) AS kept,
  length(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE {r4('s')} >= 1.2), '')) AS fit_len,
  {r4('max(s)')} AS best FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.paragraphs, 0) AS paragraphs, coalesce(a.kept, 0) AS kept,
  CAST(coalesce(a.fit_len, 0) AS BIGINT) AS fit_len, a.best FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id"""

SQL["job_from_payloads"] = SQL["job_defaults"]

# ── event log, job records, settings, plan flow ────────────────────────────

USABLE = "length(job_id) % 3 <> 0"
EVENT_LOG = f"""c AS ({crawl_sql(max_pages=15, max_depth=2, planned=USABLE)}),
jobs AS (SELECT DISTINCT 'job-' || {auth('url')} AS job_id FROM pages),
ends AS (SELECT job_id, max(status) AS status FROM c GROUP BY job_id),
parts AS (SELECT job_id, 1 AS place, 0 AS nth, 'status' AS event, 'planning' AS status, NULL AS summary, NULL AS error, NULL AS url,
    NULL::INTEGER AS depth, NULL::BIGINT AS pages_done FROM jobs
  UNION ALL SELECT job_id, 2, 0, CASE WHEN {USABLE} THEN 'plan' ELSE 'plan_error' END, NULL, CASE WHEN {USABLE} THEN 'Crawl of ' || substr(job_id, 5) END,
    CASE WHEN NOT ({USABLE}) THEN '''url''' END, NULL, NULL, NULL FROM jobs
  UNION ALL SELECT job_id, 3, 0, 'status', 'running', NULL, NULL, NULL, NULL, NULL FROM jobs
  UNION ALL SELECT job_id, 4, pages_done, 'page', NULL, NULL, error, url, depth, pages_done FROM c
  UNION ALL SELECT job_id, 5, 0, 'status', coalesce(ends.status, 'completed'), NULL, NULL, NULL, NULL, NULL FROM jobs LEFT JOIN ends USING (job_id))"""

SQL["crawl_event_log"] = f"""WITH {EVENT_LOG}
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY place, nth) AS seq, event, status, summary, error, url, depth, pages_done FROM parts"""

SQL["crawl_log_state"] = f"""WITH {EVENT_LOG},
n AS (SELECT job_id, count(*) FILTER (WHERE ok) AS pages_crawled, count(*) FILTER (WHERE NOT ok) AS pages_error FROM c GROUP BY job_id)
SELECT j.job_id, coalesce(ends.status, 'completed') AS status, true AS done, coalesce(n.pages_crawled, 0) AS pages_crawled, coalesce(n.pages_error, 0) AS pages_error
FROM jobs j LEFT JOIN ends USING (job_id) LEFT JOIN n USING (job_id)"""

SQL["job_view"] = f"""WITH {JOB_REQUESTS_V}, {RESULTS_V}, {CRAWL_EVENTS_V}, {PLAN_RESPONSES_V},
rr AS (SELECT 'job-' || CAST(job_id AS VARCHAR) AS job_id, seq, url, depth, score, links_count, error,
  row_number() OVER (PARTITION BY job_id, error = '' ORDER BY seq) AS position FROM results_v),
st AS (SELECT job_id, count(*) FILTER (WHERE error = '') AS ok, count(*) FILTER (WHERE error <> '') AS bad FROM rr GROUP BY job_id),
ch AS (SELECT job_id, CAST((position - 1) // 10 AS BIGINT) AS chunk, count(*) AS n,
  string_agg(concat_ws(' ', position, url, depth, printf('%.1f', score), links_count), '; ' ORDER BY position) AS results FROM rr WHERE error = '' GROUP BY ALL),
born AS (SELECT 'job-' || CAST(job_id AS VARCHAR) AS job_id, epoch_us(min(ts)) / 1e6 AS created_at FROM ev GROUP BY 1),
ls AS (SELECT 'job-' || CAST(job_id AS VARCHAR) AS job_id, status, updated_at FROM last_status)
SELECT a.job_id, a.goal, array_to_string(a.seed_urls, ',') AS seeds, coalesce(ls.status, a.status) AS status, '' AS error, born.created_at, ls.updated_at,
  a.max_depth, a.max_pages, a.min_delay_seconds, a.max_delay_seconds, a.ai_provider, a.strategy, a.content_filter, a.bm25_threshold, a.cache_mode,
  a.score_threshold, a.include_external, coalesce(st.ok, 0) AS pages_crawled, coalesce(st.bad, 0) AS pages_error, coalesce(st.ok, 0) AS results_count,
  p.summary AS plan_summary, coalesce(ch.chunk, 0) AS chunk, coalesce(ch.n, 0) AS n, coalesce(ch.results, '') AS results
FROM acc a LEFT JOIN st USING (job_id) LEFT JOIN ch USING (job_id) LEFT JOIN born USING (job_id) LEFT JOIN ls USING (job_id)
LEFT JOIN (SELECT * FROM plans WHERE outcome <> 'plan_error') p USING (job_id)"""

RAW_KEYS = "['provider', 'Max-Pages', 'max-depth', 'min-delay', 'max-delay', 'strategy', 'filter', 'bm25-threshold', 'cache', 'stealth', 'headless', 'score-threshold', 'include-external', 'color', 'min-delay', 'max-delay']"
RAW_TEXTS = "['claude', '5', '0.5', 'TRUE', 'dfs', 'none', 'abc', '-1', ' 12 ', 'no', '2.5', '1_000', 'it''s', 'enabled', '', '61', '1e1', 'nan', '4']"
SETTINGS = f"""raws AS (SELECT CAST(c_nationkey AS VARCHAR) AS session_id, c_custkey AS seq, lower(({RAW_KEYS})[(c_custkey * 7 + c_custkey // 16) % 16 + 1]) AS key,
  trim(({RAW_TEXTS})[(c_custkey * 5 + c_custkey // 19) % 19 + 1]) AS raw FROM customer),
typed AS (SELECT *, CASE WHEN key <> 'color' THEN replace(key, '-', '_') END AS field, CASE WHEN key IN ('max-pages', 'max-depth') THEN 'int'
    WHEN key IN ('min-delay', 'max-delay', 'bm25-threshold', 'score-threshold') THEN 'float' WHEN key IN ('stealth', 'headless', 'include-external') THEN 'bool' ELSE 'text' END AS kind,
  regexp_matches(raw, '^[+-]?[0-9]+(_[0-9]+)*$') AS whole, CASE WHEN raw ~ '^[-+0-9._e]+$' OR raw = 'nan' THEN TRY_CAST(replace(raw, '_', '') AS DOUBLE) END AS number FROM raws),
checked AS (SELECT *, CASE WHEN kind = 'bool' AND lower(raw) IN ('true', '1', 'yes') THEN true WHEN kind = 'bool' AND lower(raw) IN ('false', '0', 'no') THEN false END AS flag,
  CASE WHEN field IS NULL THEN 'Unknown key ''' || key || '''.  Valid keys: provider, max-pages, max-depth, min-delay, max-delay, strategy, filter, bm25-threshold, cache, stealth, headless, score-threshold, include-external'
    WHEN kind = 'bool' AND lower(raw) NOT IN ('true', '1', 'yes', 'false', '0', 'no') THEN 'Invalid value for ''' || key || ''': expected true/false, got ''' || raw || ''''
    WHEN kind = 'int' AND NOT whole THEN 'Invalid value for ''' || key || ''': invalid literal for int() with base 10: ' || CASE WHEN contains(raw, '''') THEN '"' || raw || '"' ELSE '''' || raw || '''' END
    WHEN kind = 'float' AND number IS NULL THEN 'Invalid value for ''' || key || ''': could not convert string to float: ' || CASE WHEN contains(raw, '''') THEN '"' || raw || '"' ELSE '''' || raw || '''' END
    WHEN field = 'provider' AND raw NOT IN ('claude', 'gemini') THEN 'provider must be one of: claude, gemini'
    WHEN field = 'strategy' AND raw NOT IN ('bfs', 'bestfirst', 'dfs') THEN 'strategy must be one of: bfs, bestfirst, dfs'
    WHEN field = 'filter' AND raw NOT IN ('bm25', 'pruning', 'none') THEN 'filter must be one of: bm25, pruning, none'
    WHEN field = 'cache' AND raw NOT IN ('enabled', 'bypass') THEN 'cache must be one of: enabled, bypass'
    WHEN field = 'max_depth' AND NOT (number BETWEEN 0 AND 10) THEN 'max_depth must be between 0 and 10'
    WHEN field = 'max_pages' AND NOT (number BETWEEN 1 AND 10000) THEN 'max_pages must be between 1 and 10000'
    WHEN field IN ('min_delay', 'max_delay') AND (isnan(number) OR NOT (number BETWEEN 0 AND 60)) THEN field || ' must be between 0 and 60'
    WHEN field = 'bm25_threshold' AND number <= 0 THEN 'bm25_threshold must be > 0'
    WHEN field = 'score_threshold' AND (isnan(number) OR NOT (number BETWEEN 0 AND 1)) THEN 'score_threshold must be between 0.0 and 1.0' END AS local FROM typed),
delays AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM checked WHERE field IN ('min_delay', 'max_delay') AND local IS NULL),
walk(session_id, i, seq, low, high, crossed) AS (SELECT DISTINCT session_id, 0::BIGINT, NULL::BIGINT, 1.0::DOUBLE, 3.0::DOUBLE, NULL::VARCHAR FROM delays
  UNION ALL SELECT d.session_id, d.i, d.seq, CASE WHEN d.field = 'min_delay' AND d.number <= w.high THEN d.number ELSE w.low END,
    CASE WHEN d.field = 'max_delay' AND d.number >= w.low THEN d.number ELSE w.high END,
    CASE WHEN d.field = 'min_delay' AND d.number > w.high THEN 'min_delay must be <= max_delay' WHEN d.field = 'max_delay' AND d.number < w.low THEN 'max_delay must be >= min_delay' END
  FROM walk w JOIN delays d ON d.session_id = w.session_id AND d.i = w.i + 1),
outcomes AS (SELECT c.session_id, c.seq, c.key, c.raw, c.field, coalesce(c.local, w.crossed, '') AS message, c.flag
  FROM checked c LEFT JOIN walk w ON w.session_id = c.session_id AND w.seq = c.seq)"""

SQL["settings_checked"] = f"WITH RECURSIVE {SETTINGS} SELECT * FROM outcomes"
SQL["session_settings"] = f"""WITH RECURSIVE {SETTINGS}
SELECT session_id, field, arg_max(raw, seq) AS raw FROM outcomes WHERE message = '' AND field IS NOT NULL GROUP BY session_id, field"""

SQL["plan_flow"] = f"""WITH {JOB_REQUESTS_V},
o AS (SELECT job_id, goal, seed_urls[1] AS seed, CASE WHEN goal IN ('MACHINERY', 'BUILDING') THEN 'plan_error' WHEN goal = 'AUTOMOBILE' THEN 'fallback' ELSE 'ok' END AS outcome FROM acc)
SELECT job_id, outcome, CASE goal WHEN 'MACHINERY' THEN 'provider down' WHEN 'BUILDING' THEN 'unusable plan' END AS error,
  CASE outcome WHEN 'ok' THEN 'Plan for ' || goal WHEN 'fallback' THEN 'AI plan unavailable' END AS summary,
  CASE outcome WHEN 'ok' THEN '/' || lower(goal) || '/' WHEN 'fallback' THEN '' END AS focus,
  CASE outcome WHEN 'ok' THEN goal = 'FURNITURE' WHEN 'fallback' THEN false END AS prefer_external,
  CASE outcome WHEN 'ok' THEN 'Summary: Plan for ' || goal || chr(10) || 'Focus: /' || lower(goal) || '/' || chr(10)
      || CASE WHEN goal = 'FURNITURE' THEN 'Mode: external-first (aggregator site)' || chr(10) ELSE '' END || 'Seeds:' || chr(10) || '  0.9  ' || seed || '  given'
    WHEN 'fallback' THEN 'Summary: AI plan unavailable' || chr(10) || 'Seeds:' || chr(10) || '  0.5  ' || seed END AS view
FROM o"""

SQL["listing_records"] = f"""WITH li AS (SELECT page_id, regexp_extract_all(html, {q(r'(?is)<li>(.*?)</li>')}, 1) AS items, regexp_extract_all(html, {q(r'(?is)<h1>(.*?)</h1>')}, 1) AS heads FROM pages),
u AS (SELECT page_id, unnest(items) AS x, unnest(range(1, len(items) + 1)) AS i, true AS item FROM li UNION ALL SELECT page_id, unnest(heads), 1000000 + unnest(range(len(heads))), false FROM li),
k AS (SELECT *, nullif(regexp_extract(x, {q(HREF_SQL)}, 1), '') AS href FROM u WHERE NOT item OR i % 2 = 1 OR i = 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS rec_no, replace(replace({strip_tags('x')}, '&quot;', '"'), '&amp;', '&') AS text, CASE WHEN item AND starts_with(href, '/') THEN href END AS href,
  CASE WHEN item AND contains(href, 'e') THEN {strip_tags('x')} END AS with_e FROM k"""

TANGLED = """tangled AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN replace(html, '<ul><li>', '<nav>inner</nav><ul><li>') WHEN 2 THEN replace(html, '</footer>', '')
  WHEN 3 THEN replace(replace(html, '<article>', '<article><section><aside>note <p>more</section><p>after '), '</nav>', '<nav></nav></nav>') ELSE html END AS html FROM pages)"""
ANY_TAG = r"</?[A-Za-z][^>]*>"
SQL["nested_exclusion"] = f"""WITH RECURSIVE {TANGLED},
ev AS (SELECT page_id, regexp_extract_all(html, {q(ANY_TAG)}) AS tags, string_split_regex(html, {q(ANY_TAG)}) AS texts FROM tangled),
walk(page_id, i, stack, base, out) AS (SELECT page_id, 0::BIGINT, []::VARCHAR[], 0::BIGINT, texts[1] FROM ev
  UNION ALL (WITH a AS (SELECT w.*, tags[w.i + 1] AS tag, texts[w.i + 2] AS txt, starts_with(tags[w.i + 1], '</') AS ends,
      lower(regexp_extract(tags[w.i + 1], '^</?([A-Za-z][^\\s/>]*)', 1)) AS name FROM walk w JOIN ev USING (page_id) WHERE w.i < len(tags)),
    b AS (SELECT *, CASE WHEN ends AND list_contains(stack, name) THEN len(stack) + 1 - list_position(list_reverse(stack), name) ELSE 0 END AS place,
      NOT ends AND name NOT IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AS opens FROM a)
    SELECT page_id, i + 1, CASE WHEN place > 0 THEN stack[1:place - 1] WHEN opens THEN list_append(stack, name) ELSE stack END,
      CASE WHEN place > 0 AND base > 0 AND place <= base THEN 0 WHEN opens AND base = 0 AND name IN ('nav', 'footer', 'header', 'aside') THEN len(stack) + 1 ELSE base END,
      CASE WHEN base > 0 AND place > 0 AND place < base THEN out || ' ' || tag || txt WHEN base > 0 AND place = base THEN out || ' ' || txt WHEN base > 0 THEN out
        WHEN opens AND name IN ('nav', 'footer', 'header', 'aside') THEN out ELSE out || tag || txt END FROM b)),
last AS (SELECT page_id, arg_max(out, i) || CASE WHEN arg_max(base, i) > 0 THEN ' ' ELSE '' END AS html FROM walk GROUP BY page_id)
SELECT page_id, {strip_tags('html')} AS text FROM last"""

SUMMARY_TERMS = "['find', 'pricing', 'pages', 'for', 'software', 'plans']"
SQL["doc_summaries"] = f"""WITH sp AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {q(r'([.!?])[' + chr(92) + 't-' + chr(92) + 'r ]+')}, {q(chr(92) + '1')} || chr(1), 'g'), chr(1)) AS ls FROM documents),
su AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS i FROM sp),
tk AS (SELECT doc_id, i, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM su WHERE trim(text) <> ''),
st AS (SELECT doc_id, count(*) AS nb, avg(len(toks)) AS avgdl FROM tk GROUP BY doc_id),
qt AS (SELECT unnest({SUMMARY_TERMS}) AS term),
tf AS (SELECT tk.doc_id, tk.i, qt.term, len(list_filter(tk.toks, lambda x: x = qt.term)) AS tf, len(tk.toks) AS dl FROM tk CROSS JOIN qt),
dfq AS (SELECT doc_id, term, count(*) FILTER (WHERE tf > 0) AS n FROM tf GROUP BY doc_id, term),
sc AS (SELECT tf.doc_id, tf.i, sum(CASE WHEN tf.tf > 0 THEN ln((st.nb - dfq.n + 0.5) / (dfq.n + 0.5) + 1) * tf.tf * 2.5
    / (tf.tf + 1.5 * (0.25 + 0.75 * coalesce(tf.dl / nullif(st.avgdl, 0), 0))) ELSE 0 END) AS s
  FROM tf JOIN st USING (doc_id) JOIN dfq USING (doc_id, term) GROUP BY tf.doc_id, tf.i),
top AS (SELECT tk.doc_id, tk.i, tk.text, row_number() OVER (PARTITION BY tk.doc_id ORDER BY sc.s DESC, tk.i) AS rk FROM tk JOIN sc USING (doc_id, i))
SELECT d.doc_id, coalesce(string_agg(top.text, ' ' ORDER BY top.i), '') AS summary_text FROM documents d LEFT JOIN top ON top.doc_id = d.doc_id AND rk <= 3 GROUP BY d.doc_id"""
