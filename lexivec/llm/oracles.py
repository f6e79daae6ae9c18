"""SQL that gives the rows of those queries that SQL can express."""

from lexivec.llm import quality_rules

_SPANS = """
SELECT doc_id, '{kind}' AS kind, {no} AS no, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS s, length(ms[i]) AS n, {least} AS fit
FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))
"""
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_UNION = " UNION ALL ".join(
    (
        _SPANS.format(kind="assign", no=0, pattern=_ASSIGN, least=f"length(regexp_extract(ms[i], '{_ASSIGN}', 2)) >= 6"),
        _SPANS.format(kind="access", no=1, pattern="AKIA[A-Z0-9]+", least="length(ms[i]) >= 20"),
        _SPANS.format(kind="hex", no=2, pattern="[0-9a-f]{{24,}}".replace("{{", "{").replace("}}", "}"), least="true"),
        _SPANS.format(kind="pem", no=3, pattern="-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----".replace("{{", "{").replace("}}", "}"), least="true"),
        _SPANS.format(kind="jwt", no=4, pattern=r"eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}".replace("{{", "{").replace("}}", "}"), least="true"),
    )
)

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, kind, no, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({_UNION}) WHERE fit),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS k, count(*) FILTER (no = 2) AS h,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS al FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id GROUP BY w.doc_id
"""

RANKED = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM (SELECT doc_id, list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents) WHERE len(ts) > 0),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY t, nd),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, row, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY item_id, row, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CHARS = "CAST(length(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT)"
_SYMBOLS = "CAST(length({0}) - length(translate({0}, '#*$%&|<>', '')) AS BIGINT)"
QUALITY = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, {_quoted(quality_rules.SPACE)}), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_quoted(quality_rules.WORD)})) AS ls FROM t),
g AS (SELECT row, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
m AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
r AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM m, range(0, 5) AS x(k) GROUP BY row),
k AS (SELECT row, string_agg(l, '') AS l FROM (SELECT DISTINCT row, l FROM (SELECT row, unnest(ls) AS l FROM w)
  WHERE (regexp_matches(l, {_quoted(quality_rules.ENDS)}) OR length(l) >= 100 AND regexp_matches(l, {_quoted(quality_rules.INNER)})) AND 100 * {_SYMBOLS.format("l")} <= 10 * {_CHARS.format("l")} AND NOT regexp_matches(l, {_quoted(quality_rules.NAVIGATES)})
  AND NOT (length(l) <= 200 AND regexp_matches(l, {_quoted(quality_rules.BOILERPLATE)}))) GROUP BY row),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, {_CHARS.format("t")} AS word_chars, {_SYMBOLS.format("t")} AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {_CHARS.format("coalesce(l, '')")} AS left_chars FROM w LEFT JOIN r USING (row) LEFT JOIN k USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars - left_chars AS lost_chars,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (word_chars - left_chars) <= 40 * word_chars AS kept FROM b
"""

ORACLES = {"op1_secret_scans": SECRETS, "op7_topk_search": TOP_K, "op9_minhash_near_dedup": NEAR_DUPLICATES, "op11_lexical_search": RANKED, "op12_quality_rules": QUALITY}
