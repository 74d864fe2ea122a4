"""DuckDB SQL of the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS win, len(w[p:p + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace(' COLLATE "C"', "")

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, (w[p], w[p + 1], w[p + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
f AS (SELECT d.doc_id, text, w, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * len(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars OR 2 * len(list_filter(w, lambda x: x = w[1])) > n_words OR coalesce(list_max(list_transform(w, lambda x: len(x))), 0) > 1000) AS kept
FROM b
"""


def _spans(kind: str, rank: int, pattern: str, group: int = 0, least: int = 1) -> str:
    """Offsets as summed lengths of the gaps and matches before: gaps come from a split at the same pattern."""
    return rf"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + len(m[i]) AS "end" FROM (
  SELECT doc_id, m, g, i, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, regexp_split_to_array(text, '{pattern}') AS gaps, unnest(range(1, len(m) + 1)) AS i FROM d))
  WHERE len(g[i]) >= {least}"""


_ANY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_KINDS = (
    ("assign", _ANY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)

OP7 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\ns AS ("
    + "\nUNION ALL ".join(_spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(_KINDS))
    + r"""),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
)

# Windows are compared as hexadecimal strings; kept bytes are what lies between the runs of covered ones.
OP5 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT w, min(doc_id) AS f FROM w GROUP BY w),
t AS (SELECT doc_id, p, p > 50 + coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS fresh FROM w JOIN m USING (w) WHERE f < doc_id),
i AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM t),
s AS (SELECT doc_id, i, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, i),
g AS (SELECT doc_id, a AS upto, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS start FROM s UNION ALL SELECT d.doc_id, d.n, coalesce(max(b), 0) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.n),
k AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (upto - start)), '' ORDER BY start) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k),
r AS (SELECT s.* FROM s JOIN c ON s.doc_id = c.doc_id AND c.class_id = c.doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
f AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(f.m, c.class_id, d.doc_id) AS component_id, d.doc_id = coalesce(f.m, c.class_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN f ON f.x = c.class_id
"""
