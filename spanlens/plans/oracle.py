"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from ..operators.answer import CLOSED_PROMPT, PROMPT
from .evaluation import LETTER_CASES

_L = r"[\p{L}\p{Nl}\p{No}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    """Words of x; an apostrophe before a letter is kept by a letter that stands in for it."""
    joined = rf"replace(lower({x}), '’', '''')"
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '({_L})''({_L})', '\1ʼ \2', 'g')"
    return rf"list_transform(regexp_extract_all({joined}, '{_L}+|\p{{Nd}}+'), lambda t: replace(t, 'ʼ', ''''))"


_GRAMS = "CASE WHEN len(w) < 3 THEN [w] ELSE flatten(list_transform(range(3, least(5, len(w)) + 1), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: substr(w, i, n)))) END"


def grams(x: str) -> str:
    return f"flatten(list_transform({tok(x)}, lambda w: {_GRAMS}))"


def bm25(docs: str, queries: str, tf: str = "tf AS (SELECT scope, doc_id, term, count(*) AS tf FROM (SELECT scope, doc_id, unnest(toks) AS term FROM docs) GROUP BY ALL), dl AS (SELECT scope, doc_id, len(toks) AS dl FROM docs)") -> str:
    """CTEs up to ranked(query_id, doc_id, score, rank), from docs and queries with scope and toks."""
    last = "SELECT q.query_id, d.doc_id, coalesce(sc.s, 0) AS s FROM queries q JOIN docs d USING (scope) LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = d.doc_id"
    return f"""docs AS ({docs}), queries AS ({queries}),
{tf}, st AS (SELECT scope, count(*) AS n, avg(dl) AS a FROM dl GROUP BY scope),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest(toks) AS term FROM queries) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)))) AS s
  FROM qt JOIN tf USING (scope, term) JOIN df USING (scope, term) JOIN dl USING (scope, doc_id) JOIN st USING (scope) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM ({last}))"""


_DOCS = f"SELECT '*' AS scope, doc_id, {tok('text')} AS toks FROM documents"
_ITEMS = f"SELECT item_id AS query_id, '*' AS scope, {tok('text')} AS toks FROM benchmark"
_SHOW = "SELECT query_id AS item_id, doc_id, round(score, 6) AS score, rank FROM ranked"

# n-grams are made once for each distinct word
_GRAM_TF = f"""wc AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(toks) AS w FROM docs) GROUP BY ALL),
wg AS (SELECT w, unnest({_GRAMS}) AS term FROM (SELECT DISTINCT w FROM wc)), tf AS (SELECT '*' AS scope, doc_id, term, sum(c) AS tf FROM wc JOIN wg USING (w) GROUP BY ALL),
dl AS (SELECT scope, docs.doc_id, coalesce(n, 0) AS dl FROM docs LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id) USING (doc_id))"""

_CHUNKS = r"""t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '\s*\S+') AS p FROM documents),
i AS (SELECT *, len(p) AS n, CASE WHEN len(p) <= 150 THEN 1 ELSE ceil((len(p) - 150) / 75.0)::INT + 1 END AS c FROM t WHERE len(p) > 0),
k AS (SELECT *, unnest(range(0, c)) AS i FROM i),
chunks AS (SELECT doc_id AS text_id, concat(doc_id, '_overlap_c', CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END) AS chunk_id,
  CASE WHEN i = 0 THEN 0 ELSE len(array_to_string(p[1:i * 75], '')) + len(regexp_extract(p[i * 75 + 1], '^\s*')) END AS start_char,
  CASE WHEN i = c - 1 THEN len(text) ELSE len(array_to_string(p[1:least(i * 75 + 150, n)], '')) END AS end_char, least(150, n - i * 75) AS n_tokens, text FROM k)"""

_GOLD = """g AS (SELECT b.item_id, b.text AS question, d.doc_id AS text_id, d.text AS body, instr(d.text, b.text) - 1 AS s, instr(d.text, b.text) - 1 + len(b.text) AS e
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(b.text) > 0 QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) = 1)"""

_EVAL = f"""WITH {_CHUNKS}, {_GOLD},
{bm25(f"SELECT '*' AS scope, chunk_id AS doc_id, {tok('substr(text, start_char + 1, end_char - start_char)')} AS toks FROM chunks", f"SELECT item_id AS query_id, '*' AS scope, {tok('question')} AS toks FROM g")},
r AS (SELECT query_id, rank, c.n_tokens, c.text_id = g.text_id AS same, c.text_id = g.text_id AND start_char < e AND end_char > s AS hit,
  c.text_id = g.text_id AND start_char < e AND end_char > s AND 2 * (least(end_char, e) - greatest(start_char, s)) >= e - s AS half,
  c.text_id = g.text_id AND start_char < 2 * len(body) // 3 AND end_char > len(body) // 3 AS lure
  FROM ranked JOIN chunks c ON c.chunk_id = ranked.doc_id JOIN g ON g.item_id = query_id),
m AS (SELECT query_id, min(rank) FILTER (hit) AS a, min(rank) FILTER (half) AS h, min(rank) FILTER (same) AS src, min(rank) FILTER (lure) AS d,
  coalesce(sum(n_tokens) FILTER (rank <= 1), 0) AS t1, coalesce(sum(n_tokens) FILTER (rank <= 3), 0) AS t3, coalesce(sum(n_tokens) FILTER (rank <= 5), 0) AS t5, coalesce(sum(n_tokens) FILTER (rank <= 10), 0) AS t10 FROM r GROUP BY query_id)"""


def _rows(*rows: tuple[str, str, str, str]) -> str:
    return _EVAL + "\n" + "\nUNION ALL ".join(f"SELECT '{m}' AS metric, '{c}' AS criterion, {k}::INT AS k, round(({v})::DOUBLE, 6) AS value, count(*) AS n FROM m" for m, c, k, v in rows)


def _ranks(name: str, criterion: str, col: str, mrr: str | None) -> str:
    rows = [(name, criterion, str(k), f"avg(CASE WHEN {col} <= {k} THEN 1.0 ELSE 0.0 END)") for k in (1, 3, 5, 10)]
    return _rows(*rows, *[(mrr, criterion, "NULL", f"avg(coalesce(1.0::DOUBLE / {col}, 0))")] * (mrr is not None))


def _values(names: str, rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({names})"


_COS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, list_inner_product(q.v, d.v) / nullif(q.norm * d.norm, 0) AS s FROM u q, u d WHERE q.vec_id % 100 = 0)"""


def _cos(where: str) -> str:
    return f"WITH {_COS}, ranked AS (SELECT query_id, doc_id, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, doc_id) AS rank FROM p WHERE {where})"


_FUSE = f"""{_cos('true')},
b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, -abs(q.embedding[1]::DOUBLE - d.embedding[1]::DOUBLE) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)),
ab AS (SELECT query_id, doc_id, x.score AS s1, x.rank AS r1, y.score AS s2, y.rank AS r2 FROM ranked x JOIN b y USING (query_id, doc_id))"""

_FUSED = "SELECT query_id AS item_id, doc_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, r1) AS rank FROM f) WHERE rank <= 10"

_LEX = f"{_GOLD}, l AS (SELECT item_id, {tok('question')} AS q, {tok('body')} AS s FROM g)"
_PRED = "p AS (SELECT doc_id, 'quality' AS config_id, quality = 1 AS ok FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels), j AS (SELECT config_id, p.doc_id AS question_id, ok, lang, source FROM p LEFT JOIN documents d ON d.doc_id = p.doc_id)"
_EV = """f AS (SELECT event_type AS config_id, user_id AS question_id, event_id, user_id % 3 AS band FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1),
x AS (SELECT *, event_id % 5 = 0 AS ok, ['correct', 'misunderstand', 'distractor_span', 'no_support', 'unparseable'][event_id % 5 + 1] AS choice FROM f)"""
_ACC = "count(*) AS n, sum(ok::INT)::BIGINT AS n_correct, round(avg(ok::INT), 6) AS accuracy"
_CONF = "count(*) AS n, " + ", ".join(f"count(*) FILTER (choice = '{c}') AS n_{c}, round(count(*) FILTER (choice = '{c}') / count(*), 6) AS pct_{c}" for c in ("correct", "misunderstand", "distractor_span", "no_support", "unparseable"))
_PAIRS = f"""{_EV},
c AS (SELECT a.config_id AS config_a, b.config_id AS config_b, count(*) AS n, avg(a.ok::INT) AS acc_a, avg(b.ok::INT) AS acc_b, count(*) FILTER (a.ok AND NOT b.ok) AS n10, count(*) FILTER (NOT a.ok AND b.ok) AS n01
  FROM x a JOIN x b ON a.question_id = b.question_id AND a.config_id < b.config_id GROUP BY ALL),
w AS (SELECT *, CASE WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n01, n10) + 1), lambda i: exp(lgamma((n01 + n10 + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n01 + n10 - i + 1)::DOUBLE) - (n01 + n10) * ln(2::DOUBLE))))) END AS p_value FROM c)"""
_CUT = "chr(64976)"
_SENT = rf"""s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(\n[ \t]*\n+)', concat({_CUT}, '\1'), 'g'), '([.!?…]+[»«"''„“”’)\]]*)(\s|$|' || {_CUT} || ')', concat('\1', {_CUT}, '\2'), 'g'), {_CUT}) AS p FROM documents),
o AS (SELECT doc_id, text, j, p[j] AS piece, coalesce(sum(len(p[j])) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS j FROM s)),
z AS (SELECT doc_id, j, piece, off + len(regexp_extract(piece, '^\s*')) AS a, off + len(piece) - len(regexp_extract(piece, '\s*$')) AS b FROM o WHERE regexp_matches(piece, '\S'))"""


_PARA = rf"""WITH RECURSIVE s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '(\n[ \t]*\n+)', concat({_CUT}, '\1'), 'g'), {_CUT}) AS p FROM documents),
o AS (SELECT doc_id, text, j, p[j] AS piece, coalesce(sum(len(p[j])) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS j FROM s)),
u AS (SELECT doc_id, j AS u, text, off + len(regexp_extract(piece, '^\s*')) AS a, off + len(piece) - len(regexp_extract(piece, '\s*$')) AS b, len(regexp_extract_all(piece, '\S+')) AS n FROM o WHERE regexp_matches(piece, '\S')),
y AS (SELECT doc_id, u, a, b, string_split(substr(text, a + 1, b - a), chr(10)) AS ls FROM u WHERE n > 180),
v AS (SELECT doc_id, u, a, b, k, ls[k] AS line, a + coalesce(sum(len(ls[k]) + 1) OVER (PARTITION BY doc_id, u ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM y)),
l AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS n, regexp_matches(regexp_replace(line, '\s+$', ''), '[.!?…][»«"''„“”’)\]]*$') AS ends FROM v),
f(doc_id, u, k, b, opened, held, es, ee) AS (SELECT doc_id, u, 0::BIGINT, b::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM y UNION ALL
  SELECT f.doc_id, f.u, l.k, f.b, CASE WHEN l.n = 0 THEN opened WHEN (ends AND held + l.n >= 60) OR held + l.n >= 180 THEN NULL ELSE coalesce(opened, off) END,
    CASE WHEN l.n = 0 THEN held WHEN (ends AND held + l.n >= 60) OR held + l.n >= 180 THEN 0 ELSE held + l.n END,
    CASE WHEN l.n > 0 AND ((ends AND held + l.n >= 60) OR held + l.n >= 180) THEN coalesce(opened, off) END, CASE WHEN l.n > 0 AND ((ends AND held + l.n >= 60) OR held + l.n >= 180) THEN off + len(line) END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.u = f.u AND l.k = f.k + 1),
g AS (SELECT doc_id, es AS a, ee AS b FROM f WHERE es IS NOT NULL UNION ALL SELECT doc_id, opened, b FROM f WHERE opened IS NOT NULL AND k = (SELECT max(k) FROM l WHERE l.doc_id = f.doc_id AND l.u = f.u) UNION ALL SELECT doc_id, a, b FROM u WHERE n <= 180),
h AS (SELECT g.doc_id, substr(text, a + 1, b - a) AS t, a, b FROM g JOIN s USING (doc_id)),
z AS (SELECT doc_id, a + len(regexp_extract(t, '^\s*')) AS start_char, b - len(regexp_extract(t, '\s*$')) AS end_char, len(regexp_extract_all(t, '\S+')) AS n_tokens FROM h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS idx, start_char, end_char, n_tokens FROM z WHERE n_tokens > 0"""


def _filled(template: str, context: str) -> str:
    parts = {"context": context, "question": "text"} | {f"option_{c}": f"'{c.upper()}: ' || text" for c in "abcd"}
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [quoted(before), parts[name]]
    return "concat(" + ", ".join([*out, quoted(rest)]) + ")"


ORACLE = {
    "tok_word_counts": f"SELECT doc_id, len(t) AS n_words, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "tok_char_ngrams": f"SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, unnest({grams('text')}) AS gram FROM benchmark) GROUP BY ALL",
    "text_normalize_apostrophe": _values("id, norm, words", [(1, "d'kanner ginn an d'schoul", "d'|kanner|ginn|an|d'|schoul"), (2, "l'été 2024", "l'|été|2024"), (3, "café d'e", "café|d'|e"), (4, "", ""), (5, "rock'n'roll d'", "rock'|n'|roll|d"), (6, "12'a ½ x²", "12|a|½|x²")]),
    "tag_strip_extract_categories": _values("id, plain, tags, categories", [(1, "De Mann geet ", "LEX-COMP,SYN-ORD", "LEX,SYN"), (2, "no tags <b>", "", ""), (3, "abc", "ZZZ-1,DISC-X,AAA,MORPH-V2", "MORPH,DISC,AAA,ZZZ"), (4, "", "", "")]),
    "token_counts_per_doc": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n_tokens FROM documents",
    "chunk_overlap_windows": f"WITH {_CHUNKS} SELECT chunk_id, text_id AS doc_id, start_char, end_char, n_tokens, md5(substr(text, start_char + 1, end_char - start_char)) AS md5 FROM chunks",
    "chunk_overlap_coverage": "SELECT doc_id, 0::BIGINT AS gaps FROM documents",
    "chunk_sentences": rf"WITH {_SENT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS idx, a AS start_char, b AS end_char, len(regexp_extract_all(piece, '\S+')) AS n_tokens FROM z",
    "chunk_paragraph_groups": _PARA,
    "chunk_counts": f"WITH {_CHUNKS}, {_SENT} SELECT strategy, doc_id, count(*) AS n FROM (SELECT 'overlap' AS strategy, text_id AS doc_id FROM chunks UNION ALL SELECT 'sentence', doc_id FROM z) GROUP BY ROLLUP (strategy, doc_id)",
    "span_locate_exact": 'SELECT b.item_id, d.doc_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + len(b.text) AS "end" FROM benchmark b JOIN documents d ON contains(d.text, b.text)',
    "span_locate_squashed": 'SELECT b.item_id, d.doc_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + len(b.text) AS "end" FROM benchmark b JOIN documents d ON contains(d.text, b.text)',
    "span_multiple": "SELECT b.item_id, d.doc_id, len(list_filter(range(1, len(d.text) - len(b.text) + 2), lambda i: substr(d.text, i, len(b.text)) = b.text)) AS n_matches FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "squash_hyphens": r"SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS squashed, regexp_replace(text, '[\s\-‐‑]+', '', 'g') AS joined FROM benchmark",
    "bm25_open_top5": f"WITH {bm25(_DOCS, _ITEMS)} {_SHOW} WHERE rank <= 5",
    "bm25_char_top5": f"WITH {bm25(_DOCS, _ITEMS.replace(tok('text'), grams('text')), tf=_GRAM_TF)} {_SHOW} WHERE rank <= 5",
    "bm25_full_rank": f"WITH {bm25(_DOCS, _ITEMS)} {_SHOW}",
    "bm25_restricted_by_lang": "WITH " + bm25(_DOCS.replace("'*' AS scope", "lang AS scope"), f"SELECT concat(item_id, ':', lang) AS query_id, lang AS scope, {tok('text')} AS toks FROM benchmark, (SELECT DISTINCT lang FROM documents)") + f" {_SHOW} WHERE rank <= 5",
    "dense_cosine_top10": f"{_cos('true')} {_SHOW} WHERE rank <= 10",
    "dense_restricted_by_label": f"{_cos('ql = dl')} {_SHOW} WHERE rank <= 10",
    "rrf_fusion": f"{_FUSE}, f AS (SELECT query_id, doc_id, r1, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS s FROM ab) {_FUSED}",
    "weighted_minmax_fusion": f"{_FUSE}, f AS (SELECT query_id, doc_id, r1, 0.3::DOUBLE * (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) + (1 - 0.3::DOUBLE) * (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) AS s FROM ab WINDOW w AS (PARTITION BY query_id)) {_FUSED}",
    "evidence_recall_mrr": _ranks("evidence_recall", "any", "a", "evidence_mrr"),
    "evidence_cov50": _ranks("evidence_recall", "cov50", "h", "evidence_mrr"),
    "source_recall_mrr": _ranks("source_recall", "text", "src", "source_mrr"),
    "distractor_rate": _ranks("distractor_rate", "any", "d", None),
    "context_tokens_stats": _rows(*[("context_tokens", name, str(k), f"{f}(t{k})") for k in (1, 3, 5, 10) for name, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))]),
    "jaccard_word": f"WITH {_LEX} SELECT item_id, round(len(list_intersect(list_distinct(q), list_distinct(s))) / len(list_distinct(list_concat(q, s))), 6) AS jaccard FROM l",
    "jaccard_char3": f"WITH {_LEX}, z AS (SELECT item_id, array_to_string(q, '') AS a, array_to_string(s, '') AS b FROM l), y AS (SELECT item_id, list_distinct(list_transform(range(1, len(a) - 1), lambda i: substr(a, i, 3))) AS a, list_distinct(list_transform(range(1, len(b) - 1), lambda i: substr(b, i, 3))) AS b FROM z) SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM y",
    "lexgap_exact_share": f"WITH {_LEX}, z AS (SELECT list_distinct(list_filter(q, lambda w: len(w) >= 3)) AS q, s FROM l) SELECT sum(len(q))::BIGINT AS n_words, sum(len(list_intersect(q, s)))::BIGINT AS n_exact, round(sum(len(list_intersect(q, s))) / sum(len(q)), 6) AS exact_share FROM z",
    "accuracy_by_group": f"WITH {_PRED} SELECT config_id, lang, {_ACC} FROM j GROUP BY config_id, lang",
    "accuracy_grouping_sets": f"WITH {_PRED} SELECT config_id, lang, source, {_ACC} FROM j GROUP BY GROUPING SETS ((config_id), (config_id, lang), (config_id, source), (lang))",
    "accuracy_multi_membership": f"WITH {_PRED} SELECT config_id, category, {_ACC} FROM (SELECT config_id, ok, unnest([lang, source]) AS category FROM j) GROUP BY ALL",
    "confusion_table": f"WITH {_EV} SELECT config_id, {_CONF} FROM x GROUP BY config_id",
    "confusion_by_group": f"WITH {_EV} SELECT config_id, band, {_CONF} FROM x GROUP BY config_id, band",
    "mcnemar_pairs": f"WITH {_PAIRS} SELECT config_a, config_b, n, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, n10, n01, round(p_value, 6) AS p_value FROM w",
    "significance_matrix_long": f"WITH {_PAIRS} SELECT config_a, config_b, round(p_value, 6) AS p_value FROM w UNION ALL SELECT config_b, config_a, round(p_value, 6) FROM w UNION ALL SELECT config_id, config_id, NULL FROM (SELECT DISTINCT config_id FROM x)",
    "retrieval_vs_answer": f"""{_EVAL}, y AS (SELECT query_id % 5 = 0 AS ok, CASE WHEN a <= 1 THEN 'retrieved' ELSE 'missed' END AS "group" FROM m)
SELECT v."group", count(ok) AS n, count(*) FILTER (ok) AS n_correct, count(*) FILTER (NOT ok) AS n_incorrect, round(avg(ok::INT), 6) AS accuracy FROM (VALUES ('retrieved'), ('missed')) AS v("group") LEFT JOIN y USING ("group") GROUP BY 1""",
    "retrieval_trap": f"""{_EVAL}, y AS (SELECT query_id % 5 = 0 AS ok, query_id % 5 = 2 AS lured, CASE WHEN a <= 3 AND d <= 3 THEN 'both' WHEN a <= 3 THEN 'critical only' WHEN d <= 3 THEN 'distractor only' ELSE 'neither' END AS "group" FROM m)
SELECT v."group", count(ok) AS n, count(*) FILTER (lured) AS chose_distractor, round(avg(lured::INT), 6) AS pct_distractor, count(*) FILTER (ok) AS n_correct, round(avg(ok::INT), 6) AS accuracy FROM (VALUES ('distractor only'), ('both'), ('critical only'), ('neither')) AS v("group") LEFT JOIN y USING ("group") GROUP BY 1""",
    "join_preds_questions": f"WITH {_PRED} SELECT config_id, question_id, ok AS is_correct, lang, source FROM j",
    "anti_join_resume": "SELECT doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "unknown_ids": "SELECT user_id AS question_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id",
    "prompt_build": f"SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN {_filled(PROMPT, 'text')} ELSE {_filled(CLOSED_PROMPT, '')} END) AS prompt_md5 FROM benchmark",
    "context_topk": f"WITH {bm25(_DOCS, _ITEMS)} SELECT query_id AS item_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id",
    "parse_letter_cases": _values("id, letter, status", [(i, letter, status) for i, (_, letter, status) in enumerate(LETTER_CASES)]),
    "option_seed_hash": "SELECT item_id, (('0x' || substr(sha256(concat(item_id, '|13')), 1, 16))::UBIGINT)::VARCHAR AS seed FROM benchmark",
    "random_hashed": "SELECT item_id, chr(65 + ('0x' || substr(sha256(concat('13:', item_id)), 1, 1))::INT % 4) AS letter FROM benchmark",
    "stratified_sample_hash": "SELECT doc_id, concat(lang, ':', source) AS stratum FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat(doc_id, '|13')), doc_id) <= 3",
    "dup_ids": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "rank_contiguity": f"WITH {bm25(_DOCS, _ITEMS)} SELECT query_id::VARCHAR AS key, 'ranks are not 1..n' AS message FROM ranked WHERE rank <= 10 AND rank <> 3 GROUP BY query_id HAVING min(rank) <> 1 OR max(rank) <> count(*)",
    "human_eval_export": f"""WITH {_EV}, y AS (SELECT item_id, substr(text, 1, 40) AS preview, config_id, choice FROM benchmark JOIN x ON question_id = item_id)
SELECT item_id, preview, count(*)::INT AS n_models, string_agg(concat(config_id, '=', choice), ';' ORDER BY config_id) AS answers, (1 + sum(len(config_id) + len(choice) + 6))::INT AS json_length FROM y GROUP BY ALL""",
    "run_summary": f"WITH {_EV} SELECT count(*) AS n_new, count(*) FILTER (ok) AS correct, count(*) FILTER (choice = 'unparseable') AS unparseable, 0::BIGINT AS error, round(avg(ok::INT), 6) AS accuracy_new FROM x",
    "first_events": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "lineitem_flag_confusion": "SELECT o_orderpriority, count(*) AS n, " + ", ".join(f"count(*) FILTER (l_returnflag = '{c}') AS \"n_{c}\"" for c in "ANR") + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
}
