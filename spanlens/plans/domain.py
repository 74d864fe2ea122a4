"""Queries on questions made of benchmark items, with DuckDB twins: options and letters, contracts, runs, searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options
from ..functions.text import default_prefixes, get_tokenizer, model_slug, normalize, preview, word_tokenize
from ..operators import align, analysis, answer, metrics, search
from ..sources import contracts, readers
from ..sources.contracts import COGNITIVE_TYPES
from ..sources.tables import gold, table, texts
from ..storage import shared_dir
from .oracle import _COS, _GOLD, _PAIRS, bm25, quoted, tok
from .retrieval import _two

STOPWORDS = ("the", "de", "la", "und", "of", "is")
TIERS = ("full", "reduced", "minimal")


def _choose(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _span(i: Column, every: int) -> Column:
    """A located span, an unresolved one, or an empty one in turn."""
    located, turn = i % every < every - 2, i % every
    status = F.when(located, "exact").when(turn == every - 2, "unresolved").otherwise("empty")
    none = F.lit(None).cast("int")
    return F.struct(
        F.when(located, i).otherwise(none).cast("int").alias("start"), F.when(located, i + 10).otherwise(none).cast("int").alias("end"), status.alias("status"), F.lit(False).alias("in_title"),
        F.lit(None).cast("double").alias("ratio"), none.alias("n_matches"), F.lit(False).alias("partial"),
    )


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Items as questions of 16 texts; the kinds of option are shown in an order that turns with the item."""
    i = F.col("item_id")
    kinds = F.array(*[F.lit(k) for k in options.KINDS])
    order = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(kinds, F.pmod(j + i, F.lit(4)).cast("int")))
    offered = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.concat(k, F.lit(": "), F.substring("question", 1, 20))))
    q = table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))
    text_id = F.concat(F.lit("text"), (i % 16).cast("string"))
    q = q.select("item_id", F.concat(text_id, F.format_string("_q%02d", i)).alias("question_id"), text_id.alias("text_id"), "question", _choose(COGNITIVE_TYPES, i % 4).alias("cognitive_type"), offered.alias("options"), order.alias("permutation"), _span(i, 5).alias("critical_span"), _span(i, 4).alias("distractor_span"))
    return q.withColumn("presented", options.presented(F.col("options"), F.col("permutation"))).withColumn("gold_letter", options.gold_letter(F.col("permutation")))


def _flag(name: str, i: str, every: int) -> str:
    return f"CASE WHEN {i} % {every} < {every - 2} THEN 'exact' WHEN {i} % {every} = {every - 2} THEN 'unresolved' ELSE 'empty' END AS {name}"


_KINDS = "[" + ", ".join(quoted(k) for k in options.KINDS) + "]"
_Q = f"""q AS (SELECT item_id, concat('text', item_id % 16) AS text_id, concat('text', item_id % 16, '_q', CASE WHEN item_id < 100 THEN lpad(item_id::VARCHAR, 2, '0') ELSE item_id::VARCHAR END) AS question_id, text AS question,
  [{', '.join(quoted(c) for c in COGNITIVE_TYPES)}][item_id % 4 + 1] AS cognitive_type, list_transform(range(0, 4), lambda j: {_KINDS}[(j + item_id) % 4 + 1]) AS perm, chr((65 + (4 - item_id % 4) % 4)::INT) AS gold, {_flag('critical', 'item_id', 5)}, {_flag('distractor', 'item_id', 4)} FROM benchmark)"""
_SHOWN = "list_transform(perm, lambda k: concat(k, ': ', substr(question, 1, 20)))"


def query_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The text that a question is searched by, in both modes."""
    q = _questions(spark, sf)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), search.build_query(m).alias("query")) for m in search.QUERY_MODES])
    return q.select("item_id", F.inline(modes)).select("item_id", "mode", F.md5(F.encode("query", "utf-8")).alias("query_md5"))


def graded_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A letter for each question from a hash, parsed and graded against the order of its options."""
    q = _questions(spark, sf)
    got = answer.graded(q.select("question_id", options.hashed_letter(F.col("item_id").cast("string")).alias("raw_output")), q)
    return got.join(q.select("question_id", "gold_letter"), "question_id").select("question_id", "parsed_letter", "parse_status", "semantic_choice", "gold_letter", "is_correct")


def stopword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    kept = word_tokenize(F.col("body"), STOPWORDS)
    return texts(spark, sf).select(F.col("text_id").alias("doc_id"), F.size(kept).alias("n_words"), F.md5(F.encode(F.array_join(kept, " "), "utf-8")).alias("words_md5"))


def tokenizers(spark: SparkSession, sf: str) -> DataFrame:
    """Both analysers, chosen by name."""
    each = F.array(*[F.struct(F.lit(a).alias("analyzer"), get_tokenizer(a)(F.col("question")).alias("t")) for a in ("word", "char_ngram")])
    return _questions(spark, sf).select("item_id", F.inline(each)).select("item_id", "analyzer", F.size("t").alias("n"), F.md5(F.encode(F.array_join("t", " "), "utf-8")).alias("tokens_md5"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(F.col("text_id").alias("doc_id"), F.md5(F.encode(preview(F.col("body")), "utf-8")).alias("preview_md5"))


def nfc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose accented letters are taken apart first, so that the normal form has to join them again."""
    apart = F.col("body")
    for joined, split in (("é", "é"), ("ü", "ü"), ("ñ", "ñ")):
        apart = F.replace(apart, F.lit(joined), F.lit(split))
    return texts(spark, sf).select(F.col("text_id").alias("doc_id"), (F.length(apart) - F.length("body")).alias("n_apart"), F.md5(F.encode(normalize(apart), "utf-8")).alias("norm_md5"))


def model_slugs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("e5 / "), F.col("p_type"), F.lit(" ")).alias("a"), F.concat_ws("/", "p_brand", "p_name").alias("b"))
    each = p.select("p_partkey", F.explode(F.array("a", "b")).alias("model"))
    return each.select("p_partkey", model_slug(F.col("model")).alias("slug"), default_prefixes(F.col("model")).alias("x")).select("p_partkey", "slug", "x.query", "x.passage")


def event_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", answer.utc_stamp(F.col("ts")).alias("stamp"))


def missing_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that lack the kinds of option before the place that their number gives."""
    few = F.map_filter("options", lambda k, v: F.array_position(F.array(*[F.lit(x) for x in options.KINDS]), k) > F.col("item_id") % 4)
    return _questions(spark, sf).select("item_id", F.array_join(options.missing_kinds(few), ",").alias("missing"))


def full_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Each question with the whole body of the document of its number."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("item_id").alias("text_id"))
    got = answer.full_context(q, texts(spark, sf))
    return got.select(F.col("question_id").alias("item_id"), F.md5(F.encode("context", "utf-8")).alias("context_md5"), F.array_join("context_chunk_ids", ",").alias("ids"))


def _some_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranks for each question, and for each third one an id that no question has."""
    q = _questions(spark, sf).select("item_id", "question_id")
    unknown = q.where("item_id % 3 = 0").select("item_id", F.concat(F.lit("x"), "question_id").alias("question_id"))
    return q.union(unknown).select("question_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))


def skipped_questions(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.skipped(_some_rankings(spark, sf), _questions(spark, sf))
    return got.select("question_id", F.array_join("reasons", ",").alias("reasons"))


def skip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.skip_counts(_some_rankings(spark, sf), _questions(spark, sf))


def mixed_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of a ranking of two settings whose ranks start at 2 for each seventh question."""
    q = _questions(spark, sf)
    long = q.select("question_id", F.when(F.col("item_id") % 2 == 0, "none").otherwise("open_corpus").alias("setting"), F.explode(F.sequence(F.when(F.col("item_id") % 7 == 0, 2).otherwise(1), F.lit(4))).alias("rank"))
    return contracts.ranking_violations(long)


def question_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of questions of which some have another type, gold letter, order of options, span or text."""
    i = F.col("item_id")
    q = _questions(spark, sf).withColumn("linguistic_tags", F.array().cast("array<string>")).withColumn("linguistic_categories", F.when(i % 13 != 0, F.array().cast("array<string>")))
    q = q.withColumn("cognitive_type", F.when(i % 9 == 0, "Other").otherwise(F.col("cognitive_type"))).withColumn("gold_letter", F.when(i % 6 == 0, "A").otherwise(F.col("gold_letter")))
    q = q.withColumn("permutation", F.when(i % 10 == 0, F.slice("permutation", 1, 3)).otherwise(F.col("permutation"))).withColumn("text_id", F.when(i % 8 == 0, "text99").otherwise(F.col("text_id")))
    q = q.withColumn("critical_span", F.when(i % 7 == 0, F.col("critical_span").withField("end", F.col("critical_span.start"))).otherwise(F.col("critical_span")))
    return contracts.question_violations(q)


def chunk_contract(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    c = table(spark, sf, "documents").select(F.concat(F.lit("text"), d.cast("string"), F.lit("_overlap_c"), F.format_string("%03d", d % 7)).alias("chunk_id"), F.concat(F.lit("text"), (d - d % 2).cast("string")).alias("text_id"), (d % 3).cast("int").alias("start_char"), (d % 5).cast("int").alias("end_char"))
    return contracts.chunk_violations(c.union(c.where("start_char = 1 and end_char = 4")))


def prediction_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of predictions whose letter, status and choice don't go together."""
    q, i = _questions(spark, sf), F.col("item_id")
    letter = F.when(i % 4 != 3, F.char(i % 6 + 65))
    p = q.select("question_id", F.when(i % 5 == 0, "far").otherwise("none").alias("setting"), (i % 3).cast("int").alias("k"), letter.alias("parsed_letter"), F.when(i % 7 == 0, "unparseable").otherwise("exact").alias("parse_status"), F.when(letter.isNotNull(), _choose(options.KINDS, i % 4)).alias("semantic_choice"), (i % 2 == 0).alias("is_correct"))
    return contracts.prediction_violations(p)


def chunk_strategies(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    ids = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("text"), d.cast("string"), F.lit("_"), _choose(("overlap", "sentence", "by_line"), d % 3), F.lit("_c"), F.format_string("%03d", d)).alias("chunk_id"))
    return ids.groupBy(readers.infer_strategy(F.col("chunk_id")).alias("strategy")).agg(F.count("*").alias("n"))


def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t, *row) for t in TIERS for row in answer.grid(t)], "tier string, method string, setting string, k int")


def prompt_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(answer.prompt_template_hash(),)], "hash string")


def _by_length(prompt: str) -> str:
    """An answer that the length of the prompt decides; one length fails."""
    n = len(prompt) % 6
    if n == 5:
        raise ValueError("no answer")
    return ("A", "Answer: B", "(C)", "no idea", "**D**")[n]


def mock_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a mock client into one log, the first for 15 questions, the second for the rest; read back from the log."""
    q = _questions(spark, sf)
    out = shared_dir(spark)
    client = answer.MockClient(responder=_by_length)
    for limit in (15, None):
        answer.run(answer.RunConfig("closed_book", limit=limit), client, q, None, out, retries=1)
    got = readers.read_predictions(spark, out)
    return got.select("question_id", "setting", "raw_output", "parsed_letter", "parse_status", "semantic_choice", "is_correct")


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of the second run, which finds 15 questions answered."""
    q, out = _questions(spark, sf), shared_dir(spark)
    for limit in (15, None):
        got = answer.run(answer.RunConfig("closed_book", limit=limit), answer.MockClient(responder=_by_length), q, None, out, retries=1)
    row = (got["n_new"], got["skipped"], got["correct"], got["unparseable"], got["error"], round(got["accuracy_new"], 6))
    return spark.createDataFrame([row], "n_new long, skipped long, correct long, unparseable long, error long, accuracy_new double")


def significance_of_some(spark: SparkSession, sf: str) -> DataFrame:
    """The test of two configurations out of all."""
    from .evaluation import event_predictions

    return analysis.significance_matrix(event_predictions(spark, sf), ["click", "purchase"]).withColumn("p_value", F.round("p_value", 6))


def alignment_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of an alignment report for spans that stand in their text word for word; each second distractor is empty."""
    g = gold(spark, sf).join(texts(spark, sf), "text_id")
    none = F.lit(None).cast("string")
    g = g.withColumn("cognitive_type", _choose(COGNITIVE_TYPES, F.col("question_id") % 4))
    for which, raw in {"critical": F.col("question"), "distractor": F.when(F.col("question_id") % 2 == 0, F.col("question")).otherwise("")}.items():
        g = align.align(g.withColumns({"raw": raw, "title": none, "author": none})).withColumnRenamed("span", f"{which}_span")
    return align.counts(g)


def _searched(spark: SparkSession, sf: str, method: str, setting: str, **how: object) -> DataFrame:
    """Items of which there is a vector against documents of which there is one; a language is a text."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf, "documents").join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("text_id"), F.col("text").alias("chunk_text"), "embedding")
    q = _questions(spark, sf).join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), _choose(("de", "en", "es", "fr"), F.col("item_id") % 4).alias("text_id"), "question", "embedding")
    got = search.run_search(q, docs, method, setting, **how)
    return got.where("rank <= 10").select(F.col("question_id").alias("item_id"), "setting", "method", "query_mode", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def run_search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, "bm25", "text_restricted")


def run_search_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, "dense", "text_restricted", model="given")


def run_search_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, "hybrid_rrf", "open_corpus")


def run_search_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, "hybrid_w", "open_corpus", alpha=0.3)


def fused_full(spark: SparkSession, sf: str) -> DataFrame:
    """How often a fused rank equals the first ranking's, over full rankings."""
    from ..operators import fuse

    first, second = _two(spark, sf)
    fused = fuse.reciprocal_rank_fusion(first, second).select("query_id", "doc_id", F.col("rank").alias("fused"))
    same = fused.join(first.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    return same.agg(F.count("*").alias("n"), F.count_if(F.col("fused") == F.col("rank")).alias("n_same"), F.max("fused").alias("last"))


QUERIES = {f.__name__: f for f in (
    query_modes, graded_letters, stopword_tokens, tokenizers, previews, nfc_normalize, model_slugs, event_stamps, missing_kinds, full_contexts, skipped_questions, skip_counts, mixed_rankings,
    question_contract, chunk_contract, prediction_contract, chunk_strategies, config_grid, prompt_hash, mock_run, run_counters, significance_of_some, alignment_statuses, run_search_bm25, run_search_dense,
    run_search_rrf, run_search_weighted, fused_full,
)}

_LETTER = "('0x' || substr(sha256(concat('13:', item_id)), 1, 1))::INT % 4"
#: Characters of the closed-book prompt: its fixed ones, the question, and four options of a kind and up to 20 more.
_LEN = f"({len(re.sub('{.*?}', '', answer.CLOSED_PROMPT)) + sum(len(k) + 2 for k in options.KINDS)} + len(question) + 4 * least(len(question), 20))"
_DOCS = f"SELECT '*' AS scope, doc_id, {tok('text')} AS toks FROM documents JOIN embeddings ON vec_id = doc_id"
_ITEMS = f"SELECT item_id AS query_id, '*' AS scope, {tok('text')} AS toks FROM benchmark JOIN embeddings ON vec_id = item_id"
_LANG = "['de', 'en', 'es', 'fr'][item_id % 4 + 1]"
_PAIRED = """e2 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u2 AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e2),
pairs AS (SELECT item_id AS query_id, doc_id, lang, item_id % 4 AS turn, coalesce(list_inner_product(a.v, b.v) / nullif(a.norm * b.norm, 0), 0) AS s FROM benchmark JOIN u2 a ON a.vec_id = item_id, documents JOIN u2 b ON b.vec_id = doc_id)"""
_HYBRID = f"WITH {bm25(_DOCS, _ITEMS)}, {_PAIRED}, dn AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM pairs), ab AS (SELECT query_id, doc_id, ranked.score AS s1, ranked.rank AS r1, dn.s AS s2, dn.r AS r2 FROM ranked JOIN dn USING (query_id, doc_id))"


def _shown(setting: str, method: str, source: str) -> str:
    return f"SELECT query_id AS item_id, '{setting}' AS setting, '{method}' AS method, 'question_only' AS query_mode, doc_id, round(score, 6) AS score, rank FROM {source} WHERE rank <= 10"


def _rules(rules: dict[str, str], key: str, source: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {key} AS key, {quoted(name)} AS message FROM {source} WHERE {bad}" for name, bad in rules.items())


_RUN = f"""{_Q}, n AS (SELECT *, {_LEN} % 6 AS n FROM q),
o AS (SELECT *, ['A', 'Answer: B', '(C)', 'no idea', '**D**', '<<error: ValueError: no answer>>'][n + 1] AS raw_output, ['A', 'B', 'C', NULL, 'D', NULL][n + 1] AS letter, ['exact', 'extracted', 'extracted', 'unparseable', 'extracted', 'error'][n + 1] AS status FROM n),
r AS (SELECT question_id, item_id, 'none' AS setting, raw_output, letter AS parsed_letter, status AS parse_status, CASE WHEN letter IS NOT NULL THEN perm[ascii(letter) - 64] END AS semantic_choice, coalesce(letter = gold, false) AS is_correct FROM o)"""

ORACLE = {
    "query_modes": f"WITH {_Q} SELECT item_id, 'question_only' AS mode, md5(question) AS query_md5 FROM q UNION ALL SELECT item_id, 'question_options', md5(concat(question, ' ', array_to_string({_SHOWN}, ' '))) FROM q",
    "graded_letters": f"WITH {_Q} SELECT question_id, chr(65 + {_LETTER}) AS parsed_letter, 'exact' AS parse_status, perm[{_LETTER} + 1] AS semantic_choice, gold AS gold_letter, chr(65 + {_LETTER}) = gold AS is_correct FROM q",
    "stopword_tokens": f"SELECT doc_id, len(t) AS n_words, md5(array_to_string(t, ' ')) AS words_md5 FROM (SELECT doc_id, list_filter({tok('text')}, lambda w: NOT list_contains([{', '.join(quoted(w) for w in STOPWORDS)}], w)) AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "tokenizers": f"WITH t AS (SELECT item_id, {tok('text')} AS w FROM benchmark), g AS (SELECT item_id, w, flatten(list_transform(w, lambda x: CASE WHEN len(x) < 3 THEN [x] ELSE flatten(list_transform(range(3, least(5, len(x)) + 1), lambda n: list_transform(range(1, len(x) - n + 2), lambda i: substr(x, i, n)))) END)) AS g FROM t) SELECT item_id, 'word' AS analyzer, len(w) AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM g UNION ALL SELECT item_id, 'char_ngram', len(g), md5(array_to_string(g, ' ')) FROM g",
    "previews": r"SELECT doc_id, md5(substr(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[A-Z][A-Z0-9-]*>', '', 'g'), '\s+', ' ', 'g')), 1, 80)) AS preview_md5 FROM documents",
    "nfc_normalize": "SELECT doc_id, len(regexp_replace(text, '[^éüñ]', '', 'g')) AS n_apart, md5(lower(replace(text, '’', ''''))) AS norm_md5 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "model_slugs": r"SELECT p_partkey, trim(regexp_replace(m, '[^A-Za-z0-9.\-]+', '_', 'g'), '_') AS slug, CASE WHEN contains(lower(m), 'e5') THEN 'query: ' ELSE '' END AS query, CASE WHEN contains(lower(m), 'e5') THEN 'passage: ' ELSE '' END AS passage FROM (SELECT p_partkey, unnest([concat('e5 / ', p_type, ' '), concat_ws('/', p_brand, p_name)]) AS m FROM part)",
    "event_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
    "missing_kinds": f"SELECT item_id, array_to_string({_KINDS}[1:item_id % 4], ',') AS missing FROM benchmark",
    "full_contexts": "SELECT item_id, md5(coalesce(d.text, '')) AS context_md5, concat(doc_id, '_full') AS ids FROM benchmark JOIN documents d ON doc_id = item_id",
    "skipped_questions": f"WITH {_Q}, s AS (SELECT question_id, list_filter([CASE WHEN distractor <> 'exact' THEN 'no_distractor' END, CASE WHEN critical <> 'exact' THEN 'no_evidence' END], lambda x: x IS NOT NULL) AS r FROM q UNION ALL SELECT concat('x', question_id), ['missing_question'] FROM q WHERE item_id % 3 = 0) SELECT question_id, array_to_string(r, ',') AS reasons FROM s WHERE len(r) > 0",
    "skip_counts": f"WITH {_Q} SELECT count(*) FILTER (item_id % 3 = 0) AS missing_question, count(*) FILTER (critical <> 'exact') AS no_evidence, count(*) FILTER (distractor <> 'exact') AS no_distractor FROM q",
    "mixed_rankings": f"WITH {_Q} SELECT question_id AS key, 'ranks are not 1..n' AS message FROM q WHERE item_id % 7 = 0 UNION ALL SELECT '*', 'mixed settings' FROM q GROUP BY () HAVING count(DISTINCT item_id % 2) > 1",
    "question_contract": f"WITH {_Q}\n" + _rules({
        "bad question_id": r"NOT regexp_matches(question_id, '^text\d+_q\d{2}$')", "question_id of another text": "item_id % 8 = 0", "unknown cognitive_type": "item_id % 9 = 0", "permutation": "item_id % 10 = 0",
        "gold_letter": "CASE WHEN item_id % 6 = 0 THEN 'A' ELSE gold END <> CASE WHEN item_id % 10 = 0 AND NOT list_contains(perm[1:3], 'correct') THEN '@' ELSE gold END", "critical_span": "critical = 'exact' AND item_id % 7 = 0", "tags": "item_id % 13 = 0",
    }, "question_id", "q"),
    "chunk_contract": "WITH c AS (SELECT concat('text', doc_id, '_overlap_c', lpad((doc_id % 7)::VARCHAR, 3, '0')) AS id, doc_id % 3 AS s, doc_id % 5 AS e, doc_id % 2 AS odd FROM documents), b AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE s = 1 AND e = 4) SELECT id AS key, 'chunk_id of another text' AS message FROM b WHERE odd = 1 UNION ALL SELECT id, 'offsets' FROM b WHERE s >= e UNION ALL SELECT id, 'not unique' FROM c WHERE s = 1 AND e = 4",
    "prediction_contract": f"WITH {_Q}, p AS (SELECT *, CASE WHEN item_id % 4 <> 3 THEN chr((item_id % 6 + 65)::INT) END AS letter FROM q)\n" + _rules({
        "question_id": r"NOT regexp_matches(question_id, '^text\d+_q\d{2}$')", "setting": "item_id % 5 = 0", "k": "item_id % 3 = 0", "letter": "letter > 'D'", "letter and status": "(letter IS NULL) <> (item_id % 7 = 0)",
        "is_correct": "(item_id % 2 = 0) <> (letter IS NOT NULL AND item_id % 4 = 0)",
    }, "question_id", "p"),
    "chunk_strategies": "SELECT ['overlap', 'sentence', 'by_line'][doc_id % 3 + 1] AS strategy, count(*) AS n FROM documents GROUP BY 1",
    "config_grid": """WITH s AS (SELECT unnest(['text_restricted', 'open_corpus']) AS setting), m AS (SELECT unnest(['bm25', 'bm25_char', 'dense_bge-m3', 'hybrid_rrf_char']) AS method), t AS (SELECT unnest(['full', 'reduced', 'minimal']) AS tier), k AS (SELECT unnest([1, 3, 5, 10]) AS k)
SELECT tier, 'hybrid_w0.5_char' AS method, setting, k FROM t, s, k WHERE tier = 'full' OR k <> 3 UNION ALL SELECT tier, method, setting, 5 FROM t, s, m WHERE tier = 'full' OR tier = 'reduced' AND setting = 'open_corpus'""",
    "prompt_hash": f"SELECT substr(sha256(concat({quoted(answer.PROMPT)}, chr(10), '===', chr(10), {quoted(answer.CLOSED_PROMPT)})), 1, 16) AS hash",
    "mock_run": f"WITH {_RUN} SELECT question_id, setting, raw_output, parsed_letter, parse_status, semantic_choice, is_correct FROM r",
    "run_counters": f"WITH {_RUN}, x AS (SELECT *, row_number() OVER (ORDER BY question_id) AS i FROM r) SELECT count(*) AS n_new, 15::BIGINT AS skipped, count(*) FILTER (is_correct) AS correct, count(*) FILTER (parse_status = 'unparseable') AS unparseable, count(*) FILTER (parse_status = 'error') AS error, round(avg(is_correct::INT), 6) AS accuracy_new FROM x WHERE i > 15",
    "significance_of_some": f"WITH {_PAIRS}, z AS (SELECT config_a, config_b, round(p_value, 6) AS p_value FROM w WHERE config_a = 'click' AND config_b = 'purchase') SELECT * FROM z UNION ALL SELECT config_b, config_a, p_value FROM z UNION ALL SELECT DISTINCT config_id, config_id, NULL::DOUBLE FROM x WHERE config_id IN ('click', 'purchase')",
    "alignment_statuses": rf"""WITH {_GOLD}, b AS (SELECT item_id, text_id, regexp_replace(body, '\s+', '', 'g') AS h, regexp_replace(question, '\s+', '', 'g') AS n FROM g),
c AS (SELECT *, len(list_filter(range(1, len(h) - len(n) + 2), lambda i: substr(h, i, len(n)) = n)) AS m FROM b),
z AS (SELECT 'critical' AS span, CASE WHEN m = 1 THEN 'exact' ELSE 'multiple' END AS status FROM c UNION ALL SELECT 'distractor', CASE WHEN item_id % 2 = 1 THEN 'empty' WHEN m = 1 THEN 'exact' ELSE 'multiple' END FROM c)
SELECT 'status' AS kind, span, status AS value, count(*) AS n FROM z GROUP BY ALL UNION ALL SELECT 'located', span, NULL, count(*) FILTER (status <> 'empty') FROM z GROUP BY ALL UNION ALL SELECT 'partial', span, NULL, 0 FROM z GROUP BY span
UNION ALL SELECT 'text_id', NULL, text_id::VARCHAR, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'cognitive_type', NULL, [{', '.join(quoted(x) for x in COGNITIVE_TYPES)}][item_id % 4 + 1], count(*) FROM c GROUP BY ALL""",
    "run_search_bm25": "WITH " + bm25(_DOCS.replace("'*' AS scope", "lang AS scope"), _ITEMS.replace("'*' AS scope", f"{_LANG} AS scope")) + " " + _shown("text_restricted", "bm25", "ranked"),
    "run_search_dense": f"WITH {_PAIRED}, z AS (SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM pairs WHERE lang = ['de', 'en', 'es', 'fr'][turn + 1]) " + _shown("text_restricted", "dense_given", "z"),
    "run_search_rrf": f"{_HYBRID}, f AS (SELECT query_id, doc_id, r1, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS score FROM ab), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r1) AS rank FROM f) " + _shown("open_corpus", "hybrid_rrf", "z"),
    "run_search_weighted": f"{_HYBRID}, f AS (SELECT query_id, doc_id, r1, 0.3::DOUBLE * coalesce((s1 - min(s1) OVER w) / nullif(max(s1) OVER w - min(s1) OVER w, 0), 0) + (1 - 0.3::DOUBLE) * coalesce((s2 - min(s2) OVER w) / nullif(max(s2) OVER w - min(s2) OVER w, 0), 0) AS score FROM ab WINDOW w AS (PARTITION BY query_id)), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r1) AS rank FROM f) " + _shown("open_corpus", "hybrid_w0.3", "z"),
    "fused_full": f"WITH {_COS}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, doc_id) AS r1 FROM p), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r2 FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, -abs(q.embedding[1]::DOUBLE - d.embedding[1]::DOUBLE) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)), f AS (SELECT query_id, r1, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 9) DESC, r1) AS rank FROM a JOIN b USING (query_id, doc_id)) SELECT count(*) AS n, count(*) FILTER (rank = r1) AS n_same, max(rank) AS last FROM f",
}
