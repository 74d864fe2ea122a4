"""Queries on text: analysers, tags, chunkers, span location, rankings, fusion and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import (
    char_ngram_tokenize, extract_tags, find_all, jaccard, joined_ngrams, n_tokens, normalize, squash, strip_tags, tag_categories, word_tokenize,
)
from ..operators import align, chunk, dense, fuse, lexgap, metrics
from ..operators.bm25 import BM25Index
from ..sources.contracts import COGNITIVE_TYPES
from ..sources.tables import containing, gold, questions, table, texts
from ..storage import materialise

# Chunk windows of the queries on documents.
W, STEP = 150, 75


def tok_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf).select("text_id", word_tokenize(F.col("body")).alias("t"))
    return t.select(F.col("text_id").alias("doc_id"), F.size("t").alias("n_words"), F.size(F.array_distinct("t")).alias("n_distinct"))


def tok_char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    t = questions(spark, sf).select("question_id", F.explode(char_ngram_tokenize(F.col("question"))).alias("gram"))
    return t.groupBy(F.col("question_id").alias("item_id"), "gram").agg(F.count("*").alias("n"))


def text_normalize_apostrophe(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "D’Kanner ginn an d'Schoul"), (2, "l’Été 2024"), (3, "café D’E"), (4, ""), (5, "rock'n'roll d'"), (6, "12'a ½ x²")]
    df = spark.createDataFrame(rows, "id int, s string")
    return df.select("id", normalize(F.col("s")).alias("norm"), F.array_join(word_tokenize(F.col("s")), "|").alias("words"))


def tag_strip_extract_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, "De <LEX-COMP>Mann<SYN-ORD> geet <LEX-COMP>"), (2, "no tags <b>"), (3, "<ZZZ-1>a<DISC-X>b<AAA>c<MORPH-V2>"), (4, "")]
    df = spark.createDataFrame(rows, "id int, s string")
    tags = extract_tags(F.col("s"))
    return df.select("id", strip_tags(F.col("s")).alias("plain"), F.array_join(tags, ",").alias("tags"), F.array_join(tag_categories(tags), ",").alias("categories"))


def token_counts_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(F.col("text_id").alias("doc_id"), n_tokens(F.col("body")).alias("n_tokens"))


def chunk_overlap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk(texts(spark, sf), "overlap").select("chunk_id", F.col("text_id").alias("doc_id"), "start_char", "end_char", "n_tokens", F.md5(F.encode("chunk_text", "utf-8")).alias("md5"))


def chunk_overlap_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf)
    return chunk.coverage(chunk.chunk(t, "overlap"), t).select(F.col("text_id").alias("doc_id"), "gaps")


def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk(texts(spark, sf), "sentence").select(F.col("text_id").alias("doc_id"), "idx", "start_char", "end_char", "n_tokens")


def chunk_paragraph_groups(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk(texts(spark, sf), "paragraph").select(F.col("text_id").alias("doc_id"), "idx", "start_char", "end_char", "n_tokens")


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by strategy and text, with totals, as a rollup."""
    t = texts(spark, sf)
    both = chunk.chunk(t, "overlap").select(F.lit("overlap").alias("strategy"), "text_id").union(chunk.chunk(t, "sentence").select(F.lit("sentence"), "text_id"))
    return both.rollup("strategy", F.col("text_id").alias("doc_id")).agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return containing(texts(spark, sf), questions(spark, sf), "body", "question", ["text_id", "question_id"])


def span_locate_exact(spark: SparkSession, sf: str) -> DataFrame:
    start = F.get(find_all(F.col("question"), F.col("body")), F.lit(0))
    return _pairs(spark, sf).select(F.col("question_id").alias("item_id"), F.col("text_id").alias("doc_id"), start.alias("start"), (start + F.length("question")).alias("end"))


def span_locate_squashed(spark: SparkSession, sf: str) -> DataFrame:
    got = align.locate_exact(F.regexp_replace("question", r"\s+", "  "), F.col("body"))
    return _pairs(spark, sf).select(F.col("question_id").alias("item_id"), F.col("text_id").alias("doc_id"), got.alias("g")).select("item_id", "doc_id", "g.start", "g.end")


def span_multiple(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, overlapping ones too, of each item in each document that holds it."""
    return _pairs(spark, sf).select(F.col("question_id").alias("item_id"), F.col("text_id").alias("doc_id"), F.size(find_all(F.col("question"), F.col("body"))).alias("n_matches"))


def span_locate_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a letter changed in every twelve, located in the first document that holds them."""
    g = gold(spark, sf).join(texts(spark, sf), "text_id")
    raw = F.regexp_replace("question", r"(?s)(.{11}).", "$1x")
    got = align.align(g.select("question_id", raw.alias("raw"), "body", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author")))
    return got.select(F.col("question_id").alias("item_id"), "span.*")


def alignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of an alignment report: critical spans are items with a letter changed in every twelve, distractor spans the items
    themselves, and cognitive types are dealt by item."""
    g = gold(spark, sf).join(texts(spark, sf), "text_id")
    kinds = F.array(*[F.lit(t) for t in COGNITIVE_TYPES])
    g = g.withColumn("cognitive_type", F.get(kinds, F.pmod(F.col("question_id"), F.lit(len(COGNITIVE_TYPES))).cast("int")))
    raw = {"critical": F.regexp_replace("question", r"(?s)(.{11}).", "$1x"), "distractor": F.col("question")}
    none = F.lit(None).cast("string")
    for which, r in raw.items():
        g = align.align(g.withColumns({"raw": r, "title": none, "author": none})).withColumnRenamed("span", f"{which}_span")
    return align.counts(g)


def squash_hyphens(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select(F.col("question_id").alias("item_id"), squash(F.col("question")).alias("squashed"), squash(F.col("question"), drop_hyphens=True).alias("joined"))


def _docs(spark: SparkSession, sf: str, scope=None) -> DataFrame:
    tokens = word_tokenize(F.col("text"))
    return table(spark, sf, "documents").select(F.lit("*").alias("scope") if scope is None else scope.alias("scope"), "doc_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))


def _queries(spark: SparkSession, sf: str, grams: bool = False) -> DataFrame:
    tokens = (char_ngram_tokenize if grams else word_tokenize)(F.col("question"))
    return questions(spark, sf).select(F.col("question_id").alias("query_id"), F.lit("*").alias("scope"), tokens.alias("tokens"))


def _top(ranked: DataFrame, k: int | None = None) -> DataFrame:
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_open_top5(spark: SparkSession, sf: str) -> DataFrame:
    return _top(BM25Index(_docs(spark, sf)).rank(_queries(spark, sf), k=5))


def bm25_char_top5(spark: SparkSession, sf: str) -> DataFrame:
    return _top(BM25Index(_docs(spark, sf), grams=(3, 5)).rank(_queries(spark, sf, True), k=5))


def bm25_full_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _top(BM25Index(_docs(spark, sf)).rank(_queries(spark, sf)))


def bm25_restricted_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and ranking inside each language; every item asks each."""
    docs = _docs(spark, sf, F.col("lang"))
    q = _queries(spark, sf).drop("scope").crossJoin(table(spark, sf, "documents").select(F.col("lang").alias("scope")).distinct())
    q = q.select(F.concat_ws(":", F.col("query_id").cast("string"), "scope").alias("query_id"), "scope", "tokens")
    return _top(BM25Index(docs).rank(q, k=5))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that are searched for: every hundredth id."""
    e = table(spark, sf, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("text_id"))
    return docs, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("text_id"))


def dense_cosine_top10(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _vectors(spark, sf)
    return _top(dense.DenseIndex(docs).rank(q, 10))


def dense_restricted_by_label(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _vectors(spark, sf)
    return _top(dense.DenseIndex(docs).rank(q, 10, restricted=True))


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the vectors that labels are searched in: by cosine, and by distance of the first coordinate."""
    docs, q = _vectors(spark, sf)
    first = dense.DenseIndex(docs).rank(q)
    a, b = q.select("query_id", F.col("embedding")[0].cast("double").alias("x")), docs.select("doc_id", F.col("embedding")[0].cast("double").alias("y"))
    scored = a.crossJoin(b).select("query_id", "doc_id", (-F.abs(F.col("x") - F.col("y"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return first, scored.withColumn("rank", F.row_number().over(order))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _top(fuse.reciprocal_rank_fusion(*_two(spark, sf)), 10)


def weighted_minmax_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _top(fuse.weighted_minmax_fusion(*_two(spark, sf), alpha=0.3), 10)


def _evaluation(spark: SparkSession, sf: str) -> tuple[BM25Index, DataFrame, DataFrame, DataFrame]:
    """An index of overlap chunks of all documents, the items that some document holds as queries, the same as questions
    with the span there as evidence and the middle third of that document as the distractor, and the chunks."""
    t = texts(spark, sf)
    g = materialise(gold(spark, sf))
    span = lambda a, b: F.struct(F.lit("exact").alias("status"), a.alias("start"), b.alias("end"))
    g = g.join(t.select("text_id", F.length("body").alias("n")), "text_id")
    q = materialise(g.select("question_id", "question", "text_id", span(F.col("start"), F.col("end")).alias("critical_span"), span(F.floor(F.col("n") / 3).cast("int"), F.floor(2 * F.col("n") / 3).cast("int")).alias("distractor_span")))
    # chunks are cut and read once, and written without their texts
    kept = ("text_id", "start_char", "end_char", "n_tokens")
    docs = chunk.chunk(t, "overlap").select(F.lit("*").alias("scope"), F.col("chunk_id").alias("doc_id"), word_tokenize(F.col("chunk_text")).alias("tokens"), *kept)
    asked = q.select(F.col("question_id").alias("query_id"), F.lit("*").alias("scope"), word_tokenize(F.col("question")).alias("tokens"))
    index = BM25Index(docs, keep=kept)
    search = index.search(asked)
    chunks = search.table if search else materialise(docs.drop("scope", "tokens"))
    return index, asked, q, chunks.select(F.col("doc_id").alias("chunk_id"), *kept)


def _ranked(index: BM25Index, asked: DataFrame, k: int) -> DataFrame:
    return index.rank(asked, k).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "score", "rank")


def _metric(spark: SparkSession, sf: str, names: dict[str, str | None]) -> DataFrame:
    rows = metrics.tidy(metrics.first_ranks_of_scores(*_evaluation(spark, sf)))
    cond = F.lit(False)
    for name, criterion in names.items():
        cond = cond | ((F.col("metric") == name) & (F.lit(True) if criterion is None else F.col("criterion") == criterion))
    return rows.where(cond)


def evidence_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, {"evidence_recall": "any", "evidence_mrr": "any"})


def evidence_cov50(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, {"evidence_recall": "cov50", "evidence_mrr": "cov50"})


def source_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, {"source_recall": None, "source_mrr": None})


def distractor_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, {"distractor_rate": None})


def context_tokens_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _metric(spark, sf, {"context_tokens": None})


def _lexpairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each item against the first document that holds it."""
    g = gold(spark, sf).join(texts(spark, sf), "text_id")
    return g.select(F.col("question_id").alias("pair_id"), word_tokenize(F.col("question")).alias("q_words"), word_tokenize(F.col("body")).alias("s_words"))


def jaccard_word(spark: SparkSession, sf: str) -> DataFrame:
    return _lexpairs(spark, sf).select(F.col("pair_id").alias("item_id"), F.round(jaccard(F.array_distinct("q_words"), F.array_distinct("s_words")), 6).alias("jaccard"))


def jaccard_char3(spark: SparkSession, sf: str) -> DataFrame:
    return _lexpairs(spark, sf).select(F.col("pair_id").alias("item_id"), F.round(jaccard(joined_ngrams(F.col("q_words")), joined_ngrams(F.col("s_words"))), 6).alias("jaccard"))


def lexgap_exact_share(spark: SparkSession, sf: str) -> DataFrame:
    return lexgap.exact_share(_lexpairs(spark, sf)).withColumn("exact_share", F.round("exact_share", 6))


def lexgap_subword(spark: SparkSession, sf: str) -> DataFrame:
    return lexgap.classify(_lexpairs(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    tok_word_counts, tok_char_ngrams, text_normalize_apostrophe, tag_strip_extract_categories, token_counts_per_doc, chunk_overlap_windows, chunk_overlap_coverage, chunk_sentences,
    chunk_paragraph_groups, chunk_counts, span_locate_exact, span_locate_squashed, span_multiple, span_locate_fuzzy, alignment_counts, squash_hyphens, bm25_open_top5, bm25_char_top5, bm25_full_rank,
    bm25_restricted_by_lang, dense_cosine_top10, dense_restricted_by_label, rrf_fusion, weighted_minmax_fusion, evidence_recall_mrr, evidence_cov50, source_recall_mrr, distractor_rate,
    context_tokens_stats, jaccard_word, jaccard_char3, lexgap_exact_share, lexgap_subword,
)}
