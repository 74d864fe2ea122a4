"""Retrieval runs: questions against chunks by a method and setting, as a long ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import get_tokenizer
from ..sources.readers import infer_strategy, nested_rankings, rankings_filename
from .bm25 import BM25Index
from .dense import DenseIndex
from .fuse import reciprocal_rank_fusion, weighted_minmax_fusion

METHODS = ("bm25", "dense", "hybrid_rrf", "hybrid_w")
SETTINGS = ("text_restricted", "open_corpus")
QUERY_MODES = ("question_only", "question_options")


def build_query(mode: str, question: Column | None = None, presented: Column | None = None) -> Column:
    question = F.col("question") if question is None else question
    if mode == "question_only":
        return question
    if mode != "question_options":
        raise ValueError(f"unknown query mode: {mode!r}")
    presented = F.col("presented") if presented is None else presented
    return F.concat_ws(" ", question, *[F.element_at(presented, c) for c in "ABCD"])


def method_label(method: str, analyzer: str = "word", model: str | None = None, alpha: float | None = None) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method!r}")
    suffix = "_char" if analyzer == "char_ngram" else ""
    if method == "bm25":
        return "bm25" + suffix
    if method == "dense":
        return f"dense_{model}" if model else "dense"
    return ("hybrid_rrf" if method == "hybrid_rrf" else f"hybrid_w{alpha:g}") + suffix


def run_search(questions: DataFrame, chunks: DataFrame, method: str, setting: str, mode: str = "question_only", analyzer: str = "word", alpha: float = 0.5, model: str | None = None, is_nfc: bool = False) -> DataFrame:
    """question_id, setting, method, query_mode, chunk_id, score, rank: the full ranking of the candidates of each question.

    questions: question_id, text_id, question (presented for question_options; embedding for dense methods); chunks:
    chunk_id, text_id, chunk_text (embedding). Candidates are all chunks, or those of the question's text.
    """
    if setting not in SETTINGS:
        raise ValueError(f"unknown setting: {setting!r}")
    label = method_label(method, analyzer, model, alpha)
    restricted = setting == "text_restricted"
    scope = F.col("text_id").cast("string") if restricted else F.lit("*")
    sparse = dense = None
    if method != "dense":
        tokens = get_tokenizer(analyzer, is_nfc=is_nfc)
        docs = chunks.select(scope.alias("scope"), F.col("chunk_id").alias("doc_id"), tokens(F.col("chunk_text")).alias("tokens"))
        q = questions.select(F.col("question_id").alias("query_id"), scope.alias("scope"), tokens(build_query(mode)).alias("tokens"))
        sparse = BM25Index(docs).rank(q)
    if method != "bm25":
        if "embedding" not in chunks.columns or "embedding" not in questions.columns:
            raise ValueError(f"method {method!r} needs embeddings")
        dense = DenseIndex(chunks.withColumnRenamed("chunk_id", "doc_id")).rank(questions.withColumnRenamed("question_id", "query_id"), restricted=restricted)
    out = sparse if method == "bm25" else dense if method == "dense" else reciprocal_rank_fusion(sparse, dense) if method == "hybrid_rrf" else weighted_minmax_fusion(sparse, dense, alpha)
    return out.select(F.col("query_id").alias("question_id"), F.lit(setting).alias("setting"), F.lit(label).alias("method"), F.lit(mode).alias("query_mode"), F.col("doc_id").alias("chunk_id"), "score", "rank")


def run_and_write(questions: DataFrame, chunks: DataFrame, method: str, setting: str, out_dir: str, mode: str = "question_only", **how: object) -> str:
    """Writes the rankings of run_search() as JSON lines, a line for each question, under out_dir and the name that tells
    setting, method, strategy (of the chunks' ids, which must have one) and mode; returns the path."""
    ranked = run_search(questions, chunks, method, setting, mode, **how)
    strategies = [r["s"] for r in chunks.select(infer_strategy(F.col("chunk_id")).alias("s")).distinct().limit(2).collect()]
    if len(strategies) != 1:
        raise ValueError("chunks must be of one strategy")
    label = method_label(method, how.get("analyzer", "word"), how.get("model"), how.get("alpha", 0.5))
    path = f"{out_dir.rstrip('/')}/{rankings_filename(setting, label, strategies[0], mode)}"
    nested_rankings(ranked.withColumn("chunk_strategy", F.lit(strategies[0]))).write.mode("overwrite").json(path)
    return path
