"""One query for each operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, neardup, oracle, packing, quality, secretscan, suffixdedup, tokencount, tokenstore, toxicity, urlfilter
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences; see packing.pack_documents for nulls, empty texts and repeated rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents; see decontam.report. Null texts have no words; repeated rows are reported each."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; see quality.judge. Null texts fail; repeated rows are judged each."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shards and read back; see tokenstore.write. Null texts have the end id only; repeated rows are stored each."""
    return tokenstore.store_and_read(table(spark, sf_dir, "documents"), spark)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that stand in an earlier one; see suffixdedup.deduplicate. Rows of one doc_id don't remove each other's bytes."""
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out rows' labels; see toxicity.fit_labelled and toxicity.score. Null and empty texts score lowest."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; see secretscan.report. Null texts have none; repeated rows are reported each."""
    return secretscan.report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of all documents; see tokencount.count_tokens. Null texts have none."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents from 85 % on; see neardup.near_duplicates. Texts without words are linked with nothing."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=25).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; see urlfilter.judge. Null and malformed urls are allowed; repeated rows are judged each."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_quality_rules, op4_token_output, op5_suffix_array_dedup, op6_toxicity, op7_secret_scan, op8_token_counts, op9_minhash, op10_url_filters)}
ORACLE: dict[str, str] = {"op2_decontamination": oracle.OP2, "op3_quality_rules": oracle.OP3, "op5_suffix_array_dedup": oracle.OP5, "op7_secret_scan": oracle.OP7, "op9_minhash": oracle.OP9}
