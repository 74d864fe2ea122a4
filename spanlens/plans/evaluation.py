"""Queries on predictions: accuracy, confusion, paired tests, diagnostics, prompts, parsing, sampling and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options
from ..functions.letters import parse_letter
from ..operators import analysis, answer, sample
from ..operators.bm25 import BM25Index
from ..sources import contracts
from ..sources.tables import questions, table
from ..streaming.resume import first_per_key
from . import retrieval


def label_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two configurations, quality and toxic, that answer each labelled document."""
    labels = table(spark, sf, "labels")
    long = labels.select(F.col("doc_id").alias("question_id"), F.explode(F.array(F.struct(F.lit("quality").alias("c"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("c"), F.col("toxic").alias("v")))).alias("r"))
    return long.select("question_id", F.col("r.c").alias("config_id"), (F.col("r.v") == 1).alias("is_correct"))


def event_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration for each event type; a user's first event of it is its answer."""
    first = first_per_key(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["event_type", "user_id"], "ts")
    kind = F.get(F.array(*[F.lit(k) for k in options.KINDS]), (F.col("event_id") % 5).cast("int"))
    return first.select(F.col("event_type").alias("config_id"), F.col("user_id").alias("question_id"), kind.alias("semantic_choice"), (F.col("event_id") % 5 == 0).alias("is_correct"), (F.col("user_id") % 3).alias("band"))


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), "lang", "source")
    return analysis.join_runs_questions(label_predictions(spark, sf), docs)


def _table(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", F.round("accuracy", 6))


def accuracy_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _table(analysis.accuracy_table(_joined(spark, sf), ["config_id", "lang"]))


def accuracy_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _table(analysis.accuracy_views(_joined(spark, sf), [["config_id"], ["config_id", "lang"], ["config_id", "source"], ["lang"]]).drop("view"))


def accuracy_multi_membership(spark: SparkSession, sf: str) -> DataFrame:
    df = _joined(spark, sf).withColumn("groups", F.array("lang", "source"))
    return _table(analysis.accuracy_by_membership(df, "groups", ["config_id"], "category"))


def accuracy_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.with_bootstrap(_joined(spark, sf), ["config_id", "lang"], n_boot=2000)


def confusion_table(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.confusion_table(event_predictions(spark, sf), ["config_id"])
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("pct_") else F.col(c) for c in out.columns])


def confusion_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.confusion_table(event_predictions(spark, sf), ["config_id", "band"])
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("pct_") else F.col(c) for c in out.columns])


def mcnemar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = analysis.compare_configs(event_predictions(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if c in ("acc_a", "acc_b", "p_value") else F.col(c) for c in out.columns])


def significance_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.significance_matrix(event_predictions(spark, sf)).withColumn("p_value", F.round("p_value", 6))


def _item_predictions(q: DataFrame) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in options.KINDS]), (F.col("question_id") % 5).cast("int"))
    return q.select("question_id", kind.alias("semantic_choice"), (F.col("question_id") % 5 == 0).alias("is_correct"))


def retrieval_vs_answer(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, q, chunks = retrieval._evaluation(spark, sf)
    ranked = retrieval._ranked(index, asked, 1)
    return _table(analysis.retrieval_vs_answer(_item_predictions(q), analysis.span_hits(ranked, chunks, q, 1, "critical_span")))


def retrieval_trap(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, q, chunks = retrieval._evaluation(spark, sf)
    ranked = retrieval._ranked(index, asked, 3)
    out = analysis.retrieval_trap(_item_predictions(q), analysis.span_hits(ranked, chunks, q, 3, "critical_span"), analysis.span_hits(ranked, chunks, q, 3, "distractor_span"))
    return _table(out).withColumn("pct_distractor", F.round("pct_distractor", 6))


def join_preds_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf).select("config_id", "question_id", "is_correct", "lang", "source")


def anti_join_resume(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"))
    return answer.pending(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("question_id")))


def unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users that are no customers."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("question_id"))
    return analysis.unknown_ids(users, table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"))).groupBy("question_id").agg(F.count("*").alias("n"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Items as questions whose options are their text after a letter."""
    q = questions(spark, sf)
    shown = F.create_map(*[x for c in "ABCD" for x in (F.lit(c), F.concat(F.lit(f"{c}: "), "question"))])
    return q.withColumn("presented", shown)


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    context = F.when(F.col("question_id") % 2 == 0, F.col("question"))
    return _asked(spark, sf).select(F.col("question_id").alias("item_id"), F.md5(F.encode(answer.build_prompt(F.col("question"), F.col("presented"), context), "utf-8")).alias("prompt_md5"))


def context_topk(spark: SparkSession, sf: str) -> DataFrame:
    ranked = BM25Index(retrieval._docs(spark, sf)).rank(retrieval._queries(spark, sf), k=3)
    ranked = ranked.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "rank")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("chunk_text"))
    got = answer.retrieval_context(ranked, docs, 3)
    return got.select(F.col("question_id").alias("item_id"), F.md5(F.encode("context", "utf-8")).alias("context_md5"), F.array_join(F.transform("context_chunk_ids", lambda c: c.cast("string")), ",").alias("doc_ids"))


LETTER_CASES = [
    ("A", "A", "exact"), (" b. ", "B", "exact"), ("(C)", "C", "extracted"), ("The answer is D.", "D", "extracted"), ("Answer: **B**", "B", "extracted"), ("**A** or rather **C**", "C", "extracted"),
    ("not A, but B", "B", "extracted"), ("not A", "A", "extracted"), ("net C mee D", "D", "extracted"), ("I don't know", None, "unparseable"), ("", None, "unparseable"), ("Answer: E", None, "unparseable"),
    ("AB", None, "unparseable"), ("first (a) then (d)", "D", "extracted"), ("d)", "D", "exact"), ("Option A's text", None, "unparseable"),
]


def parse_letter_cases(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(LETTER_CASES)], "id int, raw string")
    return df.select("id", parse_letter(F.col("raw")).alias("p")).select("id", "p.letter", "p.status")


def parse_letter_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Letters that stand alone in assistant turns."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    return turns.groupBy(parse_letter(F.col("text"))["letter"].alias("letter")).agg(F.count("*").alias("n"))


def option_seed_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", options.question_seed(F.col("item_id").cast("string")).alias("seed"))


def option_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    p = options.permutation(F.col("item_id").cast("string"))
    return table(spark, sf, "benchmark").select("item_id", p.alias("p")).select("item_id", F.array_join("p", ",").alias("permutation"), options.gold_letter(F.col("p")).alias("gold_letter"))


def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", options.random_letter(F.col("item_id").cast("string")).alias("letter"))


def random_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", options.hashed_letter(F.col("item_id").cast("string")).alias("letter"))


def stratified_sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("stratum", F.concat_ws(":", "lang", "source"))
    return sample.stratified_sample(docs, "stratum", "doc_id", 3).select("doc_id", "stratum")


def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.duplicates(table(spark, sf, "events"), ["user_id", "event_type"])


def rank_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the ranks of a ranking that lacks each third place."""
    ranked = BM25Index(retrieval._docs(spark, sf)).rank(retrieval._queries(spark, sf), k=10).where("rank <> 3")
    return contracts.ranking_violations(ranked.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "rank"))


def human_eval_export(spark: SparkSession, sf: str) -> DataFrame:
    """For each item its answers by configuration side by side, as JSON and flat."""
    p = event_predictions(spark, sf).select("question_id", "config_id", F.coalesce("semantic_choice", F.lit("unparseable")).alias("choice"))
    items = questions(spark, sf).select("question_id", F.substring("question", 1, 40).alias("preview"))
    got = items.join(p, "question_id").groupBy("question_id", "preview").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config_id", "choice")))).alias("by"))
    answers = F.array_join(F.transform(F.array_sort(F.map_entries("by")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return got.select(F.col("question_id").alias("item_id"), "preview", F.size("by").alias("n_models"), answers.alias("answers"), F.length(F.to_json("by")).alias("json_length"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = event_predictions(spark, sf).withColumn("parse_status", F.when(F.col("semantic_choice").isNull(), "unparseable").otherwise("exact"))
    return analysis.summary(p).withColumn("accuracy_new", F.round("accuracy_new", 6))


def first_events(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


def lineitem_flag_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Return flags as choices and order priorities as groups: a join of the large tables, aggregated before it is pivoted."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    counts = [F.count_if(F.col("l_returnflag") == c).alias(f"n_{c}") for c in "ANR"]
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), *counts)


QUERIES = {f.__name__: f for f in (
    accuracy_by_group, accuracy_grouping_sets, accuracy_multi_membership, accuracy_bootstrap_ci, confusion_table, confusion_by_group, mcnemar_pairs, significance_matrix_long,
    retrieval_vs_answer, retrieval_trap, join_preds_questions, anti_join_resume, unknown_ids, prompt_build, context_topk, parse_letter_cases, parse_letter_turns, option_seed_hash,
    option_shuffle, random_baseline, random_hashed, stratified_sample_hash, dup_ids, rank_contiguity, human_eval_export, run_summary, first_events, lineitem_flag_confusion,
)}
