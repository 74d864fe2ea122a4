"""Schemas of the records, and checks of them as DataFrames of violations.

Each check is a filter or an aggregate, so a whole table is checked in one pass; check() raises with the first ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import RESOLVED


class SchemaError(ValueError):
    """A record breaks its contract."""


# Fixed values of the contracts.
COGNITIVE_TYPES = ("Retrieve", "Interpret", "Inferential", "Evaluative")
SETTINGS = ("none", "text_restricted", "open_corpus")
PARSE_STATUSES = ("exact", "extracted", "unparseable", "error")
SPAN_STATUSES = ("exact", "dehyphen", "fuzzy", "multiple", "unresolved", "empty")
QUESTION_ID = r"^text\d+_q\d{2}$"
CHUNK_ID = r"^text\d+_[A-Za-z0-9]+_c\d{3,}$"
RAW_QUESTION_KEYS = ("textTitle", "cognitiveType", "criticalSpan", "distractorSpan", "question", "A_Correct", "B_Misunderstand", "C_Distractor_Span", "D_No_Support")

_SPAN = "struct<start:int,end:int,status:string,in_title:boolean,ratio:double,n_matches:int,partial:boolean>"
TEXT = "text_id string, title string, author string, body string"
QUESTION = f"question_id string, text_id string, text_title string, question string, cognitive_type string, options map<string,string>, presented map<string,string>, permutation array<string>, gold_letter string, shuffle_seed int, critical_span {_SPAN}, distractor_span {_SPAN}, linguistic_tags array<string>, linguistic_categories array<string>"
CHUNK = "chunk_id string, text_id string, chunk_text string, start_char int, end_char int, n_tokens int"
RANKING = "question_id string, setting string, method string, query_mode string, chunk_strategy string, ranking array<struct<chunk_id:string,score:double,rank:int>>"
PREDICTION = "question_id string, system string, setting string, k int, model string, context_chunk_ids array<string>, raw_output string, parsed_letter string, parse_status string, semantic_choice string, is_correct boolean, timestamp string"


def _bad(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and message of each rule that a row breaks; a rule that is null is broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("message"))


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", *keys).alias("key"), F.lit("not unique").alias("message"))


def _span_ok(span: str) -> Column:
    start, end, status = F.col(f"{span}.start"), F.col(f"{span}.end"), F.col(f"{span}.status")
    none = start.isNull() & end.isNull()
    title = F.coalesce(F.col(f"{span}.in_title"), F.lit(False))
    placed = start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end)
    return status.isin(*SPAN_STATUSES) & F.when(status.isin(*RESOLVED), F.when(title, none).otherwise(F.coalesce(placed, F.lit(False)))).otherwise(none)


def question_violations(q: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("correct", "distractor_span", "misunderstand", "no_support")])
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    rules = {
        "bad question_id": F.rlike("question_id", F.lit(QUESTION_ID)),
        "question_id of another text": F.startswith("question_id", F.concat("text_id", F.lit("_"))),
        "unknown cognitive_type": F.col("cognitive_type").isin(*COGNITIVE_TYPES),
        "options keys": F.array_sort(F.map_keys("options")) == kinds,
        "presented keys": F.array_sort(F.map_keys("presented")) == letters,
        "permutation": F.array_sort("permutation") == kinds,
        "gold_letter": F.col("gold_letter") == F.char(F.array_position("permutation", "correct") + 64),
        "critical_span": _span_ok("critical_span"), "distractor_span": _span_ok("distractor_span"),
        "tags": F.col("linguistic_tags").isNotNull() & F.col("linguistic_categories").isNotNull(),
    }
    return _bad(q, "question_id", rules).union(_repeated(q, ["question_id"]))


def prediction_violations(p: DataFrame) -> DataFrame:
    """A null letter goes with status unparseable or error, and only with these."""
    none = F.col("parsed_letter").isNull()
    rules = {
        "question_id": F.rlike("question_id", F.lit(QUESTION_ID)), "setting": F.col("setting").isin(*SETTINGS), "k": F.col("k").isNull() | (F.col("k") >= 1),
        "letter": none | F.col("parsed_letter").isin(*"ABCD"), "parse_status": F.col("parse_status").isin(*PARSE_STATUSES),
        "letter and status": none == F.col("parse_status").isin("unparseable", "error"), "letter and choice": none == F.col("semantic_choice").isNull(),
        "is_correct": F.col("is_correct") == F.coalesce(F.col("semantic_choice") == "correct", F.lit(False)),
    }
    keys = [c for c in ("config_id", "question_id") if c in p.columns]
    return _bad(p, "question_id", rules).union(_repeated(p, keys))


def ranking_violations(long: DataFrame) -> DataFrame:
    """Ranks are exactly 1..n for each question, and a file has one setting, method, mode and strategy."""
    per = long.groupBy("question_id").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("d"))
    bad = per.where("low <> 1 or high <> n or d <> n").select(F.col("question_id").cast("string").alias("key"), F.lit("ranks are not 1..n").alias("message"))
    meta = [c for c in ("setting", "method", "query_mode", "chunk_strategy") if c in long.columns]
    if not meta:
        return bad
    mixed = long.agg(F.count_distinct(*[F.coalesce(F.col(c), F.lit("")) for c in meta]).alias("n")).where("n > 1")
    return bad.union(mixed.select(F.lit("*").alias("key"), F.lit("mixed settings").alias("message")))


def chunk_violations(c: DataFrame) -> DataFrame:
    rules = {"bad chunk_id": F.rlike("chunk_id", F.lit(CHUNK_ID)), "chunk_id of another text": F.startswith("chunk_id", F.concat("text_id", F.lit("_"))), "offsets": (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char"))}
    return _bad(c, "chunk_id", rules).union(_repeated(c, ["chunk_id"]))


def join_violations(preds: DataFrame, questions: DataFrame) -> DataFrame:
    """Unknown questions, doubled predictions, and choices that the question's permutation doesn't give for the letter."""
    unknown = preds.join(questions.select("question_id"), "question_id", "left_anti").select(F.col("question_id").cast("string").alias("key"), F.lit("unknown question_id").alias("message"))
    both = preds.select("question_id", "parsed_letter", "semantic_choice").join(questions.select("question_id", "permutation"), "question_id")
    due = F.get("permutation", F.ascii("parsed_letter") - 65)
    wrong = both.where(F.col("parsed_letter").isNotNull() & ~due.eqNullSafe(F.col("semantic_choice"))).select(F.col("question_id").cast("string").alias("key"), F.lit("choice is not that of the letter").alias("message"))
    return reduce(lambda a, b: a.union(b), [unknown, wrong, _repeated(preds, [c for c in ("config_id", "question_id") if c in preds.columns]), _repeated(questions, ["question_id"])])


def check(violations: DataFrame, what: str) -> None:
    if found := violations.take(5):
        raise SchemaError(f"{what}: " + "; ".join(f"{r['key']}: {r['message']}" for r in found))
