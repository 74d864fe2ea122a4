"""Report tables: small results as Markdown, CSV and metadata on the driver."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.spans import overlaps
from .operators import analysis


def _cell(v: object, digits: int) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def to_markdown(df: DataFrame, digits: int = 3) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(_cell(v, digits) for v in row) + " |" for row in df.collect()])


def write_table(df: DataFrame, out_dir: str, name: str, title: str, notes: str = "", meta: dict | None = None) -> Path:
    """name.csv, name.md and, with meta, name.meta.json in a local folder."""
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(out / f"{name}.csv", index=False)
    (out / f"{name}.md").write_text(f"# {title}\n\n{notes + chr(10) * 2 if notes else ''}{to_markdown(df)}\n")
    if meta is not None:
        (out / f"{name}.meta.json").write_text(json.dumps(meta, indent=2, sort_keys=True))
    return out / f"{name}.md"


def metrics_report(rows: DataFrame, meta: dict, skipped: dict) -> str:
    head = "Retrieval metrics: " + ", ".join(f"{k}={v}" for k, v in meta.items())
    return f"### {head}\n\n{to_markdown(rows, 4)}\n\nSkipped: " + ", ".join(f"{k}={v}" for k, v in skipped.items())


def table_setting_accuracy(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.accuracy_table(joined, list(analysis.CONFIG)).orderBy(*analysis.CONFIG), out_dir, "setting_accuracy", "Accuracy by configuration")


def table_cognitive_breakdown(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.accuracy_table(joined, [*analysis.CONFIG, "cognitive_type"]).orderBy(*analysis.CONFIG, "cognitive_type"), out_dir, "cognitive_breakdown", "Accuracy by cognitive type")


def table_linguistic_breakdown(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.accuracy_by_membership(joined, "linguistic_categories", list(analysis.CONFIG), "category").orderBy(*analysis.CONFIG, "category"), out_dir, "linguistic_breakdown", "Accuracy by linguistic category", "A question counts in each of its categories.")


def table_confusion(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.confusion_table(joined, list(analysis.CONFIG)).orderBy(*analysis.CONFIG), out_dir, "confusion", "Choices by configuration")


def table_confusion_by_cognitive_type(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.confusion_table(joined, [*analysis.CONFIG, "cognitive_type"]).orderBy(*analysis.CONFIG, "cognitive_type"), out_dir, "confusion_by_cognitive_type", "Choices by cognitive type")


def table_significance(joined: DataFrame, out_dir: str) -> Path:
    return write_table(analysis.significance_wide(joined).orderBy("config_a"), out_dir, "significance", "Exact paired tests")


def table_retrieval_vs_answer(preds: DataFrame, rankings: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, out_dir: str, name: str = "retrieval_vs_answer") -> Path:
    hits = analysis.span_hits(rankings, chunks, questions, k, "critical_span")
    return write_table(analysis.retrieval_vs_answer(preds, hits), out_dir, name, "Answers by retrieval", meta={"k": k})


def table_retrieval_trap(preds: DataFrame, rankings: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, out_dir: str, name: str = "retrieval_trap") -> Path:
    critical, lure = (analysis.span_hits(rankings, chunks, questions, k, s) for s in ("critical_span", "distractor_span"))
    return write_table(analysis.retrieval_trap(preds, critical, lure), out_dir, name, "Choices by what was retrieved", meta={"k": k})


def human_eval(questions: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """A nested row for each question that some model answered: what it asked, its options with kinds, both spans' texts,
    the retrieved chunks in order with whether they meet the spans, and a map of model to letter, choice and correctness.

    questions: question_id, text_id, text_title, cognitive_type, question, presented, permutation, gold_letter, body and
    both spans; answers: question_id, model, parsed_letter, semantic_choice, is_correct, context_chunk_ids, which are
    the same for all models of a question.
    """
    q = questions.select("*")
    said = F.struct(F.col("parsed_letter").alias("letter"), F.col("semantic_choice").alias("semantic"), F.col("is_correct").alias("correct"))
    per = answers.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", said.alias("said"))))).alias("model_answers"), F.first("context_chunk_ids").alias("ids"))
    got = per.select("question_id", F.posexplode("ids").alias("at", "chunk_id")).join(chunks.select("chunk_id", F.col("text_id").alias("c_text"), "chunk_text", "start_char", "end_char"), "chunk_id")
    spans = q.select("question_id", "text_id", "critical_span", "distractor_span")

    def met(span: str) -> Column:
        return F.coalesce(F.max((F.col("c_text") == F.col("text_id")) & overlaps(F.col("start_char"), F.col("end_char"), F.col(f"{span}.start"), F.col(f"{span}.end"))), F.lit(False))

    row = F.struct((F.col("at") + 1).alias("rank"), "chunk_id", F.col("chunk_text").alias("text"))
    shown = got.join(spans, "question_id").groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("retrieved_chunks"), met("critical_span").alias("critical_retrieved"), met("distractor_span").alias("distractor_retrieved"))
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    typed = F.map_from_arrays(letters, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.element_at("presented", F.get(letters, i)).alias("text"), F.get("permutation", i).alias("type"))))
    text = lambda s: F.coalesce(F.substring("body", F.col(f"{s}.start") + 1, F.col(f"{s}.end") - F.col(f"{s}.start")), F.lit(""))
    out = q.join(per, "question_id").join(shown, "question_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("question_id", "text_id", "text_title", "cognitive_type", "question", typed.alias("options"), "gold_letter", text("critical_span").alias("critical_span"), text("distractor_span").alias("distractor_span"), no("critical_retrieved"), no("distractor_retrieved"), "retrieved_chunks", "model_answers")


def write_human_eval(rows: DataFrame, out_dir: str, tag: str, about: str = "") -> Path:
    """human_eval_<tag>.jsonl, a folder of JSON lines, and human_eval_<tag>.md in a local folder, for people to read."""
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    rows.write.mode("overwrite").json(f"file://{out.resolve()}/human_eval_{tag}.jsonl")
    number = F.regexp_extract("text_id", r"(\d+)$", 1).cast("int")
    parts = ["# Retrieved context and answers\n", about]
    for r in rows.orderBy(number, "question_id").toLocalIterator():
        mark = {True: "yes", False: "no"}
        parts += [f"## {r['question_id']} | {r['text_title']} | {r['cognitive_type']}", f"**Question:** {r['question']}"]
        parts += [f"- {c}. {o['text']} _[{o['type']}]_" + (" **(gold)**" if c == r["gold_letter"] else "") for c, o in sorted(r["options"].items())]
        parts += [f"**{name.title()} span** (retrieved: {mark[r[f'{name}_retrieved']]}): {r[f'{name}_span']}" for name in ("critical", "distractor")]
        parts += [f"{c['rank']}. `{c['chunk_id']}` {' '.join(c['text'].split())}" for c in r["retrieved_chunks"] or ()]
        parts += [f"- {m}: {a['letter']} ({a['semantic']}), {'right' if a['correct'] else 'wrong'}" for m, a in sorted(r["model_answers"].items())]
        parts.append("")
    (out / f"human_eval_{tag}.md").write_text("\n".join(parts))
    return out / f"human_eval_{tag}.md"


def alignment_report(counts: DataFrame, chunk_counts: DataFrame) -> str:
    """Markdown of align.counts() and of chunk counts (strategy, text_id, n)."""
    by = {k: counts.where(F.col("kind") == k).orderBy("span", "value") for k in ("status", "located", "partial", "text_id", "cognitive_type")}
    parts = [f"## {title}\n\n{to_markdown(df)}" for title, df in (
        ("Spans by status", by["status"].select("span", F.col("value").alias("status"), "n")), ("Located spans", by["located"].select("span", "n")), ("Partial spans", by["partial"].select("span", "n")),
        ("Questions by text", by["text_id"].select(F.col("value").alias("text_id"), "n")), ("Questions by cognitive type", by["cognitive_type"].select(F.col("value").alias("cognitive_type"), "n")),
        ("Chunks", chunk_counts.orderBy("strategy", "text_id")),
    )]
    return "# Alignment report\n\n" + "\n\n".join(parts) + "\n"
