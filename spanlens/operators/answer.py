"""Contexts, prompts, runs of an injected client over questions, and their resumption."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import parse_letter
from ..functions.options import is_correct, random_letter, semantic_choice

# The two prompts.
PROMPT = """You are answering a Luxembourgish reading-comprehension question.
Use only the provided context.
Choose exactly one answer: A, B, C, or D.
Return only the letter of the correct answer.

Context: {context}

Question: {question}

Options:
A. {option_a}
B. {option_b}
C. {option_c}
D. {option_d}

Answer:"""
CLOSED_PROMPT = """You are answering a Luxembourgish reading-comprehension question.
Choose exactly one answer: A, B, C, or D.
Return only the letter of the correct answer.

Question: {question}

Options:
A. {option_a}
B. {option_b}
C. {option_c}
D. {option_d}

Answer:"""

# Parts of an error's text, in lower case, that mean no further call can succeed.
TERMINAL = ("insufficient_quota", "exceeded your current quota", "billing", "invalid_api_key", "invalid api key", "authentication", "permission denied")


def prompt_template_hash() -> str:
    return hashlib.sha256(f"{PROMPT}\n===\n{CLOSED_PROMPT}".encode()).hexdigest()[:16]


def _filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with fields put in; their text may hold braces or per cent signs."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), fields[name]]
    return F.concat(*parts, F.lit(rest))


def build_prompt(question: Column, presented: Column, context: Column) -> Column:
    """A null context gives the closed-book prompt, an empty one keeps its block."""
    fields = {"question": question} | {f"option_{c.lower()}": F.element_at(presented, c) for c in "ABCD"}
    return F.when(context.isNull(), _filled(CLOSED_PROMPT, fields)).otherwise(_filled(PROMPT, fields | {"context": F.coalesce(context, F.lit(""))}))


def retrieval_context(rankings: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """question_id, context (texts of the first k chunks in order of rank, a blank line between) and their ids. A
    ranked chunk that is not known is an error."""
    if k <= 0:
        raise ValueError("k must be at least 1")
    top = rankings.where(F.col("rank") <= k).select("question_id", "chunk_id", "rank")
    got = top.join(chunks.select("chunk_id", "chunk_text"), "chunk_id", "left")
    text = F.when(F.col("chunk_text").isNull(), F.raise_error(F.concat(F.lit("unknown chunk: "), "chunk_id")).cast("string")).otherwise(F.col("chunk_text"))
    items = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", text.alias("text"))))
    return got.groupBy("question_id").agg(items.alias("items")).select("question_id", F.array_join(F.transform("items", lambda x: x["text"]), "\n\n").alias("context"), F.transform("items", lambda x: x["chunk_id"]).alias("context_chunk_ids"))


def full_context(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """The whole body as context, under the pseudo id text_id_full."""
    return questions.select("question_id", "text_id").join(texts.select("text_id", F.col("body").alias("context")), "text_id").select("question_id", "context", F.array(F.concat(F.col("text_id").cast("string"), F.lit("_full"))).alias("context_chunk_ids"))


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...

    def describe(self) -> dict: ...


@dataclass
class MockClient:
    """Answers by responder, else by the first substring found in the prompt, else the next output, else default."""

    responder: Callable[[str], str] | None = None
    substrings: dict[str, str] = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)
    default: str = "A"

    def complete(self, prompt: str) -> str:
        if self.responder:
            return self.responder(prompt)
        for key, value in self.substrings.items():
            if key in prompt:
                return value
        return self.outputs.pop(0) if self.outputs else self.default

    def describe(self) -> dict:
        return {"provider": "mock"}


class TerminalError(RuntimeError):
    """No later call can succeed."""


def complete_resilient(client: Client, prompt: str, retries: int = 3, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries):
        try:
            return client.complete(prompt)
        except Exception as e:
            if any(m in str(e).lower() for m in TERMINAL):
                raise TerminalError(str(e)) from e
            if attempt == retries - 1:
                raise
            sleep(backoff * (attempt + 1))
    raise ValueError("retries must be at least 1")


def answers(prompts: DataFrame, client: Client, retries: int = 3, backoff: float = 2.0) -> DataFrame:
    """question_id, raw_output of prompts (question_id, prompt). A call that fails for good gives an error row; a terminal
    error ends the job."""
    kind = prompts.schema["question_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(complete_resilient(client, p, retries, backoff))
                except TerminalError:
                    raise
                except Exception as e:
                    out.append(f"<<error: {type(e).__name__}: {e}>>")
            yield pd.DataFrame({"question_id": pdf["question_id"], "raw_output": out})

    return prompts.select("question_id", "prompt").mapInPandas(run, f"question_id {kind}, raw_output string")


def graded(outputs: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds parsed_letter, parse_status, semantic_choice and is_correct to outputs (question_id, raw_output)."""
    error = F.startswith("raw_output", F.lit("<<error: "))
    p = parse_letter(F.col("raw_output"))
    rows = outputs.withColumn("p", p).withColumn("parsed_letter", F.when(~error, F.col("p.letter"))).withColumn("parse_status", F.when(error, "error").otherwise(F.col("p.status"))).drop("p")
    rows = rows.join(questions.select("question_id", "permutation", "gold_letter"), "question_id")
    return rows.withColumn("semantic_choice", semantic_choice(F.col("permutation"), F.col("parsed_letter"))).withColumn("is_correct", is_correct(F.col("parsed_letter"), F.col("gold_letter"))).drop("permutation", "gold_letter")


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """The questions that a log (question_id) does not hold yet."""
    return questions.join(done.select("question_id").distinct(), "question_id", "left_anti")


def random_baseline(questions: DataFrame, seed: int = 13) -> DataFrame:
    return graded(questions.select("question_id", random_letter(F.col("question_id").cast("string"), seed).alias("raw_output")), questions)


@dataclass
class RunConfig:
    system: str
    setting: str = "none"
    k: int | None = None
    model: str = "mock"
    rankings: str | None = None
    chunks: str | None = None
    seed: int = 13
    limit: int | None = None


def canonical_config(config: RunConfig) -> str:
    """Sorted compact JSON in which paths count by their last part, so that a moved file is the same configuration."""
    values = {k: os.path.basename(v) if k in ("rankings", "chunks") and v else v for k, v in vars(config).items() if k != "limit"}
    return json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_id(config: RunConfig) -> str:
    return hashlib.sha256(canonical_config(config).encode()).hexdigest()[:10]


def resolve_config(config: RunConfig, rankings: DataFrame) -> RunConfig:
    """System rag and setting none are taken from the rankings."""
    first = rankings.select("method", "setting").first()
    if first is None:
        raise ValueError("the rankings are empty")
    system = first["method"] if config.system == "rag" else config.system
    setting = first["setting"] if config.setting in (None, "none") else config.setting
    return RunConfig(**{**vars(config), "system": system, "setting": setting})


# Fixed values of the grid.
GRID_METHODS, GRID_PRIMARY = ("bm25", "bm25_char", "dense_bge-m3", "hybrid_rrf_char"), "hybrid_w0.5_char"


def grid(tier: str) -> list[tuple[str, str, int]]:
    """(method, setting, k): full has 16, reduced 10, minimal 6."""
    if tier not in ("full", "reduced", "minimal"):
        raise ValueError(f"unknown tier: {tier!r}")
    settings = ("text_restricted", "open_corpus")
    out = [(GRID_PRIMARY, s, k) for s in settings for k in ((1, 3, 5, 10) if tier == "full" else (1, 5, 10))]
    compared = {"full": settings, "reduced": ("open_corpus",), "minimal": ()}[tier]
    return out + [(m, s, 5) for s in compared for m in GRID_METHODS]


def utc_stamp(ts: Column) -> Column:
    """ISO seconds with Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run(config: RunConfig, client: Client | None, questions: DataFrame, contexts: DataFrame | None, out_dir: str, retries: int = 3, backoff: float = 2.0) -> dict:
    """Answers what the log in out_dir doesn't hold yet, appends it there, and returns counters.

    contexts (question_id, context, context_chunk_ids) is None for closed-book and random runs. The log is a folder of JSON
    lines with a sidecar that describes the run; each run appends a file of its own, so a broken one loses only itself.
    """
    spark = questions.sparkSession
    name = config_id(config)
    log, side = f"{out_dir}/preds_{name}.jsonl", f"{out_dir}/preds_{name}.config.json"
    schema = "question_id string, system string, setting string, k int, model string, context_chunk_ids array<string>, raw_output string, parsed_letter string, parse_status string, semantic_choice string, is_correct boolean, timestamp string"
    empty = spark.createDataFrame([], schema)
    try:
        done = spark.read.schema(schema).json(log)
        done.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = empty
    todo = questions if config.limit is None else questions.orderBy("question_id").limit(config.limit)
    total = todo.count()
    todo = pending(todo, done)
    if config.system == "random":
        fresh = random_baseline(todo, config.seed).withColumn("context_chunk_ids", F.array().cast("array<string>"))
    else:
        joined = todo.join(contexts, "question_id", "left") if contexts is not None else todo.withColumn("context", F.lit(None).cast("string")).withColumn("context_chunk_ids", F.array().cast("array<string>"))
        prompts = joined.select("question_id", build_prompt(F.col("question"), F.col("presented"), F.col("context")).alias("prompt"))
        fresh = graded(answers(prompts, client, retries, backoff), todo).join(joined.select("question_id", "context_chunk_ids"), "question_id")
    stamp = utc_stamp(F.current_timestamp())
    rows = fresh.select("question_id", F.lit(config.system).alias("system"), F.lit(config.setting).alias("setting"), F.lit(config.k).cast("int").alias("k"), F.lit(config.model).alias("model"), "context_chunk_ids", "raw_output", "parsed_letter", "parse_status", "semantic_choice", "is_correct", stamp.alias("timestamp")).cache()
    got = rows.agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.count_if(F.col("parse_status") == "unparseable").alias("u"), F.count_if(F.col("parse_status") == "error").alias("e")).first()
    rows.write.mode("append").json(log)
    rows.unpersist()
    about = {"config": json.loads(canonical_config(config)), "prompt_template_hash": prompt_template_hash(), "client": client.describe() if client else {}}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(side)
    return {"config_id": name, "n_new": got["n"], "skipped": total - got["n"], "correct": got["c"], "unparseable": got["u"], "error": got["e"], "accuracy_new": got["c"] / got["n"] if got["n"] else None}
