"""Accuracy, confusion, paired tests and retrieval diagnostics over joined predictions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.options import KINDS
from ..functions.spans import overlaps, resolved
from ..functions.stats import bootstrap_ci, mcnemar_exact
from ..session import ship

CONFIG = ("config_id", "system", "setting", "k", "model")
CHOICES = (*KINDS, "unparseable")
TRAP_GROUPS = ("distractor only", "both", "critical only", "neither")
HIT_GROUPS = ("retrieved", "missed")


def accuracy_table(df: DataFrame, by: list[str]) -> DataFrame:
    """n, n_correct, accuracy for each group; null keys make groups."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("is_correct").cast("long")).alias("n_correct"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def with_bootstrap(df: DataFrame, by: list[str], n_boot: int = 10_000, seed: int = 12_345) -> DataFrame:
    """accuracy_table() with ci_low and ci_high from resampled questions, in order of question_id."""
    ship(df.sparkSession)
    table = accuracy_table(df, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_ci(pdf.sort_values("question_id")["is_correct"].to_numpy(float), n_boot, seed)
        return pdf[by].head(1).assign(ci_low=low, ci_high=high)

    ci = df.select(*by, "question_id", "is_correct").groupBy(*by).applyInPandas(run, f"{kinds}, ci_low double, ci_high double")
    same = [table[c].eqNullSafe(ci[c]) for c in by]
    return table.join(ci, same).select(*[table[c] for c in by], "n", "n_correct", "accuracy", "ci_low", "ci_high")


def with_bootstrap_of_counts(df: DataFrame, by: list[str], n_boot: int = 10_000, seed: int = 12_345, alpha: float = 0.05) -> DataFrame:
    """with_bootstrap() from n and n_correct alone: the mean of n values of 0 and 1 drawn anew is a binomial count over n.
    So a group's rows are never gathered; its draws are others than those of the rows."""
    table = accuracy_table(df, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            draws = [np.random.default_rng(seed).binomial(int(n), good / n, n_boot) / n for n, good in zip(pdf["n"], pdf["n_correct"].fillna(0), strict=True)]
            low, high = (np.array([np.quantile(d, q) for d in draws]) for q in (alpha / 2, 1 - alpha / 2))
            yield pdf.assign(ci_low=low, ci_high=high)

    return table.mapInPandas(run, f"{kinds}, ci_low double, ci_high double")


def accuracy_views(df: DataFrame, views: list[list[str]]) -> DataFrame:
    """All groupings in one pass: grouping_id tells a view from a null key."""
    names = list(dict.fromkeys(chain.from_iterable(views)))
    sets = [[F.col(c) for c in v] for v in views]
    return df.groupingSets(sets, *names).agg(F.grouping_id().alias("view"), F.count("*").alias("n"), F.sum(F.col("is_correct").cast("long")).alias("n_correct"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def accuracy_by_membership(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """A row counts in each of its groups; rows without one in none."""
    return accuracy_table(df.withColumn(name, F.explode(column)), [*by, name])


def confusion_table(df: DataFrame, by: list[str]) -> DataFrame:
    """n, and count and share of each choice for each group; no choice counts as unparseable."""
    choice = F.coalesce("semantic_choice", F.lit("unparseable"))
    counts = [F.count_if(choice == c).alias(f"n_{c}") for c in CHOICES]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *counts)
    return out.select(*by, "n", *[f"n_{c}" for c in CHOICES], *[(F.col(f"n_{c}") / F.col("n")).alias(f"pct_{c}") for c in CHOICES])


def compare_configs(df: DataFrame) -> DataFrame:
    """config_a < config_b, n questions of both, acc_a, acc_b, n10 (only a right), n01 (only b right), p_value."""
    a = df.select(F.col("config_id").alias("config_a"), "question_id", F.col("is_correct").alias("a"))
    b = df.select(F.col("config_id").alias("config_b"), "question_id", F.col("is_correct").alias("b"))
    pairs = a.join(b, "question_id").where("config_a < config_b").groupBy("config_a", "config_b").agg(
        F.count("*").alias("n"), F.avg(F.col("a").cast("double")).alias("acc_a"), F.avg(F.col("b").cast("double")).alias("acc_b"), F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(~F.col("a") & F.col("b")).alias("n01")
    )
    return pairs.withColumn("p_value", mcnemar_exact(F.col("n01"), F.col("n10")))


def significance_matrix(df: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """config_a, config_b, p_value for both orders, and null on the diagonal."""
    if configs is not None:
        df = df.where(F.col("config_id").isin(configs))
    pairs = compare_configs(df).select("config_a", "config_b", "p_value")
    ids = df.select("config_id").distinct()
    return pairs.union(pairs.select("config_b", "config_a", "p_value")).union(ids.select("config_id", "config_id", F.lit(None).cast("double")))


def significance_wide(df: DataFrame) -> DataFrame:
    ids = sorted(r["config_id"] for r in df.select("config_id").distinct().collect())  # as many as columns
    return significance_matrix(df).groupBy("config_a").pivot("config_b", ids).agg(F.first("p_value"))


def span_hits(rankings: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, span: str) -> DataFrame:
    """question_id, hit: whether one of the first k chunks meets the span, for questions whose span is resolved."""
    s = F.col(f"{span}.start"), F.col(f"{span}.end")
    q = questions.where(resolved(F.col(f"{span}.status"), *s)).select("question_id", "text_id", span)
    c = chunks.select("chunk_id", F.col("text_id").alias("c_text"), "start_char", "end_char")
    rows = q.join(rankings.where(F.col("rank") <= k).select("question_id", "chunk_id"), "question_id").join(c, "chunk_id")
    meets = (F.col("c_text") == F.col("text_id")) & overlaps(F.col("start_char"), F.col("end_char"), *s)
    return rows.groupBy("question_id").agg(F.max(meets).alias("hit"))


def _complete(df: DataFrame, groups: tuple[str, ...], aggs: dict[str, Column]) -> DataFrame:
    """One row for each of groups, in their order, also where no row falls into it."""
    frame = df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(groups)], "place int, group string")
    got = df.groupBy("group").agg(*[c.alias(n) for n, c in aggs.items()])
    return frame.join(F.broadcast(got), "group", "left")


def retrieval_vs_answer(preds: DataFrame, hits: DataFrame) -> DataFrame:
    """group (retrieved, missed), n, n_correct, n_incorrect, accuracy of predictions (question_id, is_correct)."""
    rows = preds.select("question_id", "is_correct").join(hits, "question_id").select("is_correct", F.when(F.col("hit"), HIT_GROUPS[0]).otherwise(HIT_GROUPS[1]).alias("group"))
    out = _complete(rows, HIT_GROUPS, {"n": F.count("*"), "n_correct": F.count_if("is_correct")})
    n, good = (F.coalesce(c, F.lit(0)) for c in ("n", "n_correct"))
    return out.select("group", n.alias("n"), good.alias("n_correct"), (n - good).alias("n_incorrect"), F.try_divide(good, n).alias("accuracy"))


def retrieval_trap(preds: DataFrame, critical: DataFrame, lure: DataFrame) -> DataFrame:
    """What was chosen by what was retrieved: group, n, chose_distractor, pct_distractor, n_correct, accuracy."""
    both = critical.select("question_id", F.col("hit").alias("c")).join(lure.select("question_id", F.col("hit").alias("d")), "question_id")
    d, b, c, none = TRAP_GROUPS
    group = F.when(F.col("c") & F.col("d"), b).when(F.col("c"), c).when(F.col("d"), d).otherwise(none)
    rows = preds.select("question_id", "is_correct", "semantic_choice").join(both, "question_id").select("is_correct", "semantic_choice", group.alias("group"))
    out = _complete(rows, TRAP_GROUPS, {"n": F.count("*"), "chose": F.count_if(F.col("semantic_choice") == "distractor_span"), "n_correct": F.count_if("is_correct")})
    n, chose, good = (F.coalesce(x, F.lit(0)) for x in ("n", "chose", "n_correct"))
    return out.select("group", n.alias("n"), chose.alias("chose_distractor"), F.try_divide(chose, n).alias("pct_distractor"), good.alias("n_correct"), F.try_divide(good, n).alias("accuracy"))


def join_runs_questions(preds: DataFrame, questions: DataFrame) -> DataFrame:
    q = questions.drop(*[c for c in questions.columns if c in preds.columns and c != "question_id"])
    return preds.join(q, "question_id", "left")


def unknown_ids(preds: DataFrame, questions: DataFrame) -> DataFrame:
    return preds.join(questions.select("question_id"), "question_id", "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def summary(preds: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if("is_correct")
    return preds.agg(n.alias("n_new"), good.alias("correct"), F.count_if(F.col("parse_status") == "unparseable").alias("unparseable"), F.count_if(F.col("parse_status") == "error").alias("error"), F.try_divide(good, n).alias("accuracy_new"))
