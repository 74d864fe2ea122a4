"""The lexical gap between questions and their evidence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import jaccard, joined_ngrams

#: Words shorter than this are function words; similar words are at least so alike.
MIN_LENGTH, SIMILAR = 3, 0.70


def content_words(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= MIN_LENGTH))


@F.pandas_udf(T.DoubleType())
def best_ratio(word: pd.Series, others: pd.Series) -> pd.Series:
    """The best Ratcliff-Obershelp ratio of a word to any of others; 0 without any."""
    return pd.Series([max((SequenceMatcher(None, w, o).ratio() for o in (os if os is not None else ())), default=0.0) for w, os in zip(word, others, strict=True)])


def classify(pairs: DataFrame) -> DataFrame:
    """pair_id, word, kind (exact, subword, none) of question words q_words against evidence words s_words. Only words
    without an exact match are sent to Python."""
    rows = pairs.select("pair_id", "s_words", F.explode(content_words(F.col("q_words"))).alias("word")).withColumn("exact", F.array_contains("s_words", F.col("word")))
    ratio = best_ratio(F.col("word"), F.when(~F.col("exact"), content_words(F.col("s_words"))))
    return rows.withColumn("ratio", ratio).select("pair_id", "word", F.when(F.col("exact"), "exact").when(F.col("ratio") >= SIMILAR, "subword").otherwise("none").alias("kind"))


def similarities(pairs: DataFrame) -> DataFrame:
    """pair_id, word_jaccard, char3_jaccard of q_words and s_words."""
    words = jaccard(F.array_distinct("q_words"), F.array_distinct("s_words"))
    return pairs.select("pair_id", words.alias("word_jaccard"), jaccard(joined_ngrams(F.col("q_words")), joined_ngrams(F.col("s_words"))).alias("char3_jaccard"))


def exact_share(pairs: DataFrame) -> DataFrame:
    """Over all pairs: content words, those also in the evidence, and their share."""
    q, s = content_words(F.col("q_words")), F.col("s_words")
    n, hit = F.sum(F.size(q)), F.sum(F.size(F.array_intersect(q, s)))
    return pairs.agg(n.alias("n_words"), hit.alias("n_exact"), F.try_divide(hit, n).alias("exact_share"))
