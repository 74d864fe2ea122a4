"""Answer options: seeds, shuffles, and the letters that options are shown under."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed order of the kinds of option.
KINDS = ("correct", "misunderstand", "distractor_span", "no_support")
SEED = 13


def question_seed(question_id: Column, seed: int = SEED) -> Column:
    """The first 8 bytes, big-endian, of the SHA-256 of id|seed, as decimal digits: it can exceed a long."""
    return F.conv(F.substring(F.sha2(F.concat(question_id, F.lit(f"|{seed}")), 256), 1, 16), 16, 10)


def permutation(question_id: Column, seed: int = SEED) -> Column:
    """The kinds in the order in which a question shows them: a Mersenne Twister shuffle from question_seed()."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def shuffled(ids: pd.Series) -> pd.Series:
        def one(q: str | None) -> list[str] | None:
            if q is None:
                return None
            kinds = list(KINDS)
            random.Random(int.from_bytes(hashlib.sha256(f"{q}|{seed}".encode()).digest()[:8], "big")).shuffle(kinds)
            return kinds

        return ids.map(one)

    return shuffled(question_id)


def presented(options: Column, order: Column) -> Column:
    """map of letter to text, from a map of kind to text and the kinds in order."""
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    return F.map_from_arrays(letters, F.transform(order, lambda k: F.element_at(options, k)))


def missing_kinds(options: Column) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in KINDS]), F.map_keys(options))


def gold_letter(order: Column) -> Column:
    return F.char(F.array_position(order, "correct") + 64)


def semantic_choice(order: Column, letter: Column) -> Column:
    """The kind shown under a letter; null for none, an error for a letter beyond the kinds."""
    place = F.ascii(F.upper(letter)) - 64
    bad = letter.isNotNull() & ((place < 1) | (place > F.size(order)))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid option letter: "), letter)).cast("string")).otherwise(F.get(order, place - 1))


def is_correct(letter: Column, gold: Column) -> Column:
    return F.coalesce(letter == gold, F.lit(False))


def random_letter(question_id: Column, seed: int = SEED) -> Column:
    """A uniform letter for each question, the same whatever the order of questions."""

    @F.pandas_udf(T.StringType())
    def pick(ids: pd.Series) -> pd.Series:
        return ids.map(lambda q: None if q is None else random.Random(f"{seed}:{q}").choice("ABCD"))

    return pick(question_id)


def hashed_letter(question_id: Column, seed: int = SEED) -> Column:
    """As random_letter(), from a hash and without Python; its letters are others."""
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), question_id), 256), 1, 1), 16, 10).cast("int")
    return F.char(F.pmod(digit, F.lit(4)).cast("long") + 65)
