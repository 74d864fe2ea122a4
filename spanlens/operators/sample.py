"""Stratified samples of questions."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def stratified_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: int = 13) -> DataFrame:
    """At most k rows of each stratum, those of the least hashes of key and seed: the same on any engine and partitioning."""
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256)
    order = Window.partitionBy(stratum).orderBy(h, key)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def stratum_order(s: object) -> tuple:
    """Numbers by size, then texts with a number at the end (text2, text10) by what stands before and the number, then others."""
    if not isinstance(s, str):
        return (0, "", s, "")
    m = re.fullmatch(r"(.*?)([0-9]+)", s, re.S)
    return (1, m[1], int(m[2]), s) if m else (2, s, 0, s)


def seeded_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: int = 13) -> DataFrame:
    """As one generator draws them, stratum by stratum in stratum_order. The draw is sequential, so this is for question sets
    that fit in one task, as (stratum, key) pairs."""
    ship(rows.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(stratum, key).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames))
        rng = random.Random(seed)
        parts = sorted(pdf.sort_values([stratum, key]).groupby(stratum), key=lambda p: stratum_order(p[0]))
        out = [(s, x) for s, part in parts for x in sorted(rng.sample(list(part[key]), min(k, len(part))))]
        yield pd.DataFrame(out, columns=[stratum, key])

    chosen = rows.select(stratum, key).coalesce(1).mapInPandas(run, kinds)
    return rows.join(chosen, [stratum, key], "left_semi")
