"""Exact tests and intervals for paired and single proportions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar_exact(n01: Column, n10: Column) -> Column:
    """Two-sided exact p-value of discordant counts: min(1, 2 P[Binomial(n, 1/2) <= min]); 1 for n = 0.

    Terms are summed by their ratio from the largest downwards, in logarithms at the start, so large n don't underflow.
    """
    n, k = n01 + n10, F.least(n01, n10)
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n.cast("double") * math.log(2.0)
    # P = top * (1 + k/(n-k+1) * (1 + (k-1)/(n-k+2) * ...))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(1.0), lambda acc, i: F.when(i > k, acc).otherwise(1.0 + acc * i.cast("double") / (n - i + 1).cast("double")))
    p = F.least(F.lit(1.0), 2.0 * F.exp(log_top) * F.when(k == 0, F.lit(1.0)).otherwise(tail))
    bad = (n01 < 0) | (n10 < 0)
    return F.when(bad, F.raise_error(F.lit("counts must not be negative")).cast("double")).when(n == 0, F.lit(1.0)).otherwise(p)


def _log_factorial(n: Column) -> Column:
    """Exact sums for small n, Stirling's series beyond."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(n, F.lit(30).cast("long")), F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    m = F.greatest(x, F.lit(1.0))
    series = m * F.log(m) - m + 0.5 * F.log(2 * math.pi * m) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
    return F.when(n <= 30, small).otherwise(series)


BOOT, BOOT_SEED, ALPHA = 10_000, 12_345, 0.05


def bootstrap_ci(correct: np.ndarray, n_boot: int = BOOT, seed: int = BOOT_SEED, alpha: float = ALPHA) -> tuple[float | None, float | None]:
    """Percentile interval of the mean over resamples drawn with one PCG64 stream, in blocks of bounded size."""
    x = np.asarray(correct, float)
    if not len(x):
        return None, None
    rng, means, step = np.random.default_rng(seed), [], max(1, 4_000_000 // len(x))
    for at in range(0, n_boot, step):
        means.append(x[rng.integers(0, len(x), size=(min(step, n_boot - at), len(x)))].mean(axis=1))
    low, high = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)
