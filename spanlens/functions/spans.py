"""Predicates on half-open character intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLVED = ("exact", "dehyphen", "fuzzy", "multiple")


def resolved(status: Column, start: Column, end: Column) -> Column:
    return F.coalesce(status.isin(*RESOLVED) & start.isNotNull() & end.isNotNull() & (end > start), F.lit(False))


def overlap_chars(cs: Column, ce: Column, ss: Column, se: Column) -> Column:
    return F.greatest(F.lit(0), F.least(ce, se) - F.greatest(cs, ss))


def overlaps(cs: Column, ce: Column, ss: Column, se: Column) -> Column:
    return (cs < se) & (ce > ss)


def covers_half(cs: Column, ce: Column, ss: Column, se: Column) -> Column:
    return 2 * overlap_chars(cs, ce, ss, se) >= se - ss
