"""Expressions on id and event arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_padding(ids: Column) -> Column:
    return F.filter(ids, lambda i: i > 0)


def effective_length(ids: Column) -> Column:
    """Number of entries that are not padding; the full length when all are."""
    kept = F.size(without_padding(ids))
    return F.when(kept > 0, kept).otherwise(F.size(ids))


def distinct_count(values: Column) -> Column:
    return F.size(F.array_distinct(values))


def repetition_ratio(values: Column) -> Column:
    """Length over number of distinct entries."""
    return F.try_divide(F.size(values).cast("double"), distinct_count(values).cast("double"))


def padded(ids: Column, length: Column) -> Column:
    """Fill with zeros on the right up to ``length``."""
    missing = F.greatest(F.lit(0), length - F.size(ids))
    return F.concat(ids, F.array_repeat(F.lit(0), missing))


def overlap(values: Column, start: Column, low: Column, high: Column) -> Column:
    """The part of ``values`` (which begin at position ``start``) at positions ``low <= p < high``."""
    first = F.greatest(F.lit(0), low - start)
    last = F.least(F.size(values).cast("long"), high - start)
    return F.slice(values, (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
