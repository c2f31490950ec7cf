"""Timestamps as microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch of a timestamp or string column; NULL where it cannot be read."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    value = F.col(column) if isinstance(kind, T.TimestampType) else F.try_to_timestamp(F.col(column).cast("string"))
    return F.unix_micros(value)


def seconds_between(first: Column, last: Column) -> Column:
    """Seconds between two microsecond values."""
    return (last - first) / F.lit(1_000_000.0)
