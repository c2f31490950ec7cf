"""Count tables of fixed size: each task fills its own, and their sum is formed in two bounded steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So many tables at most meet in one group of the first step.
TABLES_AT_ONCE = 256


def packed(counts: np.ndarray) -> bytes:
    """A table of counts as bytes, in the narrowest of three widths."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(blob) // width])


def summed(tables: DataFrame, key: str, kind: str, width: int) -> DataFrame:
    """(key, counts): the sum of the tables (key of type ``kind``, counts binary of ``width`` packed counters) of each key."""

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint64)
        for blob in frame["counts"]:
            out += unpacked(blob, width)
        return pd.DataFrame({key: frame[key].iloc[:1], "counts": [packed(out)]})

    schema = f"{key} {kind}, counts binary"
    salted = tables.withColumn("_salt", F.floor(F.spark_partition_id() / F.lit(TABLES_AT_ONCE)))
    return salted.groupBy(key, "_salt").applyInPandas(total, schema).groupBy(key).applyInPandas(total, schema)
