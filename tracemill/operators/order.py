"""Global order without a single task: running totals, dense indexes and ranks.

``Window.orderBy`` without a partition sends every row to one task. The operators here cut the key range
into buckets, work inside each bucket in parallel, and carry only one row per bucket across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import stored

# Rows of one integer key bucket; also the bound on rows of a group that is cut by line id.
BUCKET_ROWS = 1_000_000
# Number of splitters that cut the range of an arbitrary key.
SPLITTERS = 255


def carry_totals(rows: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over rows with a smaller integer ``key`` (within ``by``).

    ``(by, key)`` is unique. Two levels: keys are themselves grouped by ``key div BUCKET_ROWS``, so that no
    window partition holds more than BUCKET_ROWS rows, whatever the key range.
    """
    by = list(by)
    keyed = rows.withColumn("_upper", F.floor(F.col(key) / F.lit(BUCKET_ROWS)))
    outer = Window.partitionBy(*by).orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*by, "_upper").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    uppers = (
        keyed.groupBy(*by, "_upper")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(*by, "_upper", *[F.coalesce(F.sum(s).over(outer), F.lit(0)).alias(f"_upper_{s}") for s in sums])
    )
    within = keyed.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_inner_{s}") for s in sums])
    return within.join(uppers, [*by, "_upper"]).select(
        *rows.columns, *[(F.col(f"_inner_{s}") + F.col(f"_upper_{s}")).alias(f"before_{s}") for s in sums]
    )


def dense_index(df: DataFrame, key: str, name: str = "row_idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add a 0-based dense index in the order of a unique integer ``key``.

    A bucket is ``key div bucket_rows``, a pure function of the row, so it holds at most ``bucket_rows``
    rows and does not depend on how the input happens to be partitioned. One shuffle of the rows; the
    bucket offsets are a separate small aggregate.
    """
    bucket = F.floor(F.col(key) / F.lit(bucket_rows))
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = carry_totals(counts, "_bucket", ["n"]).drop("n")
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        keyed.withColumn("_local", local)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("before_n") + F.col("_local") - F.lit(1))
        .drop("_bucket", "_local", "before_n")
    )


def with_bucket(df: DataFrame, key: str, splitters: int = SPLITTERS) -> DataFrame:
    """Add ``_bucket``: the number of splitters up to ``key``, a key of any orderable type.

    Splitters are the distinct keys with the smallest hashes: a fixed function of the data, spread evenly
    over its ranks, and at most ``splitters`` values, so the array is small whatever the size of ``df``.
    """
    chosen = df.select(F.col(key).alias("_k")).distinct().orderBy(F.xxhash64("_k"), "_k").limit(splitters)
    bounds = chosen.agg(F.sort_array(F.collect_list("_k")).alias("b")).scalar()
    placed = df.withColumn("_bounds", bounds)
    count = F.size(F.filter("_bounds", lambda s: s <= F.col(key)))
    return placed.withColumn("_bucket", count.cast("long")).drop("_bounds")


def ranged(rows: DataFrame, keys: Sequence[str], bucket_rows: int | None = None) -> DataFrame:
    """Stored ``rows`` with ``_bucket``: ranges of about ``bucket_rows`` rows in the order of ``keys``, numbered in that order.

    The cuts come from Spark's range partitioning, which samples every partition in proportion to its rows and finds the
    range of a row by binary search, so buckets stay of that size whatever the input and however its keys are spread.
    Rows with equal keys share a bucket. Call it on stored rows: they are counted first.
    """
    parts = max(1, -(-rows.count() // (bucket_rows or BUCKET_ROWS)))
    return stored(rows.repartitionByRange(parts, *keys).withColumn("_bucket", F.spark_partition_id().cast("long")))


def running_totals(
    df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), bucket_rows: int | None = None
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over rows with a smaller ``key`` (within ``by``, if given).

    ``(by, key)`` must be unique and ``df`` stored. Two levels: totals within buckets of ``ranged``, and of the buckets before.
    """
    by = list(by)
    bucketed = ranged(df, [*by, key], bucket_rows)
    # A row for each bucket, and one more for each value of ``by``.
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = carry_totals(totals, "_bucket", sums, by).drop(*sums)
    local = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.select("*", *[F.coalesce(F.sum(s).over(local), F.lit(0)).alias(f"_local_{s}") for s in sums])
    return inside.join(offsets, [*by, "_bucket"]).select(
        *df.columns, *[(F.col(f"_local_{s}") + F.col(f"before_{s}")).alias(f"before_{s}") for s in sums]
    )


def rank_of(df: DataFrame, key: str, name: str, start: int = 1) -> DataFrame:
    """Number the rows of ``df`` from ``start`` in the order of a unique ``key``."""
    ranked = running_totals(stored(df.withColumn("_one", F.lit(1).cast("long"))), key, ["_one"])
    return ranked.withColumn(name, (F.col("before__one") + F.lit(start)).cast("long")).drop("_one", "before__one")
