"""Key lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import is_small

# A key is hot when it holds more than this share of the weight; at most 1/share keys can be hot.
HOT_SHARE = 0.001
BROADCAST_ROWS = 200_000


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Left join stored ``small`` (unique ``key``) onto ``big``: broadcast if its rows and bytes are few, else spread."""
    if is_small(small, BROADCAST_ROWS):
        return big.join(F.broadcast(small.drop(weight)), key, "left")
    return spread_lookup(big, small, key, weight, spread)


def spread_lookup(big: DataFrame, small: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Left join ``small`` (unique ``key``) onto ``big`` when ``small`` may be too large to broadcast.

    ``weight`` is the number of rows of ``big`` per key, known from the aggregation that made ``small``.
    Keys above HOT_SHARE of the total number at most 1/HOT_SHARE, so they are always safe to broadcast;
    their rows then take a unique dummy key through the shuffle join of the others, which spreads them.
    """
    values = [c for c in small.columns if c not in (key, weight)]
    total = small.agg(F.sum(weight)).scalar()
    hot = small.where(F.col(weight) > total * F.lit(HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    rest = small.select(
        F.struct(F.lit(-1).cast("long").alias("s"), F.col(key).alias("k")).alias("_key"),
        *[F.col(v).alias(f"_rest_{v}") for v in values],
    )
    marked = big.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    is_hot = F.col("_hot_key").isNotNull()
    shuffle_key = F.struct(
        F.when(is_hot, F.col(spread).cast("long")).otherwise(F.lit(-1).cast("long")).alias("s"), F.col(key).alias("k")
    )
    joined = marked.withColumn("_key", shuffle_key).join(rest, "_key", "left")
    out = joined.select(
        *[F.col(c) for c in big.columns],
        *[F.when(is_hot, F.col(f"_hot_{v}")).otherwise(F.col(f"_rest_{v}")).alias(v) for v in values],
    )
    return out
