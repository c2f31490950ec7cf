"""Train/validation/test split and class filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 5


def stratified(
    df: DataFrame,
    key: str = "seq_id",
    label: str = "label",
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: each class is cut at exact counts in the order of ``md5(seed:key)``.

    Test rows are taken first, then validation from the rest by the adjusted ratio. Rows are not shuffled:
    hash values at the two cuts are found from counts per hash prefix and from the rows that share the
    prefix of a cut, and every row compares its own hash with them. Pieces of one sequence share a key
    and so a split.
    """
    train, val, test = ratios
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("Ratios must sum to 1.0")
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    first = heads(hashed)
    rows = first.select(F.col(label).alias("_label"), "_hash", F.left("_hash", F.lit(BUCKET_DIGITS)).alias("_prefix"))
    # At most 16^BUCKET_DIGITS prefixes for each class.
    counts = rows.groupBy("_label", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("_label")
    before = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        "_label", "_prefix", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total")
    )
    n_test = F.floor(F.col("total") * F.lit(float(test)) + 0.5)
    n_val = F.floor((F.col("total") - n_test) * F.lit(val / (train + val) if train + val else 0.0) + 0.5)
    cuts = placed.select("_label", "_prefix", "n", "before", F.posexplode(F.array(n_test, n_test + n_val)).alias("cut", "at"))
    cuts = cuts.where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    # Two rows for each class; the rows of their prefixes are 1/16^BUCKET_DIGITS of the class each.
    near = rows.join(F.broadcast(cuts), ["_label", "_prefix"])
    bounds = near.groupBy("_label", "cut").agg(
        F.sort_array(F.collect_list("_hash")).alias("hashes"), F.first(F.col("at") - F.col("before")).alias("offset")
    ).select("_label", "cut", F.element_at("hashes", (F.col("offset") + 1).cast("int")).alias("hash"))
    limits = placed.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).join(bounds, "_label", "left").groupBy("_label").agg(
        F.max(F.when(F.col("cut") == 0, F.col("hash"))).alias("_test_end"),
        F.max(F.when(F.col("cut") == 1, F.col("hash"))).alias("_val_end"),
    )
    # A cut at the very end of a class has no row there: every hash lies below it.
    end = F.lit("~")
    split = (
        F.when(F.col("_hash") < F.coalesce("_test_end", end), "test")
        .when(F.col("_hash") < F.coalesce("_val_end", end), "val")
        .otherwise("train")
    )
    return (
        hashed.join(F.broadcast(limits), F.col(label) == F.col("_label"), "left")
        .withColumn("split", split)
        .drop("_hash", "_label", "_test_end", "_val_end")
    )


def heads(df: DataFrame) -> DataFrame:
    """One row for each sequence: the first piece of long ones; tables without pieces as they are."""
    return df.where(F.col("start") == 0) if "start" in df.columns else df


def split_counts(df: DataFrame) -> DataFrame:
    """Sequences and anomalies in each split."""
    return heads(df).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("anomalies"))


def normal_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == 0)


def normal_only_counts(df: DataFrame) -> DataFrame:
    """Sequences before and after the normal-only filter."""
    normal = F.count_if(F.col("label") == 0)
    total = F.count(F.lit(1))
    return heads(df).agg(total.alias("before"), normal.alias("after"), (total - normal).alias("removed"))


def alignment(left: DataFrame, right: DataFrame, key: str = "seq_id") -> DataFrame:
    """Sequences of two labelled tables that pair up, and those that differ in label or lack a partner."""
    a = heads(left).select(key, F.col("label").alias("_a"))
    b = heads(right).select(key, F.col("label").alias("_b"))
    same = F.col("_a") == F.col("_b")
    return a.join(b, key, "full").agg(
        F.count_if(F.coalesce(same, F.lit(False))).alias("aligned"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("mismatches"),
    )
