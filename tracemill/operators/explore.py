"""Exploratory statistics of sequences, events and scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import order
from tracemill.operators.features import events_of
from tracemill.operators.split import heads
from tracemill.session import materialise

SIGNIFICANCE = 0.001
# Beyond so many degrees of freedom Student's t is taken from the normal distribution.
NORMAL_FREEDOM = 1e6


def class_distribution(df: DataFrame) -> DataFrame:
    """Sequences and share in percent of each label."""
    df = heads(df)
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", (F.col("n") * 100.0 / total).alias("percent"))


def class_balance(df: DataFrame) -> DataFrame:
    """Totals, anomaly rate in percent and number of normal sequences per anomaly, in one row."""
    df = heads(df)
    normal, anomaly = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        normal.alias("normal"),
        anomaly.alias("anomaly"),
        F.try_divide(anomaly * 100.0, total).alias("anomaly_percent"),
        F.try_divide(normal.cast("double"), anomaly).alias("imbalance_ratio"),
    )


def contamination(df: DataFrame) -> DataFrame:
    """Share of anomalies among the sequences of the training split."""
    return heads(df).where(F.col("split") == "train").agg(F.avg("label").alias("contamination"))


def count_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Count, min, max, mean, median and population deviation of a whole-number column.

    The exact median keeps one counter per distinct value; lengths and event counts have few. Use
    ``quantiles`` for columns with many distinct values.
    """
    c = F.col(column)
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count(c).alias("n"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(c).alias("mean"),
        F.percentile(c, 0.5).alias("median"),
        F.stddev_pop(c).alias("std"),
    )


def length_stats(seqs: DataFrame, by: str | None = None) -> DataFrame:
    return count_stats(heads(seqs), "length", by)


def length_comparison(seqs: DataFrame) -> DataFrame:
    """Length statistics as one row per metric with a column for each class."""
    stats = length_stats(seqs, "label")
    metrics = ["n", "min", "max", "mean", "median", "std"]
    long = stats.select("label", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["label"], metrics, "metric", "value"
    )
    return (
        long.groupBy("metric")
        .pivot("label", [0, 1])
        .agg(F.first("value"))
        .withColumnsRenamed({"0": "normal", "1": "anomaly"})
    )


def diversity_stats(stats: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct events per sequence; input: sequence statistics."""
    return count_stats(stats, "unique_events", by)


def repetition(stats: DataFrame) -> DataFrame:
    """Both readings of repetition by class: top count over length, and length over distinct events."""
    ratio = F.try_divide(F.col("seq_length").cast("double"), F.col("unique_events"))
    return stats.groupBy("label").agg(
        F.avg("repetition_rate").alias("repetition_rate"), F.avg(ratio).alias("repetition_ratio")
    )


def event_counts(seqs: DataFrame, by_label: bool = True) -> DataFrame:
    """Occurrences of each event, by class or over all sequences."""
    keys = ["label", "event"] if by_label else ["event"]
    return events_of(seqs, "label").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def token_totals(seqs: DataFrame) -> DataFrame:
    """Tokens and distinct events of each class."""
    return event_counts(seqs).groupBy("label").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct_events")
    )


def event_totals(seqs: DataFrame) -> DataFrame:
    """Total of each event and its mean per sequence (sequences without it count as zero)."""
    sequences = heads(seqs).agg(F.count(F.lit(1))).scalar()
    return event_counts(seqs, by_label=False).select(
        "event", F.col("n").alias("total"), (F.col("n") / sequences).alias("mean_per_sequence")
    )


def event_means_by_class(seqs: DataFrame) -> DataFrame:
    """Mean count of each event per sequence of either class, and anomaly minus normal."""
    first = heads(seqs)
    n_normal = first.agg(F.count_if(F.col("label") == 0)).scalar()
    n_anomaly = first.agg(F.count_if(F.col("label") == 1)).scalar()
    sums = event_counts(seqs).groupBy("event").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("normal"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("anomaly"),
    )
    means = sums.select(
        "event",
        F.try_divide(F.col("normal").cast("double"), n_normal).alias("normal_mean"),
        F.try_divide(F.col("anomaly").cast("double"), n_anomaly).alias("anomaly_mean"),
    )
    return means.withColumn("difference", F.col("anomaly_mean") - F.col("normal_mean"))


def extreme_events(seqs: DataFrame) -> DataFrame:
    """The most and the least frequent event with their counts; ties go to the smaller name."""
    counts = event_counts(seqs, by_label=False)
    most = F.min_by("event", F.struct(-F.col("n"), "event"))
    least = F.min_by("event", F.struct("n", "event"))
    return counts.agg(
        most.alias("most_frequent"), F.max("n").alias("most_n"), least.alias("least_frequent"), F.min("n").alias("least_n")
    )


def event_share(seqs: DataFrame) -> DataFrame:
    """Share of each event in the tokens of its class, in percent, the classes side by side."""
    counts = event_counts(seqs)
    shares = counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("label")))
    return shares.groupBy("event").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("normal_n"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("anomaly_n"),
        F.coalesce(F.max(F.when(F.col("label") == 0, F.col("share"))), F.lit(0.0)).alias("normal_percent"),
        F.coalesce(F.max(F.when(F.col("label") == 1, F.col("share"))), F.lit(0.0)).alias("anomaly_percent"),
    )


def top_events(seqs: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent events of each class, with their rank and share in percent."""
    ranking = Window.partitionBy("label").orderBy(F.desc("n"), "event")
    counts = event_counts(seqs)
    ranked = counts.withColumn("share_percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("label")))
    return ranked.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= n)


def top_union(seqs: DataFrame, n: int = 15, order_by: str = "normal_percent") -> DataFrame:
    """Events among either class's top n, cut to n by normal share (descending) or by event name."""
    chosen = top_events(seqs, n).select("event").distinct()
    shares = event_share(seqs).join(chosen, "event", "left_semi")
    keys = [F.desc("normal_percent"), F.col("event")] if order_by == "normal_percent" else [F.col("event")]
    return shares.orderBy(*keys).limit(n)


def feature_quality(stats: DataFrame) -> DataFrame:
    """Mean and deviation of row totals and non-zero features by class, with the gaps between classes."""

    def of(label: int, column: str, name: str) -> list[Column]:
        value = F.when(F.col("label") == label, F.col(column))
        side = "normal" if label == 0 else "anomaly"
        return [F.avg(value).alias(f"{side}_{name}_mean"), F.stddev_pop(value).alias(f"{side}_{name}_std")]

    row = stats.agg(
        *of(0, "seq_length", "total"),
        *of(1, "seq_length", "total"),
        *of(0, "unique_events", "nonzero"),
        *of(1, "unique_events", "nonzero"),
    )
    return row.withColumn("total_gap", F.abs(F.col("anomaly_total_mean") - F.col("normal_total_mean"))).withColumn(
        "nonzero_gap", F.abs(F.col("anomaly_nonzero_mean") - F.col("normal_nonzero_mean"))
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def two_sided_p(t: float, freedom: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isinf(t):
        return 0.0
    if freedom > NORMAL_FREEDOM:
        # The normal limit with its first correction; the beta prefactor would lose digits here.
        return math.erfc(abs(t) * (1.0 - 1.0 / (4.0 * freedom)) / math.sqrt(2.0 * (1.0 + t * t / (2.0 * freedom))))
    x = freedom / (freedom + t * t)
    a, b = freedom / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else two_sided_p(x, f) for x, f in zip(t, freedom)], dtype="float64")


def t_test(df: DataFrame, column: str, by: str = "label") -> DataFrame:
    """Two-sample t-test with pooled variance between ``by`` = 0 and 1: one row."""
    side = [F.when(F.col(by) == label, F.col(column)) for label in (0, 1)]
    sums = df.agg(
        *[F.count(s).alias(f"n{i}") for i, s in enumerate(side)],
        *[F.avg(s).alias(f"m{i}") for i, s in enumerate(side)],
        *[F.var_samp(s).alias(f"v{i}") for i, s in enumerate(side)],
    )
    freedom = (F.col("n0") + F.col("n1") - 2).cast("double")
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / freedom
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (F.lit(1.0) / F.col("n0") + F.lit(1.0) / F.col("n1"))))
    # The p-value is one scalar on one aggregated row.
    row = sums.select(t.alias("t_statistic"), freedom.alias("degrees_of_freedom"))
    return row.withColumn("p_value", _p_value("t_statistic", "degrees_of_freedom")).withColumn(
        "significant", F.col("p_value") < SIGNIFICANCE
    )


def histogram(
    df: DataFrame, column: str, bins: int = 50, by: str | None = None, shared_range: bool = True
) -> DataFrame:
    """Equal-width bins over [min, max]: ``(by, bin, bin_low, bin_high, n, density)``, empty bins included.

    The range is that of the whole column, or with ``shared_range=False`` of each class. A bin includes
    its lower edge, the last one both.
    """
    x = F.col(column).cast("double")
    keys = [by] if by else []
    values = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull())
    spread = [F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")]
    limits = values.groupBy(*keys).agg(*spread)
    if by and shared_range:
        limits = limits.select(*keys, "total", F.min("lo").over(Window.partitionBy(F.lit(1))).alias("lo"),
                               F.max("hi").over(Window.partitionBy(F.lit(1))).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        *keys,
        "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    # One row per value of ``by``.
    placed = values.join(F.broadcast(limits), keys) if by else values.select(
        "x", *[limits.select(c).scalar().alias(c) for c in ("lo", "hi", "width")]
    )
    guess = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.col("width"))).cast("int")
    placed = placed.withColumn("bin", guess)
    # Rounding may put a value that lies on an edge into the bin beside it.
    low, high = F.col("lo") + F.col("bin") * F.col("width"), F.col("lo") + (F.col("bin") + 1) * F.col("width")
    exact = (
        F.when((F.col("x") < low) & (F.col("bin") > 0), F.col("bin") - 1)
        .when((F.col("x") >= high) & (F.col("bin") < bins - 1), F.col("bin") + 1)
        .otherwise(F.col("bin"))
    )
    counts = placed.withColumn("bin", exact).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
        n.alias("n"),
        (n / (F.col("total") * F.col("width"))).alias("density"),
    )


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns ``q0, q1, …``.

    Values are counted, then ranked by running totals over their distinct values, so a column with as
    many distinct values as rows is still spread over all tasks.
    """
    keys = [by] if by else []
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("x"))
    freq = materialise(values.agg(F.count(F.lit(1)).alias("n")))
    ranked = order.running_totals(freq, "x", ["n"], keys)
    totals = freq.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = ranked.join(F.broadcast(totals), keys) if by else ranked.withColumn("total", freq.agg(F.sum("n")).scalar())
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            inside = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("x"))).alias(f"{side}{i}"))
    chosen = joined.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    out = [
        (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at - F.floor(at))).alias(f"q{i}")
        for i, at in ((i, F.lit(float(p)) * (F.col("total") - 1)) for i, p in enumerate(probabilities))
    ]
    return chosen.select(*keys, *out)


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 IQR) and number of outliers by class."""
    quartiles = quantiles(df, column, [0.25, 0.5, 0.75], by).select(
        by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(column).cast("double")
    # One row per class.
    joined = df.where(F.col(column).isNotNull()).join(F.broadcast(quartiles), by)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
