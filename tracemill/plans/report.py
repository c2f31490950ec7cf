"""Dataset report: the main exploratory numbers in one (section, metric, value) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import explore, features


def _rows(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """A table of numbers as (section, metric, value); rows of a keyed table are named by their key."""
    values = [c for c in df.columns if c != key]
    doubles = df.select(*([key] if key else []), *[F.col(c).cast("double").alias(c) for c in values])
    long = doubles.unpivot([key] if key else [], values, "metric", "value")
    name = F.concat_ws(".", F.col("metric"), F.col(key).cast("string")) if key else F.col("metric")
    return long.select(F.lit(section).alias("section"), name.alias("metric"), "value")


def dataset_report(seqs: DataFrame) -> DataFrame:
    """Labels, lengths, diversity, repetition and events of a dataset. Give it stored sequences: each
    section reads them once."""
    stats = features.statistics(seqs)
    sections = [
        _rows(explore.class_balance(explore.heads(seqs)), "labels"),
        _rows(explore.length_stats(seqs), "length"),
        _rows(explore.length_stats(seqs, "label"), "length", "label"),
        _rows(explore.diversity_stats(stats), "diversity"),
        _rows(explore.diversity_stats(stats, "label"), "diversity", "label"),
        _rows(explore.repetition(stats), "repetition", "label"),
        _rows(explore.token_totals(seqs), "tokens", "label"),
        _rows(explore.extreme_events(seqs).select("most_n", "least_n"), "events"),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out
