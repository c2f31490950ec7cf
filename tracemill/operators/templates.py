"""Template tables: counts, filters, coverage, mapping of rare events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import order
from tracemill.session import broadcast_if_small

BROADCAST_TEMPLATES = 1_000_000


def counts(parsed: DataFrame) -> DataFrame:
    """Occurrences of each template."""
    return parsed.groupBy("event_id", "event_template").agg(F.count(F.lit(1)).alias("occurrence_count"))


def counts_of_messages(mined: DataFrame) -> DataFrame:
    """Occurrences of each template from mined messages and their numbers, without a pass over lines."""
    return mined.groupBy("event_id", "event_template").agg(F.sum("n").alias("occurrence_count"))


def by_frequency(templates: DataFrame) -> DataFrame:
    return templates.orderBy(F.desc("occurrence_count"), "event_id")


def with_kept(templates: DataFrame, min_occurrence: int = 1, remove_noise: bool = True) -> DataFrame:
    """Add ``kept``: frequent enough and, if asked for, not noise."""
    kept = F.col("occurrence_count") >= min_occurrence
    if remove_noise:
        kept = kept & ~text.is_noise(F.col("event_template"))
    return templates.withColumn("kept", kept)


def filter_templates(templates: DataFrame, min_occurrence: int = 1, remove_noise: bool = True) -> DataFrame:
    return with_kept(templates, min_occurrence, remove_noise).where("kept").drop("kept")


def coverage(templates: DataFrame, min_occurrence: int = 1, remove_noise: bool = True) -> DataFrame:
    """Kept and removed templates and lines, and the share of lines kept in percent."""
    n = F.col("occurrence_count")
    frequent = n >= min_occurrence
    flagged = with_kept(templates, min_occurrence, remove_noise)
    noise = frequent & ~F.col("kept")
    return flagged.agg(
        F.count_if("kept").alias("kept_templates"),
        F.coalesce(F.sum(F.when(F.col("kept"), n)), F.lit(0)).alias("kept_lines"),
        F.count_if(~frequent).alias("rare_templates"),
        F.coalesce(F.sum(F.when(~frequent, n)), F.lit(0)).alias("rare_lines"),
        F.count_if(noise).alias("noise_templates"),
        F.coalesce(F.sum(F.when(noise, n)), F.lit(0)).alias("noise_lines"),
        (F.coalesce(F.sum(F.when(F.col("kept"), n)), F.lit(0)) * 100.0 / F.sum(n)).alias("coverage_percent"),
    )


def to_unk(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """Map events outside ``kept`` (and their templates) to ``<UNK>``.

    The template table is broadcast after a check of its size; event ids are few next to lines.
    """
    valid = broadcast_if_small(kept.select(F.col("event_id").alias("_valid")).distinct(), BROADCAST_TEMPLATES)
    hit = F.col("_valid").isNotNull()
    return (
        parsed.join(valid, F.col("event_id") == F.col("_valid"), "left")
        .withColumn("event_template", F.when(hit, F.col("event_template")).otherwise(F.lit(text.UNKNOWN)))
        .withColumn("event_id", F.when(hit, F.col("event_id")).otherwise(F.lit(text.UNKNOWN)))
        .drop("_valid")
    )


def unk_share(parsed: DataFrame) -> DataFrame:
    """Lines mapped to ``<UNK>`` and their share in percent."""
    unknown = F.count_if(F.col("event_id") == text.UNKNOWN)
    total = F.count(F.lit(1))
    return parsed.agg(
        unknown.alias("unknown_lines"), total.alias("lines"), (unknown * 100.0 / total).alias("unknown_percent")
    )


def with_event_ids(templates: DataFrame, first: str = "first_line", name: str = "event_id") -> DataFrame:
    """Number templates ``E1, E2, …`` in the order of their first line."""
    ranked = order.rank_of(templates, first, "_rank")
    return ranked.withColumn(name, F.concat(F.lit("E"), F.col("_rank").cast("string"))).drop("_rank")


def match_statistics(matched: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lines per catalogue template, templates without a line included."""
    lines = matched.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return catalogue.join(lines, "event_id", "left").select(
        "event_id", "event_template", F.coalesce("n", F.lit(0)).alias("occurrence_count")
    )


def template_text(events: DataFrame, catalogue: DataFrame, event: str = "event_id") -> DataFrame:
    """Add the template text of an event, ``Unknown`` where the catalogue has none."""
    lookup = broadcast_if_small(
        catalogue.select(F.col("event_id").alias("_event"), F.col("event_template").alias("_text")), BROADCAST_TEMPLATES
    )
    return (
        events.join(lookup, F.col(event) == F.col("_event"), "left")
        .withColumn("event_template", F.coalesce("_text", F.lit("Unknown")))
        .drop("_event", "_text")
    )


def vocabulary_text(vocabulary: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Vocabulary with template text: ``(event_id, idx, event_template)``."""
    return vocabulary.join(
        broadcast_if_small(catalogue.select("event_id", "event_template"), BROADCAST_TEMPLATES),
        F.col("event") == F.col("event_id"),
    ).select("event_id", "idx", "event_template")


def top_and_bottom(templates: DataFrame, n: int = 20) -> DataFrame:
    """The n most and the n least frequent templates with their share of all lines in percent."""
    total = templates.agg(F.sum("occurrence_count")).scalar()
    shares = templates.withColumn("share_percent", F.col("occurrence_count") * 100.0 / total).withColumn(
        "template_short", text.shortened(F.col("event_template"))
    )
    top = shares.orderBy(F.desc("occurrence_count"), "event_id").limit(n).withColumn("side", F.lit("top"))
    bottom = shares.orderBy("occurrence_count", F.desc("event_id")).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "event_id", "template_short", "occurrence_count", "share_percent")
