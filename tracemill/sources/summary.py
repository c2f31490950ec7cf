"""Summaries as ``key : value`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = "=" * 70


def summary_lines(summary: DataFrame, dataset: str) -> DataFrame:
    """A one-row summary as lines: title, rule, then ``key : value`` with four decimals for fractions."""
    lines = [F.lit(f"Preprocessing Summary - {dataset}"), F.lit(RULE), F.lit("")]
    for field in summary.schema.fields:
        value = F.col(f"`{field.name}`")
        is_fraction = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        shown = F.format_string("%.4f", value) if is_fraction else value.cast("string")
        lines.append(F.concat(F.lit(f"{field.name:25s}: "), F.coalesce(shown, F.lit("None"))))
    return summary.select(F.explode(F.array(*lines)).alias("value"))


def write_summary(summary: DataFrame, dataset: str, path: str) -> None:
    summary_lines(summary, dataset).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of every line with a colon, split at the first one and trimmed."""
    line = F.col("value")
    return (
        spark.read.text(path)
        .where(F.contains(line, F.lit(":")))
        .select(
            F.trim(F.regexp_extract(line, r"^([^:]*):(.*)$", 1)).alias("key"),
            F.trim(F.regexp_extract(line, r"^([^:]*):(.*)$", 2)).alias("value"),
        )
    )
