"""Tables that go in and out: catalogues, labels, vocabularies, sequences, results."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import text
from tracemill.operators import features

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Template CSV with ``EventId, EventTemplate[, OccurrenceCount]``, or a stored template table."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    rows = spark.read.options(**_CSV).csv(path)
    out = rows.select(F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("event_template"))
    if "OccurrenceCount" in rows.columns:
        counts = rows.select("*", F.col("OccurrenceCount").cast("bigint").alias("occurrence_count"))
        out = counts.select(
            F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("event_template"), "occurrence_count"
        )
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV ``BlockId, Label`` as ``(block_id, label 0/1)``."""
    rows = spark.read.options(header=True).schema("BlockId STRING, Label STRING").csv(path)
    return rows.select(F.col("BlockId").alias("block_id"), text.label_value(F.col("Label")).alias("label"))


def read_first_rows(spark: SparkSession, path: str, n: int, schema: str | None = None) -> DataFrame:
    """The first ``n`` rows of a CSV file, for a look at it."""
    reader = spark.read.options(header=True)
    return (reader.schema(schema) if schema else reader).csv(path).limit(n)


def read_occurrence_matrix(
    spark: SparkSession, path: str, events: Sequence[str], key: str = "BlockId", label: str | None = "Label"
) -> DataFrame:
    """Wide occurrence CSV as ``(seq_id, <events>, label)``; other columns are never parsed into the plan."""
    rows = spark.read.options(header=True).csv(path)
    flag = text.label_value(F.col(label)) if label and label in rows.columns else F.lit(0)
    return rows.select(
        F.col(key).alias("seq_id"), *[F.col(f"`{e}`").cast("int").alias(e) for e in events], flag.alias("label")
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary table, a JSON object ``{event: index}``, or a CSV with ``EventId, Index``.

    Vocabularies from files that use index 0 for an event are shifted so that 0 stays padding.
    """
    if path.endswith(".json"):
        entries = spark.read.text(path, wholetext=True).select(
            F.explode(F.from_json("value", "map<string,int>")).alias("event", "idx")
        )
    elif path.endswith(".csv"):
        entries = spark.read.options(**_CSV).csv(path).select(F.col("EventId").alias("event"), F.col("Index").cast("int").alias("idx"))
    else:
        return spark.read.parquet(path)
    clash = entries.where((F.col("idx") == 0) & (F.col("event") != text.PADDING)).limit(1).count() > 0
    return features.shifted(entries) if clash else entries


def read_reverse_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{index: event}`` as ``(idx, event)``."""
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("_i", "event")
    ).select(F.col("_i").cast("int").alias("idx"), "event")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet and return the stored table, so that later steps do not recompute it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Stored sequences, or a simpler table of ``(seq_id, events[, label])`` brought to the common layout."""
    rows = spark.read.parquet(path)
    return rows if "piece" in rows.columns else as_sequences(rows)


def as_sequences(rows: DataFrame, strategy: str = "loaded") -> DataFrame:
    """Sequences from a table with ``seq_id``, ``events`` and maybe ``label``, one row each."""
    label = text.label_value(F.col("label")) if "label" in rows.columns else F.lit(0)
    zero = F.lit(0).cast("bigint")
    return rows.select(
        F.col("seq_id").cast("string").alias("seq_id"),
        zero.alias("piece"),
        zero.alias("start"),
        "events",
        label.alias("label"),
        F.size("events").cast("bigint").alias("length"),
        F.lit(strategy).alias("strategy"),
        F.lit(None).cast("string").alias("block_id"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("session_id", "window_start", "window_end")],
        F.lit(None).cast("double").alias("time_span_seconds"),
    ).to(spark_schema(rows.sparkSession))


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], schemas.SEQUENCES).schema


# What a listed file holds, by words of its name, and its reader.
_LISTED = (
    ("templates", ("template",), (".csv",), read_catalogue),
    ("labels", ("label",), (".csv",), read_labels),
    ("vocabulary", ("vocab",), (".json", ".csv"), read_vocabulary),
)


def read_listed(spark: SparkSession, folder: str, files: Sequence[str]) -> dict[str, DataFrame]:
    """The tables among ``files`` of a prepared data set, each in its own format; of two for one table the first counts.

    Array archives and pickles are no table formats and are named in a warning.
    """
    out: dict[str, DataFrame] = {}
    for name in files:
        base = name.rsplit("/", 1)[-1].lower()
        kind = next((k for k in _LISTED if base.endswith(k[2]) and any(w in base for w in k[1])), None)
        if kind is None:
            warnings.warn(f"{name} is not read: no table format for it", stacklevel=2)
        elif kind[0] not in out:
            out[kind[0]] = kind[3](spark, f"{folder}/{name}")
    return out


def load_preprocessed(spark: SparkSession, folder: str, files: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Sequences, vocabulary and, if stored, padded ids and templates of an earlier run; listed files replace stored tables."""
    out = {"sequences": read_sequences(spark, f"{folder}/sequences")}
    out |= read_listed(spark, folder, files)
    for name in ("vocabulary", "padded", "templates", "statistics", "occurrence", "metadata"):
        if name in out:
            continue
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as missing:  # noqa: BLE001 - only an absent folder is acceptable
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return out


def write_occurrence(wide: DataFrame, path: str) -> None:
    """Wide occurrence matrix with its label column as CSV."""
    wide.write.mode("overwrite").options(header=True).csv(path)


def write_occurrence_blocks(rows: DataFrame, blocks: DataFrame, vocab: DataFrame, path: str, columns: int) -> list[str]:
    """The labelled wide matrix as CSV files of ``columns`` events each, in ``path``/00000 and so on; returns their folders.

    ``rows`` has (seq_id, label) of all sequences and ``blocks`` the counts by block of ``columns`` entries of ``vocab``. Every file has all
    rows, by ``read_occurrence_matrix`` or any CSV reader; a block's column names pass through the driver, no counts do.
    """
    size = vocab.agg(F.max("idx") + 1).first()[0] or 0
    written = []
    for k in range(-(-size // columns)):
        names = [r["event"] for r in vocab.where((F.col("idx") >= k * columns) & (F.col("idx") < (k + 1) * columns)).orderBy("idx").collect()]
        joined = rows.select("seq_id", "label").join(blocks.where(F.col("block") == k).select("seq_id", "counts"), "seq_id", "left")
        counts = [F.coalesce(F.get("counts", F.lit(c)), F.lit(0)).alias(e) for c, e in enumerate(names)]
        written.append(f"{path}/{k:05d}")
        write_occurrence(joined.select("seq_id", *counts, "label"), written[-1])
    return written


def write_result(result: DataFrame, path: str) -> None:
    """One-row experiment results as JSON."""
    result.write.mode("overwrite").json(path)
