"""Line operators on streams: parsing and catalogue matching, and gap sessions per key; runs that end with their input."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import matching
from tracemill.sources import logs


def parse_stream(
    spark: SparkSession,
    path: str,
    catalogue: DataFrame,
    content_regex: str | None = None,
    masks=(),
    label=text.alert_tag_label,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parse and match lines of new files as they arrive. Stateless: one CASE expression per line."""
    lines = spark.readStream.options(**(options or {})).text(path)
    kept = lines.select(text.trimmed(F.col("value")).alias("raw")).where(F.length("raw") > 0)
    return matching.match_messages(logs.parse(kept, content_regex, masks, label), catalogue)


def gap_sessions(
    events: DataFrame, time_column: str, key: str, gap_seconds: int, delay_seconds: int, label: str = "label", event: str | None = None, order: str | None = None
) -> DataFrame:
    """Time-gap sessions of a stream, per key: a session is emitted once the watermark has passed its end.

    Without ``event``, state holds one counter row per open session. With it, the session's ``events`` are collected in the order
    of time and then of ``order``, and state holds those of the sessions that are still open.
    """
    timed = events.withColumn("_ts", F.col(time_column).cast("timestamp")).withWatermark("_ts", f"{delay_seconds} seconds")
    # The built-in session window ends at the last event plus the gap, and an event at that very moment still joins.
    session = F.session_window("_ts", f"{gap_seconds} seconds")
    held = [F.collect_list(F.struct("_ts", *([order] if order else []), F.col(event).alias("_event"))).alias("events")] if event else []
    sessions = timed.groupBy(F.col(key), session).agg(
        F.count(F.lit(1)).alias("length"), F.max(label).alias("label"), F.min("_ts").alias("first"), F.max("_ts").alias("last"), *held
    )
    listed = [F.transform(F.sort_array("events"), lambda e: e["_event"]).alias("events")] if event else []
    return sessions.select(key, "first", "last", "length", "label", *listed)


@dataclass
class Ended:
    """What a stream has written up to the end of its input, in all runs, and how this run went."""

    rows: DataFrame
    batches: int
    read: int
    late: int  # rows behind the watermark, which no session has


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> Ended:
    """Process all that the stream's source holds now, append it to the Parquet table in ``folder``, and stop.

    ``checkpoint`` is a folder that all executors reach. A run with the same folders goes on where the last one ended or
    broke off: state and source positions come from the checkpoint, and the table lists what complete batches wrote.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = query.recentProgress
    late = sum(o["numRowsDroppedByWatermark"] for p in done for o in p["stateOperators"])
    spark = stream.sparkSession
    return Ended(spark.read.schema(stream.schema).parquet(folder), len(done), sum(p["numInputRows"] for p in done), late)
