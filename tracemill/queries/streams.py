"""Streaming forms over the driver's tables: written to files, streamed to the end of their input, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.templates import MATCH_SQL, catalogue
from tracemill.session import scratch_folder
from tracemill.streaming import lines

REGISTRY = Registry()
add = REGISTRY.add

GAP_SECONDS = 600
FILES = 4


def event_files(spark: SparkSession, folder: str, path: str) -> str:
    """``events`` as files in the order of time, and a last event, without a user, that moves the watermark past all others.

    Files are appended one after the other, so that a stream reads them in this order.
    """
    log = i.event_log(spark, folder).select("line_id", "user_id", "event_id", "label", F.col("ts").cast("timestamp").alias("ts"))
    seconds = F.unix_seconds("ts")
    span = log.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
    if span.low is not None:
        part = F.least(F.lit(FILES - 1), F.floor((seconds - span.low) * FILES / F.lit(span.high - span.low + 1)))
        for k in range(FILES):
            log.where(part == k).write.mode("append").parquet(path)
        end = F.timestamp_seconds(F.lit(span.high + 100 * GAP_SECONDS))
        last = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name != "ts"], end.alias("ts"))
        last.write.mode("append").parquet(path)
    return path


@add(
    "stream_gap_sessions",
    f"""WITH {i.EVENT_LOG},
    gaps AS (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {GAP_SECONDS} * 1000000 THEN 1 ELSE 0 END AS opens
      FROM event_log WINDOW w AS (PARTITION BY user_id ORDER BY ts, line_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, line_id) AS s FROM gaps)
    SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS length, max(label) AS label, string_agg(event_id, ' ' ORDER BY ts, line_id) AS events
    FROM numbered GROUP BY user_id, s""",
)
def stream_gap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Gap sessions per user with their events, from a stream of several batches."""
    path = event_files(spark, folder, scratch_folder(spark, "events"))
    schema = "line_id long, user_id long, event_id string, label int, ts timestamp"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    sessions = lines.gap_sessions(events, "ts", "user_id", GAP_SECONDS, GAP_SECONDS, event="event_id", order="line_id")
    ended = lines.run_to_end(sessions, scratch_folder(spark, "sessions"), scratch_folder(spark, "stream"))
    naive = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")]
    return ended.rows.where("user_id IS NOT NULL").select("user_id", *naive, "length", "label", F.array_join("events", " ").alias("events"))


@add(
    "stream_match",
    f"""WITH {MATCH_SQL}
    SELECT raw, CASE WHEN raw LIKE '- %' THEN 0 ELSE 1 END AS label, matched.masked, event_id, event_template FROM matched JOIN alert_masked USING (line_id)""",
)
def stream_match(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines parsed, masked and matched as they arrive in text files."""
    path = scratch_folder(spark, "lines")
    i.alert_lines(spark, folder).select("raw").write.text(path)
    arrived = lines.parse_stream(spark, path, catalogue(spark), i.ALERT_LOG_PATTERN, i.ALERT_LOG_MASKS, text.alert_tag_label, {"maxFilesPerTrigger": "4"})
    ended = lines.run_to_end(arrived, scratch_folder(spark, "matched"), scratch_folder(spark, "stream"))
    return ended.rows.select("raw", "label", "masked", "event_id", "event_template")
