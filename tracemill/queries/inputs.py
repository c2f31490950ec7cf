"""The driver's tables read as logs, in Spark and in SQL.

* ``events`` is a log with one line per event: block = user, event = event type, anomalous = a large value.
  It also yields raw lines in the style of a supercomputer log (alert tag, time stamps, node, message).
* ``lineitem`` is a log in the style of a block storage system: the order is the block; labels of blocks
  come from ``orders``.
* ``documents`` gives free-text lines, ``conversations`` short sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.session import spread

ANOMALOUS_VALUE = 300

# Content pattern and masks of the supercomputer log format.
ALERT_LOG_PATTERN = r"^\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+(.+)$"
ALERT_LOG_MASKS = [
    (r"\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+", "<TS>"),
    (r"\d{4}\.\d{2}\.\d{2}", "<DATE>"),
    (r"R\d+-M\d+-N\d+-C:J\d+-U\d+", "<NODE>"),
    (r"\b(A|B|C)\b", "<PLANE>"),
    (r"\b(X\+|X-|Y\+|Y-|Z\+|Z-)\b", "<AXIS>"),
    (r"\b\d+\b", "<NUM>"),
]
# Fixed value: content pattern of the block storage log format.
BLOCK_LOG_PATTERN = r"\d{6}\s+\d{6}\s+\d+\s+(INFO|WARN|ERROR|FATAL)\s+[\w\$\.]+:\s+(.+)"
BLOCK_LOG_MASKS = [(r"blk_-?\d+", "<BLK>"), (r"/?\d+\.\d+\.\d+\.\d+(:\d+)?", "<IP>"), (r"\b\d+\b", "<NUM>")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as parsed lines."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("line_id"),
        F.col("user_id").cast("string").alias("block_id"),
        F.col("event_type").alias("event_id"),
        F.when(F.col("value") > ANOMALOUS_VALUE, 1).otherwise(0).alias("label"),
        "ts",
        "user_id",
        "value",
    )


EVENT_LOG = f"""
event_log AS (
  SELECT event_id AS line_id, CAST(user_id AS VARCHAR) AS block_id, event_type AS event_id,
         CASE WHEN value > {ANOMALOUS_VALUE} THEN 1 ELSE 0 END AS label, ts, user_id, value
  FROM events)"""

SEQUENCES = f"""{EVENT_LOG},
seqs AS (
  SELECT block_id AS seq_id, list(event_id ORDER BY line_id) AS events, max(label) AS label, count(*) AS length
  FROM event_log GROUP BY block_id)"""

STATS = f"""{SEQUENCES},
event_n AS (
  SELECT block_id AS seq_id, event_id AS event, count(*) AS n FROM event_log GROUP BY 1, 2),
stats AS (
  SELECT s.seq_id, s.label, CAST(s.length AS INTEGER) AS seq_length, CAST(count(*) AS INTEGER) AS unique_events,
         sum(-(n / s.length) * log2(n / s.length + 1e-10)) AS entropy,
         max(n) AS max_event_freq, max(n) / s.length AS repetition_rate, count(*) / s.length AS diversity
  FROM seqs s JOIN event_n USING (seq_id) GROUP BY s.seq_id, s.label, s.length)"""


def alert_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as raw lines ``(line_id, raw)`` of the supercomputer format."""
    e = spread(table(spark, folder, "events"))
    k = F.regexp_extract("props", r"(\d+)", 1)
    user = F.col("user_id").cast("string")
    node = F.concat(
        F.lit("R"), F.lpad((F.col("user_id") % 64).cast("string"), 2, "0"), F.lit("-M"), (F.col("user_id") % 2).cast("string"),
        F.lit("-N"), (F.col("user_id") % 16).cast("string"), F.lit("-C:J"), (F.col("user_id") % 18).cast("string"),
        F.lit("-U"), (F.col("user_id") % 12).cast("string"),
    )
    stamp = F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    amount = F.floor("value").cast("string")
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("machine check at "), node, F.lit(" axis X+ code "), k, F.lit(" since "), stamp))
        .when(F.col("event_type") == "click", F.concat(F.lit("user "), user, F.lit(" selected plane B item "), k, F.lit(" of "), amount))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("user "), user, F.lit(" paid "), amount, F.lit(" units")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("r"), k, F.lit("=0x"), F.lpad(user, 8, "0")))
        .otherwise(F.concat(F.lit("cache parity report "), k, F.lit(" on "), F.date_format("ts", "yyyy.MM.dd")))
    )
    tag = F.when(F.col("value") > ANOMALOUS_VALUE, "ALERT").otherwise("-")
    raw = F.concat_ws(
        " ", tag, k, F.date_format("ts", "yyyy.MM.dd"), node, stamp, node, F.lit("RAS"), F.lit("KERNEL"), F.lit("INFO"), message
    )
    return e.select(F.col("event_id").alias("line_id"), raw.alias("raw"))


ALERT_LINES = f"""
alert_parts AS (
  SELECT event_id AS line_id, event_type, value, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(user_id AS VARCHAR) AS u,
         'R' || lpad(CAST(user_id % 64 AS VARCHAR), 2, '0') || '-M' || (user_id % 2) || '-N' || (user_id % 16)
           || '-C:J' || (user_id % 18) || '-U' || (user_id % 12) AS node,
         strftime(ts, '%Y-%m-%d-%H.%M.%S.%f') AS stamp, strftime(ts, '%Y.%m.%d') AS day,
         CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS amount
  FROM events),
alert_lines AS (
  SELECT line_id, CASE WHEN value > {ANOMALOUS_VALUE} THEN 'ALERT' ELSE '-' END || ' ' || k || ' ' || day || ' ' || node || ' '
      || stamp || ' ' || node || ' RAS KERNEL INFO ' ||
    CASE event_type
      WHEN 'error' THEN 'machine check at ' || node || ' axis X+ code ' || k || ' since ' || stamp
      WHEN 'click' THEN 'user ' || u || ' selected plane B item ' || k || ' of ' || amount
      WHEN 'purchase' THEN 'user ' || u || ' paid ' || amount || ' units'
      WHEN 'signup' THEN 'r' || k || '=0x' || lpad(u, 8, '0')
      ELSE 'cache parity report ' || k || ' on ' || day END AS raw
  FROM alert_parts),
alert_content AS (
  SELECT line_id, raw,
         CASE WHEN regexp_matches(raw, '{ALERT_LOG_PATTERN}') THEN regexp_extract(raw, '{ALERT_LOG_PATTERN}', 1) ELSE raw END AS content
  FROM alert_lines)"""


def _sql_masked(expression: str, masks) -> str:
    for pattern, mask in masks:
        expression = f"regexp_replace({expression}, '{pattern}', '{mask}', 'g')"
    return expression


ALERT_MASKED = f"""{ALERT_LINES},
alert_masked AS (
  SELECT line_id, raw, content, {_sql_masked("content", ALERT_LOG_MASKS)} AS masked FROM alert_content)"""


def block_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as raw lines ``(line_id, raw)`` of the block storage format; some mention no block.

    ``line_id`` orders the lines of a block by line number and is unique within it.
    """
    item = spread(table(spark, folder, "lineitem"))
    block = F.concat(F.lit("blk_"), F.col("l_orderkey").cast("string"))
    ip = F.concat(F.lit("/10.250."), (F.col("l_suppkey") % 250).cast("string"), F.lit("."), (F.col("l_partkey") % 250).cast("string"))
    message = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Receiving block "), block, F.lit(" src: "), ip, F.lit(":54106 dest: "), ip, F.lit(":50010")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("Received block "), block, F.lit(" of size "), F.floor("l_extendedprice").cast("string"), F.lit(" from "), ip))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("PacketResponder "), F.col("l_linenumber").cast("string"), F.lit(" for block "), block, F.lit(" terminating")))
        .otherwise(F.concat(F.lit("Verification pending on "), ip))
    )
    raw = F.concat(
        F.date_format("l_shipdate", "yyMMdd"), F.lit(" 203518 "), F.col("l_suppkey").cast("string"), F.lit(" INFO dfs.DataNode$DataXceiver: "), message
    )
    line = F.col("l_linenumber").cast("bigint") * F.lit(1 << 58) + F.col("l_partkey") * F.lit(1 << 20) + F.col("l_suppkey")
    return item.select(line.alias("line_id"), raw.alias("raw"))


BLOCK_LINES = f"""
block_lines AS (
  SELECT CAST(l_linenumber AS BIGINT) * {1 << 58} + l_partkey * {1 << 20} + l_suppkey AS line_id,
    strftime(l_shipdate, '%y%m%d') || ' 203518 ' || l_suppkey || ' INFO dfs.DataNode$DataXceiver: ' ||
    CASE WHEN l_returnflag = 'A' THEN 'Receiving block blk_' || l_orderkey || ' src: /10.250.' || (l_suppkey % 250) || '.' || (l_partkey % 250)
           || ':54106 dest: /10.250.' || (l_suppkey % 250) || '.' || (l_partkey % 250) || ':50010'
         WHEN l_returnflag = 'R' THEN 'Received block blk_' || l_orderkey || ' of size ' || CAST(floor(l_extendedprice) AS BIGINT)
           || ' from /10.250.' || (l_suppkey % 250) || '.' || (l_partkey % 250)
         WHEN l_linestatus = 'F' THEN 'PacketResponder ' || l_linenumber || ' for block blk_' || l_orderkey || ' terminating'
         ELSE 'Verification pending on /10.250.' || (l_suppkey % 250) || '.' || (l_partkey % 250) END AS raw
  FROM lineitem),
block_content AS (
  SELECT line_id, raw, CASE WHEN regexp_matches(raw, '^{BLOCK_LOG_PATTERN}') THEN regexp_extract(raw, '^{BLOCK_LOG_PATTERN}', 2) ELSE raw END AS content
  FROM block_lines),
block_masked AS (
  SELECT *, nullif(regexp_extract(content, '(blk_-?[0-9]+)', 1), '') AS block_id, {_sql_masked("content", BLOCK_LOG_MASKS)} AS masked
  FROM block_content)"""


def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as a label table ``(block_id, label)``; a block has at most one entry."""
    o = table(spark, folder, "orders")
    label = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "Anomaly").otherwise("Normal")
    return o.select(F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("block_id"), label.alias("label"))


BLOCK_LABELS = """
block_labels AS (
  SELECT 'blk_' || o_orderkey AS block_id,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label
  FROM orders)"""

# The masked message shapes of the block log stand for its events.
BLOCK_SEQUENCES = f"""{BLOCK_LINES}, {BLOCK_LABELS},
block_seqs AS (
  SELECT m.block_id AS seq_id, list(m.masked ORDER BY m.line_id) AS events, coalesce(max(l.label), 0) AS label, count(*) AS length
  FROM block_masked m LEFT JOIN block_labels l USING (block_id) WHERE m.block_id IS NOT NULL GROUP BY m.block_id)"""


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as trimmed non-blank text lines ``(line_id, raw)``."""
    d = spread(table(spark, folder, "documents"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "value"))
    line = F.col("doc_id") * F.lit(1 << 20) + F.col("at")
    return lines.select(line.alias("line_id"), text.trimmed(F.col("value")).alias("raw")).where(F.length("raw") > 0)


DOCUMENT_LINES = f"""
document_parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
document_lines AS (
  SELECT doc_id * {1 << 20} + n AS line_id, regexp_replace(value, '^[\\s\\x1c-\\x1f\\x0b\\x{{85}}\\pZ]+|[\\s\\x1c-\\x1f\\x0b\\x{{85}}\\pZ]+$', '', 'g') AS raw
  FROM document_parts),
kept_lines AS (SELECT * FROM document_lines WHERE length(raw) > 0)"""
