"""Lines: trimming, numbering, content, masks, block ids, labels, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text, timestamps
from tracemill.operators import order
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.sources import logs

REGISTRY = Registry()
add = REGISTRY.add


@add("trimmed_lines", f"WITH {i.DOCUMENT_LINES} SELECT line_id, raw FROM kept_lines")
def trimmed_lines(spark, folder):
    return i.document_lines(spark, folder)


@add(
    "dense_line_index",
    f"WITH {i.DOCUMENT_LINES} SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS row_idx FROM kept_lines",
)
def dense_line_index(spark, folder):
    return order.dense_index(i.document_lines(spark, folder).select("line_id"), "line_id")


@add("first_lines", f"WITH {i.DOCUMENT_LINES} SELECT line_id, raw FROM kept_lines ORDER BY line_id LIMIT 1000")
def first_lines(spark, folder):
    return i.document_lines(spark, folder).orderBy("line_id").limit(1000)


@add("content_extract", f"WITH {i.ALERT_LINES} SELECT line_id, content FROM alert_content")
def content_extract(spark, folder):
    return logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN).select("line_id", "content")


@add("block_content_extract", f"WITH {i.BLOCK_LINES} SELECT raw, content FROM block_content")
def block_content_extract(spark, folder):
    return logs.parse(i.block_lines(spark, folder), i.BLOCK_LOG_PATTERN).select("raw", "content")


@add("masking", f"WITH {i.ALERT_MASKED} SELECT line_id, masked FROM alert_masked")
def masking(spark, folder):
    return logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN, i.ALERT_LOG_MASKS).select("line_id", "masked")


@add(
    "document_masking",
    f"""WITH {i.DOCUMENT_LINES} SELECT line_id, regexp_replace(regexp_replace(regexp_replace(raw,
        '[a-zA-Z0-9.]+@[a-zA-Z0-9.]+', '<MAIL>', 'g'), '[0-9]+', '<NUM>', 'g'), '[(].*[)]', '<PAREN>', 'g') AS masked FROM kept_lines""",
)
def document_masking(spark, folder):
    masks = [("[a-zA-Z0-9.]+@[a-zA-Z0-9.]+", "<MAIL>"), ("[0-9]+", "<NUM>"), ("[(].*[)]", "<PAREN>")]
    return logs.parse(i.document_lines(spark, folder), None, masks).select("line_id", "masked")


@add("block_id_extract", f"WITH {i.BLOCK_LINES} SELECT raw, block_id FROM block_masked WHERE block_id IS NOT NULL")
def block_id_extract(spark, folder):
    parsed = logs.parse(i.block_lines(spark, folder), i.BLOCK_LOG_PATTERN)
    return logs.with_block_id(parsed).where("block_id IS NOT NULL").select("raw", "block_id")


@add(
    "block_id_coverage",
    f"WITH {i.BLOCK_LINES} SELECT count(block_id) AS with_block_id, count(*) AS lines FROM block_masked",
)
def block_id_coverage(spark, folder):
    return logs.block_id_coverage(logs.with_block_id(logs.parse(i.block_lines(spark, folder), i.BLOCK_LOG_PATTERN)))


@add(
    "page_path_extract",
    "SELECT page_id, nullif(regexp_extract(url, '(/[a-z][a-z]/[0-9]+)', 1), '') AS path FROM pages",
)
def page_path_extract(spark, folder):
    return i.table(spark, folder, "pages").select("page_id", text.block_id(F.col("url"), r"(/[a-z][a-z]/\d+)").alias("path"))


@add(
    "line_labels",
    f"WITH {i.ALERT_LINES} SELECT line_id, CASE WHEN raw LIKE '- %' THEN 0 ELSE 1 END AS label FROM alert_lines",
)
def line_labels(spark, folder):
    parsed = logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN, label=text.alert_tag_label)
    return parsed.select("line_id", "label")


@add(
    "label_by_block",
    f"""WITH {i.BLOCK_LINES}, {i.BLOCK_LABELS}
    SELECT m.raw, coalesce(l.label, 0) AS label FROM block_masked m LEFT JOIN block_labels l USING (block_id)""",
)
def label_by_block(spark, folder):
    parsed = logs.with_block_id(logs.parse(i.block_lines(spark, folder), i.BLOCK_LOG_PATTERN))
    return logs.label_by_block(parsed, i.block_labels(spark, folder)).select("raw", "label")


@add(
    "lenient_times",
    """SELECT event_id AS line_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros
    FROM events""",
)
def lenient_times(spark, folder):
    told = i.table(spark, folder, "events").select(
        F.col("event_id").alias("line_id"),
        F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("told"),
    )
    return told.select("line_id", timestamps.micros(told, "told").alias("micros"))


@add(
    "label_join",
    """SELECT d.doc_id, d.lang, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def label_join(spark, folder):
    labels = i.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return i.table(spark, folder, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
