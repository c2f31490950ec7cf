import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text, timestamps
from tracemill.queries.inputs import ALERT_LOG_MASKS, ALERT_LOG_PATTERN
from tracemill.sources import logs


def numbered(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_id BIGINT, raw STRING")


def texts(df, column):
    return [r[column] for r in df.orderBy("line_id").collect()]


def test_blank_lines_are_numbered_but_not_kept(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  \t \ntwo  \n\u00a0three\n")
    rows = logs.read_logs(spark, str(tmp_path / "a.log")).orderBy("line_id").collect()
    assert [(r.line_id, r.row_idx, r.raw) for r in rows] == [(1, 0, "one"), (4, 1, "two"), (5, 2, "three")]


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\tab\xffcd\t\n\xff \n")
    assert texts(logs.read_logs(spark, str(tmp_path / "a.log")), "raw") == ["abcd"]


@pytest.mark.parametrize("split_bytes", ["64", "1000", "134217728"])
def test_line_numbers_follow_files_whatever_the_splits(spark, tmp_path, split_bytes):
    expected, number, row = [], 0, 0
    for name, count in (("a.log", 37), ("b.log", 1), ("c.log", 90)):
        lines = []
        for k in range(count):
            blank = k % 5 == 3
            lines.append("" if blank else f"{name} line {k} " + "x" * (k % 11))
            number += 1
            if not blank:
                expected.append((number, row, lines[-1].strip()))
                row += 1
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], split_bytes)
        spark.conf.set(keys[1], "1")
        got = logs.read_logs(spark, str(tmp_path)).orderBy("line_id").collect()
        sample = logs.read_logs(spark, str(tmp_path), sample_size=40).orderBy("line_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.line_id, r.row_idx, r.raw) for r in got] == expected
    assert [r.line_id for r in sample] == [e[0] for e in expected[:40]]


def test_content_is_the_last_group_or_the_whole_line(spark):
    raw = numbered(spark, "k1 msg: hello there", "no header", "k2 msg: ", "x k1 msg: late")
    got = texts(logs.parse(raw, r"k\d msg: (h\w+) (.*)|k2 msg:( )"), "content")
    # The last group of the pattern counts, and the pattern has to match at the start.
    assert got == ["", "no header", " ", "x k1 msg: late"]
    assert texts(logs.parse(raw, r"k\d msg: (.*)"), "content") == ["hello there", "no header", "", "x k1 msg: late"]
    assert texts(logs.parse(raw, r"k\d msg: .*"), "content") == texts(raw, "raw")


def test_masks_agree_with_python(spark):
    lines = [
        "at 2005-06-03-15.42.50.363779 on 2005.06.03 R02-M1-N0-C:J12-U11 plane A axis X+ and Y- 17 x17",
        "torus X+ receiver 1.5 A1 (B)",
        "٣ arabic and 12é",
    ]
    expected = []
    for line in lines:
        for pattern, mask in ALERT_LOG_MASKS:
            line = re.sub(pattern, mask, line)
        expected.append(line)
    assert texts(logs.parse(numbered(spark, *lines), None, ALERT_LOG_MASKS), "masked") == expected
    assert "X+ and" in expected[0]  # no word boundary between the plus sign and a space


def test_masks_take_groups_and_literal_signs(spark):
    raw = numbered(spark, "cost 5 at C:\\tmp")
    rules = [{"pattern": r"cost (\d)", "mask": r"\1 $"}, {"pattern": r"C:\\tmp", "mask": "<P$1>"}]
    assert texts(logs.parse(raw, None, rules), "masked") == ["5 $ at <P$1>"]


def test_bad_patterns_fail_at_once(spark):
    with pytest.raises(re.error):
        logs.parse(numbered(spark, "a"), None, [("(", "x")])


def test_labels(spark):
    raw = numbered(spark, "- fine", "-", "APPREAD bad", "-x odd")
    assert texts(logs.parse(raw, label=text.alert_tag_label), "label") == [0, 0, 1, 1]
    assert texts(logs.parse(raw), "label") == [0, 0, 0, 0]
    custom = logs.parse(raw, label=lambda line: F.when(F.contains(line, F.lit("odd")), 1))
    assert texts(custom, "label") == [0, 0, 0, 1]
    named = spark.createDataFrame([(1, "a", "Anomaly"), (2, "b", "Normal"), (3, "c", "1")], "line_id BIGINT, raw STRING, label STRING")
    assert texts(logs.parse(named), "label") == [1, 0, 1]


def test_block_ids(spark):
    parsed = logs.parse(numbered(spark, "got blk_-12 and blk_3", "none", "blk_7"))
    assert texts(logs.with_block_id(parsed), "block_id") == ["blk_-12", None, "blk_7"]
    row = logs.block_id_coverage(logs.with_block_id(parsed)).first()
    assert (row.with_block_id, row.lines) == (2, 3)


def test_labels_by_block(spark):
    parsed = logs.with_block_id(logs.parse(numbered(spark, "blk_1", "blk_2", "none")))
    labels = spark.createDataFrame([("blk_1", "Anomaly"), ("blk_2", "Normal")], "block_id STRING, label STRING")
    assert texts(logs.label_by_block(parsed, labels), "label") == [1, 0, 0]


def test_times_are_read_leniently(spark):
    df = spark.createDataFrame([("1970-01-01 00:00:01",), ("nonsense",), (None,)], "t STRING")
    assert [r[0] for r in df.select(timestamps.micros(df, "t")).collect()] == [1_000_000, None, None]


def test_headers_of_the_supercomputer_log(spark):
    line = "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL INFO instruction cache parity error"
    assert texts(logs.parse(numbered(spark, line), ALERT_LOG_PATTERN), "content") == ["instruction cache parity error"]


def test_lines_without_a_block_do_not_share_a_task(spark):
    lines = spark.range(4000).select(F.col("id").alias("line_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("b"), F.col("id") % 100)).alias("block_id"))
    labels = spark.createDataFrame([(f"b{k}", "Anomaly" if k == 8 else "Normal") for k in range(0, 100, 4)] + [(None, "Anomaly")], "block_id string, label string")
    labelled = logs.label_by_block(lines, labels.hint("merge"))
    assert labelled.columns[-1] == "label" and set(labelled.columns) == {"line_id", "block_id", "label"}
    rows = labelled.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.line_id, r.label) for r in rows) == [(k, int(k % 100 == 8)) for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {r[0] for r in logs.label_by_block(lines, labels.hint("merge")).where("block_id IS NULL").select(F.spark_partition_id()).distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1


@pytest.mark.parametrize("most", [1000, 3])
def test_lines_are_not_sorted_for_their_labels(spark, most, monkeypatch):
    """Few anomalous blocks are broadcast and many hashed; a sort would hold the lines of a partition."""
    monkeypatch.setattr(logs, "BROADCAST_LABELS", most, raising=False)
    lines = spark.range(2000).select(F.col("id").alias("line_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("b"), F.col("id") % 50)).alias("block_id"))
    labels = spark.range(40).select(F.concat(F.lit("b"), "id").alias("block_id"), F.when(F.col("id") % 4 == 1, "Anomaly").otherwise("Normal").alias("label"))
    labelled = logs.label_by_block(lines, labels)
    got = {r.line_id: r.label for r in labelled.collect()}
    assert got == {k: int(k % 5 > 0 and k % 50 < 40 and k % 50 % 4 == 1) for k in range(2000)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = logs.label_by_block(lines, labels)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and ("BroadcastHashJoin" in plan) == (most == 1000)
