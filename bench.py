"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run whole and its rows are consumed by the no-op sink. Rates are lines or sequences per
second of the query beside them.

``python bench.py --lines N`` times one full run (parse, mask, mine, filter, window, features, all written) over N lines made
from the events of the same folder, repeated with other numbers, in place of the queries: 5,000,000 is the size of the
published run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.plans import preprocess  # noqa: E402
from tracemill.queries import inputs, registry  # noqa: E402
from tracemill.session import local_session  # noqa: E402
from tracemill.sources import logs  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

QUERIES = [
    "masking",
    "block_content_extract",
    "label_by_block",
    "template_match",
    "template_mining",
    "rare_to_unk",
    "block_sequences",
    "block_log_sequences",
    "sliding_windows",
    "gap_sessions",
    "sequence_stats",
    "window_stats",
    "block_log_occurrence",
    "block_log_stats",
    "padded_tail",
    "event_share_by_class",
    "box_stats",
    "stratified_split",
    "next_detect",
    "roc_auc",
    "iforest_scores",
    "full_run_summary",
]


def long_run(lines: int) -> None:
    """One full run over ``lines`` lines from a text file."""
    spark = local_session(CPUS, "tracemill-bench", 4 * CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    some = inputs.alert_lines(spark, FOLDER)
    copies = -(-lines // max(1, some.count()))
    again = some.select(F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), "raw")
    with tempfile.TemporaryDirectory(prefix="tracemill-bench-") as folder:
        # The amount at the end of a line differs from copy to copy; half a dozen masks apply as before.
        again.select(F.concat("raw", F.lit(" "), (F.col("copy") * 7919 % 10_007).cast("string")).alias("value")).write.text(f"{folder}/raw")
        config = {
            "dataset": {"name": "alerts", "mode": "full", "raw_log_path": f"{folder}/raw", "output_dir": f"{folder}/out"},
            "parsing": {
                "log_line_pattern": inputs.ALERT_LOG_PATTERN, "label_extraction": "bgl", "min_template_occurrence": 5,
                "masking_patterns": [{"pattern": p, "mask": m} for p, m in inputs.ALERT_LOG_MASKS],
            },
            "sequencing": {"grouping_strategy": "sliding_window", "window_size": 20, "stride": 5},
        }
        started = time.perf_counter()
        row = preprocess.run(spark, config)["summary"].first()
        seconds = time.perf_counter() - started
    total = copies * some.count()
    out = {"metric": "full_run_seconds", "value": round(seconds, 3), "unit": "sec", "lines": total, "lines_per_sec": round(total / seconds), "sequences_per_sec": round(row.num_sequences / seconds), "templates": row.num_templates, "cpus": CPUS}
    print(json.dumps(out))
    spark.stop()


def main() -> None:
    spark = local_session(CPUS, "tracemill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry().queries
    # Start the workers and compile the common paths before the clock runs.
    logs.parse(inputs.alert_lines(spark, FOLDER)).limit(10).collect()
    times: dict[str, float] = {}
    for name in QUERIES:
        started = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    events = inputs.table(spark, FOLDER, "events").count()
    items = inputs.table(spark, FOLDER, "lineitem").count()
    windows = (events - 20) // 5 + 1
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "rates": {
                    "ingest_mask_lines_per_sec": round(events / times["masking"]),
                    "block_ingest_lines_per_sec": round(items / times["block_content_extract"]),
                    "block_log_sequence_lines_per_sec": round(items / times["block_log_sequences"]),
                    "sliding_windows_per_sec": round(windows / times["sliding_windows"]),
                    "full_run_lines_per_sec": round(events / times["full_run_summary"]),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    long_run(int(sys.argv[2])) if sys.argv[1:2] == ["--lines"] else main()
