"""Preprocessing runs: from raw lines, or from stored tables, to sequences, features and a summary."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from contextlib import nullcontext
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import features, matching, mining, sequences, split, templates
from tracemill.plans import stages
from tracemill.session import materialise, scratch_scope, stored
from tracemill.sources import logs, summary, tables

Stage = Callable[[str, Callable[[], DataFrame]], DataFrame]

MODES = ("full", "match", "load")
KEYS = {
    "dataset": "name mode raw_log_path output_dir label_file",
    "parsing": "depth sim_threshold max_children log_line_pattern content_regex label_extraction label masking_patterns "
    "min_template_occurrence templates_file",
    "sequencing": "grouping_strategy window_size stride time_column time_window_seconds block_id_regex",
    "features": "save_occurrence_matrix save_statistical max_length",
    "output": "save_templates save_metadata save_parsed_logs",
    "loading": "source_dir num_templates files",
}
_METADATA = ("seq_id", "strategy", "block_id", "session_id", "window_start", "window_end", "time_span_seconds", "length")


def load_config(source: str | Mapping[str, Any]) -> dict[str, Any]:
    """A config as a mapping, or read from a YAML file."""
    if isinstance(source, Mapping):
        return dict(source)
    import yaml

    with open(source, encoding="utf-8") as file:
        return yaml.safe_load(file)


def check_keys(config: Mapping[str, Any]) -> None:
    """Raise for sections and keys that no run knows."""
    unknown = [s for s in config if s not in KEYS]
    unknown += [f"{s}.{k}" for s in config if s in KEYS for k in config[s] or () if k not in KEYS[s].split()]
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(unknown))}")


def _section(config: Mapping[str, Any], name: str) -> Mapping[str, Any]:
    return config.get(name) or {}


def _line_label(parsing: Mapping[str, Any]):
    return text.alert_tag_label if parsing.get("label_extraction") == "bgl" else parsing.get("label")


def parsed_events(raw: DataFrame, config: Mapping[str, Any], mode: str, stage: Stage = lambda name, make: stored(make())) -> dict[str, DataFrame]:
    """Lines with events, and the template table: mined in mode ``full``, given in mode ``match``.

    ``stage`` stores the parsed lines and the mined messages, or gives what an earlier run stored.
    """
    spark, parsing, dataset = raw.sparkSession, _section(config, "parsing"), _section(config, "dataset")
    if mode == "match" and not parsing.get("templates_file"):
        raise ValueError("templates_file must be specified for 'match' mode.")
    pattern = parsing.get("log_line_pattern") or parsing.get("content_regex")
    parsed = logs.parse(raw, pattern, parsing.get("masking_patterns") or (), _line_label(parsing))
    if parsing.get("label_extraction") == "hdfs" and dataset.get("label_file"):
        parsed = logs.with_block_id(
            parsed, _section(config, "sequencing").get("block_id_regex", text.DEFAULT_BLOCK_ID)
        )
        parsed = logs.label_by_block(parsed, tables.read_labels(spark, dataset["label_file"]))
    # Every line is parsed once; mining and lookups read the stored result.
    sequencing = _section(config, "sequencing")
    if "block_id" not in parsed.columns and sequencing.get("grouping_strategy", "block_id") == "block_id":
        parsed = logs.with_block_id(parsed, sequencing.get("block_id_regex", text.DEFAULT_BLOCK_ID))
    whole = _section(config, "output").get("save_parsed_logs", False)
    lines = parsed if whole else parsed.drop("raw", "content")
    parsed = stage("lines", lambda: lines)
    if mode == "match":
        catalogue = materialise(tables.read_catalogue(spark, parsing["templates_file"]))
        matched = matching.match(parsed, catalogue)
        return {"parsed": matched, "templates": materialise(templates.match_statistics(matched, catalogue))}
    options = parsing.get("depth", 4), parsing.get("sim_threshold", 0.4), parsing.get("max_children", 100)
    messages = stage("messages", lambda: mining.mine_messages(parsed, *options))
    mined = mining.with_events(parsed, messages)
    found = materialise(templates.counts_of_messages(messages))
    out = {"discovered": found, "templates": found, "parsed": mined}
    least = parsing.get("min_template_occurrence", 1)
    if least > 1:
        # Filtering by frequency also removes noise templates.
        kept = templates.filter_templates(found, least)
        out |= {"templates": kept, "parsed": templates.to_unk(mined, kept)}
    return out


def build_sequences(parsed: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    options = _section(config, "sequencing")
    return sequences.build(
        parsed,
        options.get("grouping_strategy", "block_id"),
        time_column=options.get("time_column"),
        window_size=options.get("window_size", 20),
        stride=options.get("stride", 1),
        time_window_seconds=options.get("time_window_seconds", 3600),
        block_id_regex=options.get("block_id_regex", text.DEFAULT_BLOCK_ID),
    )


def sequence_summary(
    seqs: DataFrame, vocab: DataFrame | None = None, template_table: DataFrame | None = None, dataset: str = ""
) -> DataFrame:
    """The summary row of a run."""
    zero = F.lit(0).cast("long")

    def size(table: DataFrame | None):
        return table.agg(F.count(F.lit(1))).scalar() if table is not None else zero

    heads = seqs.where(F.col("start") == 0)
    counts = heads.agg(
        F.count(F.lit(1)).alias("num_sequences"),
        F.count_if(F.col("label") == 0).alias("normal_sequences"),
        F.count_if(F.col("label") == 1).alias("anomaly_sequences"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("anomaly_rate"),
        F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_sequence_length"),
    )
    return counts.select(
        F.lit(dataset).alias("dataset"), size(template_table).alias("num_templates"), "*", size(vocab).alias("vocab_size")
    )


def preprocess(raw: DataFrame, config: Mapping[str, Any], stage: Stage = lambda name, make: stored(make())) -> dict[str, DataFrame]:
    """Parsed lines, templates, events and sequences of numbered raw lines."""
    mode = _section(config, "dataset").get("mode", "full")
    out = parsed_events(raw, config, mode, stage)
    times = _section(config, "sequencing").get("time_column")
    out["events"] = logs.stored_events(out["parsed"], more=(times,) if times else ())
    out["sequences"] = build_sequences(out["events"], config)
    return out


def _features(out: dict[str, DataFrame], options: Mapping[str, Any]) -> None:
    seqs = out["sequences"]
    out["vocabulary"] = features.vocabulary(seqs)
    out["padded"] = features.padded_blocks(seqs, out["vocabulary"], options.get("max_length"), features.BLOCK_COLUMNS)
    if options.get("save_occurrence_matrix", False):
        out["occurrence"] = features.occurrence_blocks(seqs, out["vocabulary"], features.BLOCK_COLUMNS)
    if options.get("save_statistical", False):
        out["statistics"] = features.statistics(seqs)


def run(
    spark: SparkSession, config: str | Mapping[str, Any], sample_size: int | None = None, raw: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Run a config in its mode and return its tables.

    With ``dataset.output_dir`` every table is written there once and returned as stored; without it
    sequences are checkpointed, as several tables follow from them. ``raw`` replaces ``raw_log_path``.

    A run with ``output_dir`` that reads files keeps its parsed lines and mined messages in ``output_dir``/_stages while it
    lasts. If it breaks off, the next run of the same configuration over the same files goes on from there. When it ends
    well, these and its other intermediate tables are deleted, and only tables of ``output_dir`` are returned.
    """
    config = load_config(config)
    check_keys(config)
    folder = _section(config, "dataset").get("output_dir")
    with scratch_scope(spark) if folder else nullcontext():
        out, written, kept = _run(spark, config, sample_size, raw)
    if kept is not None:
        kept.clear()
    return {name: table for name, table in out.items() if name in written} if folder else out


def _run(
    spark: SparkSession, config: Mapping[str, Any], sample_size: int | None, raw: DataFrame | None
) -> tuple[dict[str, DataFrame], set[str], stages.Stages | None]:
    """The tables of a run, the names of those that are written, and its stages."""
    started = time.time()
    written: set[str] = set()
    kept = None
    dataset, options = _section(config, "dataset"), _section(config, "output")
    mode, name, folder = dataset.get("mode", "full"), dataset.get("name", ""), dataset.get("output_dir")
    if mode not in MODES:
        raise ValueError(f"Invalid mode specified: {mode}")

    def store(table: str, partition_by=()) -> None:
        if folder and table in out:
            out[table] = tables.write_table(out[table], f"{folder}/{table}", partition_by)
            written.add(table)

    if mode == "load":
        loading = _section(config, "loading")
        out = tables.load_preprocessed(spark, loading["source_dir"], loading.get("files") or ())
        counted = out.get("templates")
        row = sequence_summary(out["sequences"], out.get("vocabulary"), counted, name)
        if counted is None:
            row = row.withColumn("num_templates", F.lit(loading.get("num_templates", 0)).cast("long"))
        for table in list(out):
            store(table)
    else:
        lines = raw if raw is not None else logs.read_logs(spark, dataset["raw_log_path"], sample_size)
        if raw is not None and sample_size is not None:
            lines = sequences.indexed(raw).where(F.col("row_idx") < sample_size)
        if folder and raw is None:
            inputs = [dataset["raw_log_path"], dataset.get("label_file"), _section(config, "parsing").get("templates_file")]
            mark = stages.fingerprint(spark, {**config, "sample_size": sample_size}, [str(p) for p in inputs if p])
            kept = stages.Stages(spark, f"{folder}/_stages", mark)
        out = preprocess(lines, config, kept.table) if kept else preprocess(lines, config)
        if folder:
            store("sequences")
        else:
            out["sequences"] = materialise(out["sequences"])
        _features(out, _section(config, "features"))
        if options.get("save_metadata", True):
            out["metadata"] = split.heads(out["sequences"]).select(*_METADATA)
        for table in ("vocabulary", "padded", "occurrence", "statistics", "metadata"):
            store(table)
        if folder and "occurrence" in out:
            labels = split.heads(out["sequences"]).select("seq_id", "label")
            tables.write_occurrence_blocks(labels, out["occurrence"], out["vocabulary"], f"{folder}/occurrence_matrix", features.BLOCK_COLUMNS)
        if options.get("save_templates", True):
            store("templates")
        if options.get("save_parsed_logs", False):
            store("parsed")
        # The number of templates is that before filtering; the kept ones are reported beside it.
        row = sequence_summary(out["sequences"], out["vocabulary"], out.get("discovered", out["templates"]), name)
        row = row.withColumn("kept_templates", out["templates"].agg(F.count(F.lit(1))).scalar())
    row = materialise(row)
    out["summary"] = row.select(
        "*",
        F.lit(time.time() - started).alias("duration_seconds"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
    if folder:
        store("summary")
        summary.write_summary(out["summary"], name, f"{folder}/summary_text")
    return out, written, kept
