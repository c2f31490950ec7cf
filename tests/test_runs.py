import os

import pytest
from pyspark.sql import functions as F

from tracemill import session
from tracemill.operators import features, sequences
from tracemill.plans import experiments, preprocess, report
from tracemill.sources import logs, summary, tables
from tracemill.streaming import lines as stream_lines

MASKS = [{"pattern": r"\b\d+\b", "mask": "<NUM>"}]


def alert_file(path, n=60):
    rows = []
    for k in range(n):
        tag = "ALERT" if k in (13, 14) else "-"
        message = f"user {k} logged in" if k % 3 else ("cache parity error corrected" if k % 2 else f"r{k}=0x{k:08x}")
        rows.append(f"{tag} {k} INFO {message}" + ("\n" if k % 10 == 0 else ""))
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def config(tmp_path, mode="full", **sequencing):
    return {
        "dataset": {"name": "T", "mode": mode, "raw_log_path": str(tmp_path / "raw.log"), "output_dir": str(tmp_path / f"out_{mode}")},
        "parsing": {"log_line_pattern": r"\S+ \d+ INFO (.+)", "label_extraction": "bgl", "masking_patterns": MASKS, "min_template_occurrence": 5},
        "sequencing": {"grouping_strategy": "sliding_window", "window_size": 10, "stride": 5} | sequencing,
        "features": {"save_occurrence_matrix": True, "save_statistical": True},
        "output": {"save_parsed_logs": True},
    }


def test_full_run_then_load(spark, tmp_path):
    alert_file(tmp_path / "raw.log")
    out = preprocess.run(spark, config(tmp_path))
    row = out["summary"].first()
    assert (row.num_sequences, row.normal_sequences, row.anomaly_sequences) == (11, 9, 2)
    assert row.avg_sequence_length == 10.0 and row.anomaly_rate == pytest.approx(2 / 11)
    # Two shapes are kept; the register dumps are all alike in being rare.
    assert (row.kept_templates, row.vocab_size) == (2, 4)
    events = {e for r in out["sequences"].collect() for e in r.events}
    assert "<UNK>" in events and len(events) == 3
    assert {len(r.ids) for r in out["padded"].collect()} == {10}
    assert out["occurrence"].count() == out["statistics"].count() == 11
    assert spark.read.parquet(str(tmp_path / "out_full/parsed")).count() == 60
    wide = spark.read.options(header=True).csv(str(tmp_path / "out_full/occurrence_matrix/00000"))
    assert wide.columns[0] == "seq_id" and wide.columns[-1] == "label" and len(wide.columns) == 6 and wide.count() == 11
    metadata = spark.read.parquet(str(tmp_path / "out_full/metadata"))
    assert metadata.count() == 11 and metadata.agg(F.max("window_end")).first()[0] == 60
    shown = {r.key: r.value for r in summary.read_summary(spark, str(tmp_path / "out_full/summary_text")).collect()}
    assert shown["num_sequences"] == "11" and shown["anomaly_rate"] == "0.1818" and shown["dataset"] == "T"
    loaded = preprocess.run(
        spark, {"dataset": {"name": "T", "mode": "load"}, "loading": {"source_dir": str(tmp_path / "out_full"), "num_templates": 29}}
    )
    again = loaded["summary"].first()
    assert (again.num_sequences, again.vocab_size, again.num_templates) == (11, 4, 2)
    sampled = preprocess.run(spark, config(tmp_path) | {"dataset": {"mode": "full", "raw_log_path": str(tmp_path / "raw.log")}}, sample_size=20)
    assert sampled["summary"].first().num_sequences == 3


def test_match_run_from_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    alert_file(tmp_path / "raw.log")
    (tmp_path / "t.csv").write_text('EventId,EventTemplate,OccurrenceCount\nE1,user <NUM> logged in,3\nE2,"cache, never",1\nE3,cache parity <*>,2\n')
    conf = config(tmp_path, "match", grouping_strategy="session", window_size=7)
    conf["parsing"]["templates_file"] = str(tmp_path / "t.csv")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(conf))
    out = preprocess.run(spark, str(tmp_path / "c.yaml"))
    counts = {r.event_id: r.occurrence_count for r in out["templates"].collect()}
    assert counts == {"E1": 40, "E2": 0, "E3": 10}
    assert sum(r.length for r in out["sequences"].collect()) == 60
    conf["parsing"]["templates_file"] = None
    with pytest.raises(ValueError, match="templates_file"):
        preprocess.run(spark, conf)


def test_block_run_with_label_file(spark, tmp_path):
    (tmp_path / "raw.log").write_text("".join(f"{k} INFO got blk_{k % 4} ok\n" for k in range(20)))
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_0,Normal\nblk_2,Anomaly\n")
    conf = {
        "dataset": {"name": "B", "raw_log_path": str(tmp_path / "raw.log"), "label_file": str(tmp_path / "labels.csv")},
        "parsing": {"label_extraction": "hdfs", "log_line_pattern": r"\d+ INFO (.+)"},
        "sequencing": {"grouping_strategy": "block_id"},
    }
    out = preprocess.run(spark, conf)
    assert {r.seq_id: r.label for r in out["sequences"].collect()} == {"blk_0": 0, "blk_1": 0, "blk_2": 1, "blk_3": 0}


def test_unknown_keys_raise(spark):
    with pytest.raises(ValueError, match="output.save_everything, plots"):
        preprocess.run(spark, {"output": {"save_everything": True}, "plots": {}})


def test_load_run_with_listed_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["E1", "E2"], 0), ("b", ["E2"], 1)], "seq_id STRING, events ARRAY<STRING>, label INT")
    rows.write.parquet(str(tmp_path / "sequences"))
    (tmp_path / "X.log_templates.csv").write_text("EventId,EventTemplate\nE1,one [*]\nE2,two\n")
    (tmp_path / "vocab.csv").write_text("EventId,Index,EventTemplate\nE1,0,one [*]\nE2,1,two\n")
    (tmp_path / "anomaly_label.csv").write_text("BlockId,Label\na,Normal\nb,Anomaly\n")
    files = ["X.npz", "X.log_templates.csv", "anomaly_label.csv", "vocabulary.pkl", "vocab.csv"]
    config = {"dataset": {"name": "X", "mode": "load"}, "loading": {"source_dir": str(tmp_path), "files": files}, "parsing": {}, "output": None}
    with pytest.warns(UserWarning, match="X.npz"):
        out = preprocess.run(spark, config)
    row = out["summary"].first()
    assert (row.num_templates, row.num_sequences, row.vocab_size) == (2, 2, 3)
    assert {r.event: r.idx for r in out["vocabulary"].collect()} == {"<PAD>": 0, "E1": 1, "E2": 2}
    assert {r.block_id: r.label for r in out["labels"].collect()} == {"a": 0, "b": 1}


def test_invalid_mode(spark):
    with pytest.raises(ValueError, match="Invalid mode"):
        preprocess.run(spark, {"dataset": {"mode": "other"}})


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.json").write_text('{\n "E1": 0,\n "E10": 1\n}')
    (tmp_path / "w.json").write_text('{"<PAD>": 0, "E1": 1}')
    (tmp_path / "r.json").write_text('{"0": "E1", "1": "E10"}')
    read = lambda n: {r.event: r.idx for r in tables.read_vocabulary(spark, str(tmp_path / n)).collect()}
    assert read("v.json") == {"<PAD>": 0, "E1": 1, "E10": 2}
    assert read("w.json") == {"<PAD>": 0, "E1": 1}
    assert {r.idx: r.event for r in tables.read_reverse_vocabulary(spark, str(tmp_path / "r.json")).collect()} == {0: "E1", 1: "E10"}


def test_a_run_goes_on_after_its_last_finished_stage(spark, tmp_path, monkeypatch):
    """Stopped after mining, it does not mine again; another configuration or another file does. Nothing is left behind."""
    alert_file(tmp_path / "raw.log")
    conf = config(tmp_path)
    kept = tmp_path / "out_full/_stages"
    mined, real = [], preprocess.mining.mine_messages
    monkeypatch.setattr(preprocess.mining, "mine_messages", lambda *a: mined.append(1) or real(*a))

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(preprocess.templates, "counts_of_messages", stopped)
        for times in (1, 1):
            with pytest.raises(RuntimeError, match="stopped"):
                preprocess.run(spark, conf)
            assert len(mined) == times
        with pytest.raises(RuntimeError, match="stopped"):
            preprocess.run(spark, conf | {"parsing": conf["parsing"] | {"sim_threshold": 0.5}})
        assert len(mined) == 2
        with pytest.raises(RuntimeError, match="stopped"):
            preprocess.run(spark, conf)
        assert len(mined) == 3 and sorted(p.name for p in kept.iterdir()) == ["lines", "lines.manifest", "messages", "messages.manifest"]
    # A table that was cut off has no manifest and is made again.
    (kept / "messages.manifest").rename(kept / "gone")
    made = []
    real_folder = session.scratch_folder
    monkeypatch.setattr(session, "scratch_folder", lambda *a: made.append(real_folder(*a)) or made[-1])
    out = preprocess.run(spark, conf)
    assert len(mined) == 4 and out["summary"].first().num_sequences == 11
    assert not kept.exists() and made and not [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert "events" not in out and out["padded"].count() == 11
    alert_file(tmp_path / "raw.log", 70)
    assert preprocess.run(spark, conf)["summary"].first().num_sequences == 13 and len(mined) == 5


@pytest.mark.parametrize("events, columns", [(2_001, 2_000), (30, 7)])
def test_a_run_writes_the_same_tables_at_any_width(spark, tmp_path, monkeypatch, events, columns):
    """More events than columns of a block, and a sequence longer than a dense row may be."""
    monkeypatch.setattr(features, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(features, "MAX_ROW", 100)
    word = lambda k: "".join(chr(97 + int(d)) for d in f"{k:04d}")
    lines = [f"blk_1 {word(k)} {word(k)}x {word(k)}y" for k in range(events)] + [f"blk_2 {word(3)} {word(3)}x {word(3)}y"] * 3
    (tmp_path / "raw.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\n" + "".join(f"E{k:04d},<*> {word(k)} {word(k)}x {word(k)}y\n" for k in range(events)))
    out = preprocess.run(spark, {
        "dataset": {"mode": "match", "raw_log_path": str(tmp_path / "raw.log"), "output_dir": str(tmp_path / "out")},
        "parsing": {"templates_file": str(tmp_path / "t.csv")},
        "features": {"save_occurrence_matrix": True},
    })
    width, blocks = events, -(-events // columns)
    ids = {(r.seq_id, r.block): r.ids for r in out["padded"].collect()}
    assert [len(ids["blk_1", k]) for k in range(blocks)] == [columns] * (blocks - 1) + [width - columns * (blocks - 1)]
    assert sum((ids["blk_1", k] for k in range(blocks)), []) == list(range(1, events + 1))
    assert {k: v for k, v in ids.items() if k[0] == "blk_2"} == {("blk_2", 0): [4] * 3 + [0] * (min(columns, width) - 3)}
    counts = {(r.seq_id, r.block): r.counts for r in out["occurrence"].collect()}
    blocks = -(-(events + 1) // columns)
    assert sum((counts["blk_1", k] for k in range(blocks)), []) == [0] + [1] * events
    assert [k for s, k in counts if s == "blk_2"] == [0] and counts["blk_2", 0][4] == 3 and sum(counts["blk_2", 0]) == 3
    seen = {}
    for k in range(blocks):
        part = spark.read.options(header=True).csv(str(tmp_path / f"out/occurrence_matrix/{k:05d}"))
        assert part.count() == 2 and part.columns[0] == "seq_id" and part.columns[-1] == "label"
        for r in part.collect():
            seen.setdefault(r.seq_id, []).extend(zip(part.columns[1:-1], map(int, r[1:-1])))
    assert [e for e, _ in seen["blk_1"]] == ["<PAD>"] + [f"E{k:04d}" for k in range(events)]
    assert [n for _, n in seen["blk_1"]] == [0] + [1] * events
    assert {e: n for e, n in seen["blk_2"] if n} == {"E0003": 3}


def test_padded_blocks_of_cut_sequences(spark):
    """Pieces that do not end where blocks do, in both forms of a sequence."""
    rows = [(k % 3, chr(97 + (k * k) % 11), k) for k in range(100)] + [(9, "z", 1000)]
    log = spark.createDataFrame([(i, str(b), e, 0) for b, e, i in rows], "line_id BIGINT, block_id STRING, event_id STRING, label INT")
    for piece in (7, 1000):
        seqs = sequences.by_block(log, max_piece=piece)
        vocab = features.vocabulary(seqs)
        whole = {r.seq_id: r.ids for r in features.padded(sequences.by_block(log), vocab).collect()}
        got = {}
        for r in features.padded_blocks(seqs, vocab, columns=10).orderBy("seq_id", "block").collect():
            assert r.block == len(got.get(r.seq_id, [])) // 10
            got[r.seq_id] = got.get(r.seq_id, []) + r.ids
        assert {s: v + [0] * (len(whole[s]) - len(v)) for s, v in got.items()} == whole


def test_occurrence_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("BlockId,Label,Type,E1,E2\nb1,Success,x,2,0\nb2,Anomaly,y,0,3\n")
    wide = tables.read_occurrence_matrix(spark, str(tmp_path / "m.csv"), ["E1", "E2"])
    assert [tuple(r) for r in wide.orderBy("seq_id").collect()] == [("b1", 2, 0, 0), ("b2", 0, 3, 1)]
    assert [r.vector for r in experiments.wide_vectors(wide, ["E1", "E2"]).orderBy("seq_id").collect()] == [[2.0, 0.0], [0.0, 3.0]]
    assert tables.read_first_rows(spark, str(tmp_path / "m.csv"), 1).count() == 1
    tables.write_occurrence(wide, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns == ["seq_id", "E1", "E2", "label"]


def log_sequences(spark, n=300):
    rows = [(f"s{k}", list("abcd") * 3 if k % 10 else list("abzd") * 3, int(k % 10 == 0)) for k in range(n)]
    return tables.as_sequences(spark.createDataFrame(rows, "seq_id STRING, events ARRAY<STRING>, label INT"))


def test_experiments_find_a_planted_event(spark, tmp_path):
    seqs = log_sequences(spark)
    found = experiments.next_event_experiment(seqs, top_k=1, max_order=2, patience=1, dataset="T")
    assert found.metrics.first().f1 == 1.0
    tables.write_result(found.report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().metrics.f1 == 1.0
    from tracemill.operators import features

    forest = experiments.forest_experiment(experiments.vectors_of(seqs, features.vocabulary(seqs)), n_estimators=20)
    assert forest.metrics.first().auc == 1.0
    assert experiments.cross_dataset_next_event(seqs, seqs, 1, 1).metrics.first().recall == 1.0
    other = seqs.withColumn("events", F.transform("events", lambda e: F.when(e == "z", "q").otherwise(e)))
    crossed = experiments.cross_dataset_forest(seqs, other, n_estimators=10).predictions
    assert {r.oov_count for r in crossed.where("label = 1").collect()} == {3}


def test_report_sections(spark):
    rows = {(r.section, r.metric): r.value for r in report.dataset_report(log_sequences(spark)).collect()}
    assert rows["labels", "anomaly_percent"] == pytest.approx(10.0)
    assert rows["length", "mean.1"] == 12.0 and rows["tokens", "tokens.0"] == 3240.0


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("- 1 INFO user 7 logged in\n\nALERT 2 INFO strange\n")
    catalogue = spark.createDataFrame([("E1", "user <NUM> logged in")], "event_id STRING, event_template STRING")
    lines = stream_lines.parse_stream(spark, str(tmp_path / "in"), catalogue, r"\S+ \d+ INFO (.+)", MASKS)
    query = lines.writeStream.format("memory").queryName("stream_of_lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("stream_of_lines").orderBy("raw").collect()
    assert [(r.event_id, r.label) for r in rows] == [("E1", 0), ("<UNK>", 1)]


def test_stream_of_sessions(spark, tmp_path):
    times = [0, 10, 20, 31, 500, 505, 5000]
    batch = spark.createDataFrame([("u", t, int(t == 10)) for t in times], "k STRING, t BIGINT, label INT").withColumn("t", F.timestamp_seconds("t"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        stream_lines.gap_sessions(events, "t", "k", 10, 0)
        .writeStream.format("memory").queryName("stream_of_sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    rows = spark.table("stream_of_sessions").orderBy("first").collect()
    # The last session stays open until the watermark passes it.
    assert [(r.length, r.label) for r in rows] == [(3, 1), (1, 0), (2, 0)]


def test_sample_of_files(spark, tmp_path):
    alert_file(tmp_path / "raw.log")
    assert logs.read_logs(spark, str(tmp_path / "raw.log"), sample_size=7).count() == 7
