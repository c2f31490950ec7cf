import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill import session
from tracemill.operators import explore, features, sequences
from tracemill.sources.tables import as_sequences


def seqs_of(spark, *lists, labels=None):
    rows = [(f"s{k}", list(e), (labels or [0] * len(lists))[k]) for k, e in enumerate(lists)]
    return as_sequences(spark.createDataFrame(rows, "seq_id STRING, events ARRAY<STRING>, label INT"))


def test_vocabulary_is_in_code_point_order(spark):
    vocab = features.vocabulary(seqs_of(spark, ["E2", "E10", "<UNK>"], ["E1", "E11"]))
    assert {r.event: r.idx for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "E1": 2, "E10": 3, "E11": 4, "E2": 5}
    assert {r.idx: r.event for r in features.inverse(vocab).collect()}[3] == "E10"


@pytest.mark.parametrize("limit", [2, 2000])
def test_unknown_events_are_zero_in_ids_and_absent_in_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "MAP_VOCABULARY", limit)  # a small limit takes the join
    seqs = seqs_of(spark, ["a", "x", "b", "a"], [], ["x"])
    vocab = spark.createDataFrame([("<PAD>", 0), ("a", 1), ("b", 2)], "event STRING, idx INT")
    got = {r.seq_id: (r.ids, r.oov_count) for r in features.encode(seqs, vocab).collect()}
    assert got == {"s0": ([1, 0, 2, 1], 1), "s1": ([], 0), "s2": ([0], 1)}
    assert {(r.seq_id, r.event): r.n for r in features.occurrence(seqs, vocab).collect()} == {("s0", "a"): 2, ("s0", "b"): 1}
    dense = {r.seq_id: r.counts for r in features.occurrence_dense(seqs, vocab).collect()}
    assert dense == {"s0": [0, 2, 1], "s1": [0, 0, 0], "s2": [0, 0, 0]}
    decoded = {r.seq_id: r.events for r in features.decode(features.padded(seqs, vocab, 4), vocab).collect()}
    assert decoded["s0"] == ["a", "b", "a"]


def test_padding_from_either_end(spark):
    seqs = seqs_of(spark, [], ["1", "2", "3"], ["1", "2", "3", "4", "5", "6"])
    vocab = features.vocabulary(seqs)
    head = {r.seq_id: r.ids for r in features.padded(seqs, vocab, 4, "head").collect()}
    tail = {r.seq_id: r.ids for r in features.padded(seqs, vocab, 4, "tail").collect()}
    assert head == {"s0": [0] * 4, "s1": [1, 2, 3, 0], "s2": [1, 2, 3, 4]}
    assert tail == {"s0": [0] * 4, "s1": [1, 2, 3, 0], "s2": [3, 4, 5, 6]}
    assert {len(r.ids) for r in features.padded(seqs, vocab).collect()} == {6}
    with pytest.raises(ValueError):
        features.padded(seqs, vocab, 4, "middle")


def test_padding_of_long_sequences_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_ROW", 12)
    df = spark.createDataFrame([(k, f"e{k % 7}", "blk_1") for k in range(40)] + [(k, "e1", "blk_2") for k in range(3)], "line_id BIGINT, event_id STRING, content STRING")
    pieces = sequences.by_block(df, max_piece=5)
    vocab = features.vocabulary(pieces)
    for truncate, part in (("head", slice(0, 12)), ("tail", slice(28, 40))):
        got = {r.seq_id: r.ids for r in features.padded(pieces, vocab, 12, truncate).collect()}
        assert got == {"blk_1": [k % 7 + 1 for k in range(40)][part], "blk_2": [2] * 3 + [0] * 9}
    with pytest.raises(Exception, match="dense row would be too long"):
        features.padded(pieces, vocab).collect()


def test_statistics(spark):
    seqs = seqs_of(spark, [], ["a"] * 5, list("abcd"), list("aab"))
    rows = {r.seq_id: r for r in features.statistics(seqs).collect()}
    assert (rows["s0"].seq_length, rows["s0"].unique_events, rows["s0"].entropy, rows["s0"].max_event_freq) == (0, 0, 0.0, 0)
    assert rows["s1"].entropy == pytest.approx(0, abs=1e-9)
    assert rows["s2"].entropy == pytest.approx(2, abs=1e-8)
    p = [2 / 3, 1 / 3]
    assert rows["s3"].entropy == pytest.approx(-sum(x * math.log2(x + 1e-10) for x in p), abs=1e-12)
    assert rows["s3"].repetition_rate == pytest.approx(2 / 3) and rows["s3"].diversity == pytest.approx(2 / 3)


def test_statistics_do_not_depend_on_pieces(spark):
    df = spark.createDataFrame([(k, f"e{k * k % 11}", f"blk_{k % 3}", int(k == 50)) for k in range(200)], "line_id BIGINT, event_id STRING, content STRING, label INT")
    rounded = lambda d: sorted((r.seq_id, r.label, r.seq_length, r.unique_events, round(r.entropy, 9), r.max_event_freq) for r in d.collect())
    assert rounded(features.statistics(sequences.by_block(df, max_piece=7))) == rounded(features.statistics(sequences.by_block(df)))


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 0, 2, 2],), ([0, 0],)], "ids ARRAY<INT>")
    ids = F.col("ids")
    row = df.select(arrays.effective_length(ids), arrays.without_padding(ids), arrays.repetition_ratio(ids)).collect()
    assert [tuple(r) for r in row] == [(3, [1, 2, 2], 4 / 3), (2, [], 2.0)]


def test_histogram_agrees_with_numpy(spark):
    import numpy as np

    values = [0.1 * k for k in range(101)] + [5.0] * 3 + [10.0]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    rows = explore.histogram(df, "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert sum(r.n for r in rows) == len(values)
    assert [r.bin_low for r in rows] == pytest.approx(list(edges[:-1]))
    assert max(abs(r.n - c) for r, c in zip(rows, counts)) <= 1
    same = explore.histogram(spark.createDataFrame([(2.0,)] * 3, "x DOUBLE"), "x", 4).orderBy("bin").collect()
    assert (same[0].bin_low, same[3].bin_high, sum(r.n for r in same)) == (1.5, 2.5, 3)


def test_quantiles_agree_with_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(10, 777), 1)
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(values)], "x DOUBLE, g INT")
    row = explore.quantiles(df, "x", [0.0, 0.25, 0.5, 0.95, 1.0]).first()
    assert list(row) == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.95, 1.0])))
    for r in explore.quantiles(df, "x", [0.3], "g").collect():
        assert r.q0 == pytest.approx(np.quantile(values[r.g :: 2], 0.3))


def test_p_values_against_tables():
    # Two-sided critical values of Student's t.
    for t, freedom, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.984, 100, 0.05), (1.95996, 1e7, 0.05), (0.0, 5, 1.0)):
        assert explore.two_sided_p(t, freedom) == pytest.approx(p, rel=2e-3)


def test_t_test_verdict(spark):
    df = spark.createDataFrame([(0, float(k % 5)) for k in range(50)] + [(1, 10.0 + k % 5) for k in range(50)], "label INT, x DOUBLE")
    row = explore.t_test(df, "x").first()
    assert row.significant and row.t_statistic < 0 and row.degrees_of_freedom == 98


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 1000, [1, 2]) for k in range(20)], "id LONG, text STRING, ids ARRAY<INT>").cache()
    assert session.is_small(df, 20) and not session.is_small(df, 19)
    assert session.is_small(df, 100, 30_000) and not session.is_small(df, 100, 20_000)
    assert session.is_small(df.limit(0), 0) and session.is_small(df.select(F.lit(None).cast("string").alias("a b")), 100)


def test_counts_within_the_row_are_computed_once(spark):
    events = [f"e{k * 7 % 5}" if k % 11 else None for k in range(3000)]
    seqs = seqs_of(spark, events, [None], [])
    counted = features.occurrence(seqs)
    # A second copy of the sort would stand inside a lambda function and run for every element.
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
    assert {(r.seq_id, r.event): r.n for r in counted.collect()} == {("s0", e): n for e, n in Counter(events).items() if e is not None}
