import os
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import order, sequences
from tracemill.queries.sequences import block_log_sequences
from tracemill.sources import logs


def log(spark, rows, schema="line_id BIGINT, event_id STRING, label INT"):
    return spark.createDataFrame(rows, schema)


def joined(df):
    """Events of each sequence with its pieces put together."""
    out = {}
    for r in df.orderBy("seq_id", "piece").collect():
        if r.start == 0:
            out[r.seq_id] = []
        assert r.start == len(out[r.seq_id])
        out[r.seq_id] += r.events
    return out


@pytest.mark.parametrize(
    "n,size,stride", [(3, 20, 5), (19, 20, 5), (20, 20, 5), (21, 20, 5), (57, 7, 3), (103, 4, 9), (57, 20, 1), (23, 1, 1)]
)
def test_windows_match_brute_force(spark, n, size, stride):
    events = [f"e{k % 13}" for k in range(n)]
    flags = [1 if k % 17 == 5 else 0 for k in range(n)]
    df = log(spark, [(k * 3 + 7, e, f) for k, (e, f) in enumerate(zip(events, flags))]).repartition(5)
    got = sequences.by_sliding_window(df, window_size=size, stride=stride, chunk=11).orderBy("window_start").collect()
    starts = range(0, n - size + 1, stride)
    assert [(r.window_start, r.window_end, r.events, r.label, r.length) for r in got] == [
        (s, s + size, events[s : s + size], max(flags[s : s + size]), size) for s in starts
    ]


def test_windows_refuse_gaps_in_the_index(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (3, "c")], "row_idx BIGINT, event_id STRING")
    with pytest.raises(Exception, match="row_idx has gaps"):
        sequences.by_sliding_window(df, window_size=2).collect()


def test_chunks_keep_the_partial_tail(spark):
    df = log(spark, [(k, "a", 0) for k in range(45)])
    rows = sequences.build(df, "session", window_size=20).orderBy("session_id").collect()
    assert [(r.session_id, r.length) for r in rows] == [(0, 20), (1, 20), (2, 5)]


def test_labels_in_either_form_give_the_same_result(spark):
    rows = [(k, f"blk_{k % 3}", "e", k in (4, 7)) for k in range(30)]
    numbers = spark.createDataFrame([(a, b, c, int(d)) for a, b, c, d in rows], "line_id BIGINT, content STRING, event_id STRING, label INT")
    names = spark.createDataFrame(
        [(a, b, c, "Anomaly" if d else "Normal") for a, b, c, d in rows], "line_id BIGINT, content STRING, event_id STRING, label STRING"
    )
    for options in ({"strategy": "block_id"}, {"strategy": "session", "window_size": 4}, {"strategy": "sliding_window", "window_size": 5}):
        a = {r.seq_id: r.label for r in sequences.build(numbers, **options).collect()}
        b = {r.seq_id: r.label for r in sequences.build(names, **options).collect()}
        assert a == b and 1 in a.values() and 0 in a.values()
    assert {r.label for r in sequences.build(numbers.drop("label"), "block_id").collect()} == {0}


def test_lines_without_block_are_left_out_and_the_first_block_counts(spark):
    df = spark.createDataFrame([(1, "x", "blk_1 blk_2"), (2, "y", "none"), (3, "z", "to blk_2")], "line_id BIGINT, event_id STRING, content STRING")
    assert joined(sequences.build(df, "block_id")) == {"blk_1": ["x"], "blk_2": ["z"]}


def seconds(spark, times, schema="line_id BIGINT, event_id STRING, t DOUBLE"):
    df = spark.createDataFrame([(k, f"e{k}", t) for k, t in enumerate(times)], schema)
    return df.withColumn("t", F.timestamp_seconds("t"))


def brute_sessions(times, gap):
    rows = sorted((t, k) for k, t in enumerate(times) if t is not None)
    out, before = [], None
    for t, k in rows:
        if before is None or round((t - before) * 1e6) > gap * 1e6:
            out.append([])
        out[-1].append((f"e{k}", t))
        before = t
    return out


def test_gaps_at_below_and_above_the_threshold(spark):
    times = [0.0, 10.0, 20.5, 20.5, None, 30.5, 40.6, 100.0]
    rows = sequences.by_time_gap(seconds(spark, times), "t", time_window_seconds=10).orderBy("session_id").collect()
    expected = brute_sessions(times, 10)
    assert [r.events for r in rows] == [[e for e, _ in s] for s in expected]
    assert [r.time_span_seconds for r in rows] == pytest.approx([s[-1][1] - s[0][1] for s in expected])
    assert [r.session_id for r in rows] == list(range(len(expected)))


@pytest.mark.parametrize("gap", [0.5, 3, 40, 1000])
@pytest.mark.parametrize("max_piece", [7, 1_000_000])
def test_gap_sessions_match_brute_force(spark, gap, max_piece):
    rnd = random.Random(gap)
    times = [round(rnd.choice([rnd.uniform(0, 2000), float(rnd.randrange(50)), -rnd.uniform(0, 100)]), 3) for _ in range(400)]
    df = seconds(spark, times).repartition(4)
    got = joined(sequences.by_time_gap(df, "t", time_window_seconds=gap, max_piece=max_piece))
    assert [got[str(k)] for k in range(len(got))] == [[e for e, _ in s] for s in brute_sessions(times, gap)]


def test_gap_sessions_with_one_hot_time(spark):
    times = [5.0] * 300 + [50.0] * 20 + [5.5]
    df = seconds(spark, times)
    got = joined(sequences.by_time_gap(df, "t", time_window_seconds=10, max_piece=16))
    assert [got[str(k)] for k in range(len(got))] == [[e for e, _ in s] for s in brute_sessions(times, 10)]


@pytest.mark.parametrize("max_piece", [1, 10, 64])
def test_a_hot_block_is_cut_into_pieces_and_stays_whole(spark, max_piece):
    rnd = random.Random(1)
    rows = [(k * 7 % 100_003, f"e{k % 5}", "blk_1" if rnd.random() < 0.4 else f"blk_{rnd.randrange(2, 90)}", int(k == 17)) for k in range(1500)]
    df = spark.createDataFrame(rows, "line_id BIGINT, event_id STRING, content STRING, label INT").repartition(6)
    cut = sequences.by_block(df, max_piece=max_piece)
    whole = sequences.by_block(df)
    assert cut.agg(F.max(F.size("events"))).first()[0] <= max_piece
    assert joined(cut) == joined(whole)
    labels = lambda d: {r.seq_id: (r.label, r.length) for r in d.collect()}
    assert labels(cut) == labels(whole)


def test_positions_cross_cells(spark):
    bucket = order.BUCKET_ROWS
    df = spark.createDataFrame([("s", k * (bucket // 3) - 5 * bucket) for k in range(40)], "key STRING, line_id BIGINT")
    rows = sequences.positions(df, ["key"]).orderBy("line_id").collect()
    assert [r.position for r in rows] == list(range(40))


def test_dense_index_over_sparse_keys(spark):
    rnd = random.Random(3)
    keys = sorted(rnd.sample(range(-(10**15), 10**15), 700) + list(range(10**6 - 5, 10**6 + 5)))
    df = spark.createDataFrame([(k,) for k in keys], "k BIGINT").repartition(7)
    got = order.dense_index(df, "k", "i").orderBy("k").collect()
    assert [r.i for r in got] == list(range(len(keys)))


def test_running_totals_by_group(spark):
    rnd = random.Random(5)
    rows = {(g, round(rnd.uniform(0, 50), 2)): rnd.randrange(9) for g in "ab" for _ in range(400)}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in rows.items()], "g STRING, x DOUBLE, n BIGINT")
    for r in order.running_totals(df, "x", ["n"], ["g"], bucket_rows=100).collect():
        assert r.before_n == sum(n for (g, x), n in rows.items() if g == r.g and x < r.x)


def test_ranges_hold_a_bounded_number_of_rows(spark):
    """Keys in clusters and of any type: buckets follow the order and stay near the size asked for."""
    rnd = random.Random(8)
    keys = sorted({f"{rnd.choice('aaaaaaab')}{rnd.randrange(10**5)}" for _ in range(6000)})
    df = spark.createDataFrame([(k, 1) for k in keys], "key STRING, n BIGINT").repartition(5).cache()
    placed = {r.key: r._bucket for r in order.ranged(df, ["key"], 500).collect()}
    assert [placed[k] for k in keys] == sorted(placed.values())
    sizes = [list(placed.values()).count(b) for b in set(placed.values())]
    assert len(sizes) >= len(keys) // 500 and max(sizes) <= 1500
    before = {r.key: r.before_n for r in order.running_totals(df, "key", ["n"], bucket_rows=500).collect()}
    assert [before[k] for k in keys] == list(range(len(keys)))


def test_argument_errors(spark):
    df = log(spark, [(1, "a", 0)])
    with pytest.raises(ValueError, match="time_column"):
        sequences.build(df, "time_window")
    with pytest.raises(ValueError, match="Unknown grouping strategy"):
        sequences.build(df, "other")


@pytest.mark.parametrize("max_piece", [7, 1_000_000])
def test_texts_of_cut_sequences_are_one_row(spark, max_piece):
    rows = [(k, None if k % 3 == 0 and k > 20 else f"e{k}", f"b{k % 2}", k % 5, f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "line_id BIGINT, event_id STRING, block_id STRING, t INT, session_id STRING").repartition(4)
    df = df.withColumn("t", F.timestamp_seconds("t"))

    def expected(key, order=lambda r: r[0]):
        groups = {}
        for r in sorted(rows, key=order):
            groups.setdefault(key(r), []).append(r[1])
        return {k: (" ".join(e for e in v if e is not None), len(v)) for k, v in groups.items()}

    def found(seqs):
        got = [(r.seq_id, (r.events, r.length)) for r in seqs.collect()]
        assert len(got) == len(dict(got))
        return dict(got)

    assert found(sequences.by_block(df, max_piece=max_piece, sep=" ")) == expected(lambda r: r[2])
    assert found(sequences.by_session(df, max_piece=max_piece, sep=" ")) == expected(lambda r: r[4])
    by_time = sequences.by_time_gap(df.drop("session_id"), "t", time_window_seconds=10, max_piece=max_piece, sep=" ")
    assert found(by_time) == expected(lambda r: "0", lambda r: (r[3], r[0]))
    nulls = df.withColumn("event_id", F.when(F.col("line_id") < 14, F.col("event_id")))
    assert found(sequences.by_block(nulls, max_piece=max_piece, sep=" "))["b0"][0] == "e0 e2 e4 e6 e8 e10 e12"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_block_labels_are_looked_up_once_for_each_sequence(spark, monkeypatch):
    given, real = [], logs.label_by_block
    monkeypatch.setattr(logs, "label_by_block", lambda df, *more: given.append(df.columns) or real(df, *more))
    seqs = block_log_sequences(spark, "/root/testdata/sf0.001")
    assert {r.label for r in seqs.select("label").distinct().collect()} == {0, 1}
    assert len(given) == 1 and "events" in given[0]
