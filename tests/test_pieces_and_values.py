"""Counts that must not depend on how long sequences are cut, and values at their limits."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import explore, features, iforest, nextevent, sequences, split


def lines(spark):
    rows = [(k, f"b{k % 4}" if k < 100 else "long", f"e{k * k % 5}", int(k % 37 == 3 and k % 4 != 1)) for k in range(160)]
    return spark.createDataFrame(rows, "line_id BIGINT, block_id STRING, event_id STRING, label INT")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "name, measure",
    {
        "split_counts": lambda s: split.split_counts(split.stratified(s)),
        "normal_only_counts": split.normal_only_counts,
        "alignment": lambda s: split.alignment(s, s),
        "class_distribution": explore.class_distribution,
        "class_balance": explore.class_balance,
        "contamination": lambda s: explore.contamination(split.stratified(s)),
        "class_counts": sequences.class_counts,
        "length_stats": lambda s: explore.length_stats(s, "label"),
        "p95_length": features.p95_length,
        "statistics": lambda s: features.statistics(s).withColumn("entropy", F.round("entropy", 9)),
        "occurrence": features.occurrence,
        "occurrence_dense": lambda s: features.occurrence_dense(s, features.vocabulary(s)),
        "padded": lambda s: features.padded(s, features.vocabulary(s), 12, "tail"),
        "detect": lambda s: nextevent.detect(nextevent.fit(s, 2), s, 2),
        "misses": lambda s: nextevent.misses(nextevent.fit(s, 2), s, 2),
    }.items(),
)
def test_pieces_count_once(spark, name, measure):
    whole = sequences.by_block(lines(spark))
    cut = sequences.by_block(lines(spark), max_piece=7)
    assert cut.count() > whole.count()
    assert rows_of(measure(cut)) == rows_of(measure(whole))


def test_keyed_gaps_in_buckets(spark, monkeypatch):
    monkeypatch.setattr("tracemill.operators.order.BUCKET_ROWS", 3)
    rows = [(k, u, k * (3 if k % 5 else 100)) for k in range(60) for u in ("a", "b")]
    df = spark.createDataFrame(rows, "line_id BIGINT, user STRING, t BIGINT").withColumn("t", F.timestamp_seconds("t"))
    got = sequences.with_gap_session(df, "t", 10, "user").select("user", "line_id", "session_id").collect()
    for user in ("a", "b"):
        times = sorted((t, k) for k, u, t in rows if u == user)
        want, session = {}, 0
        for (t, k), (before, _) in zip(times, [(times[0][0], 0), *times]):
            session += t - before > 10
            want[k] = session
        assert {r.line_id: r.session_id for r in got if r.user == user} == want


@pytest.mark.parametrize("kind, anomalies", [("double", [1.0]), ("int", [1]), ("boolean", [True]), ("string", ["1", "Anomaly", "1.0", "true"]), ("decimal(5,2)", [1])])
def test_labels_of_any_type(spark, kind, anomalies):
    others = {"string": ["Normal", "0", "0.0", "false", "", None], "boolean": [False, None]}.get(kind, [0, None])
    for values, want in ((anomalies, 1), (others, 0)):
        df = spark.createDataFrame([(None if v is None else str(v),) for v in values], "v STRING").select(text.label_value(F.col("v").cast(kind)).alias("l"))
        assert {r.l for r in df.collect()} == {want}


def test_p_values_of_large_samples():
    for freedom in (9.9e5, 1.1e6, 1e9, 1e12, 1e15):
        assert explore.two_sided_p(2.0, freedom) == pytest.approx(0.0455002638963584, rel=1e-5)
        assert explore.two_sided_p(-2.0, freedom) == explore.two_sided_p(2.0, freedom)
    assert explore.two_sided_p(2.0, 1.1e6) == pytest.approx(explore.two_sided_p(2.0, 0.99e6), rel=1e-6)


def test_forest_draws_by_hash_at_any_size(spark, monkeypatch):
    vector = F.array((F.col("id") % 97).cast("double"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("seq_id"), vector.alias("vector"))
    nodes = {}
    for factor in (0.2, 2.0, 1e9):
        monkeypatch.setattr(iforest, "DRAW_FACTOR", factor)
        forest = iforest.fit(rows, n_estimators=10, max_samples=64)
        nodes[factor] = sorted(map(tuple, forest.nodes.collect()))
    assert nodes[0.2] == nodes[2.0] == nodes[1e9]
