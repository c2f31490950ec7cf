import random

import pytest
from pyspark.sql import functions as F

from tests_helpers import brute_detect, seqs_of
from tracemill.operators import iforest, metrics, nextevent, sequences, split


def test_split_is_disjoint_complete_and_stratified(spark):
    rows = [(f"s{k}", int(k % 9 == 0)) for k in range(500)]
    df = spark.createDataFrame(rows, "seq_id STRING, label INT").repartition(6)
    out = split.stratified(df, ratios=(0.6, 0.2, 0.2)).collect()
    assert sorted(r.seq_id for r in out) == sorted(s for s, _ in rows)
    for label in (0, 1):
        size = sum(y == label for _, y in rows)
        for name, ratio in (("train", 0.6), ("val", 0.2), ("test", 0.2)):
            assert abs(sum(r.split == name and r.label == label for r in out) - ratio * size) <= 1
    other = {r.seq_id: r.split for r in split.stratified(df, ratios=(0.6, 0.2, 0.2), seed=7).collect()}
    assert any(other[r.seq_id] != r.split for r in out)
    with pytest.raises(ValueError):
        split.stratified(df, ratios=(0.6, 0.3, 0.2))


def test_split_extremes(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "seq_id STRING, label INT")
    assert {r.split for r in split.stratified(df, ratios=(0.0, 0.0, 1.0)).collect()} == {"test"}
    assert {r.split for r in split.stratified(df, ratios=(1.0, 0.0, 0.0)).collect()} == {"train"}


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.5)] * 4, "label INT, pred INT, score DOUBLE")
    row = metrics.evaluate(df, score="score").first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.auc) == (1.0, 0.0, 0.0, 0.0, 0.0)
    assert (row.tn, row.fp, row.fn, row.tp) == (4, 0, 0, 0)


def test_auc_counts_ties_half(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(2), round(rnd.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label INT, score DOUBLE")
    assert metrics.roc_auc(df).first().auc == pytest.approx(expected)
    assert metrics.roc_auc(df.withColumn("score", -F.col("score"))).first().auc == pytest.approx(1 - expected)
    points = metrics.roc_points(df).orderBy(F.desc("threshold")).collect()
    for p in points:
        assert p.tpr == pytest.approx(sum(s >= p.threshold for s in pos) / len(pos))
        assert p.fpr == pytest.approx(sum(s >= p.threshold for s in neg) / len(neg))


def test_min_max_of_constant_scores(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "score DOUBLE")
    assert [r.proba for r in metrics.min_max_flipped(df).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("order", [0, 1, 3])
def test_detection_matches_brute_force(spark, order):
    rnd = random.Random(order)
    lists = [[rnd.choice("abcd" if rnd.random() < 0.9 else "xyz") for _ in range(rnd.randrange(1, 12))] for _ in range(60)]
    train, test = lists[:40], lists[40:] + [["a"], ["new", "a", "b"], ["a", "new"]]
    model = nextevent.fit(seqs_of(spark, train), order)
    seqs = seqs_of(spark, test)
    previous = None
    for k in (1, 2, 4):
        got = {r.seq_id: (r.pred, r.misses) for r in nextevent.detect(model, seqs, k).collect()}
        assert got == {f"s{n}": brute_detect(train, events, order, k) for n, events in enumerate(test)}
        flagged = {s for s, (p, _) in got.items() if p}
        assert previous is None or flagged <= previous
        previous = flagged
        shown = nextevent.misses(model, seqs, k).collect()
        assert len(shown) == sum(m for _, m in got.values())
        assert all(r.next not in r.expected and len(r.expected) <= k for r in shown)


def test_contexts_cross_pieces(spark):
    df = spark.createDataFrame([(k, f"e{k * k % 7}", f"blk_{k % 2}") for k in range(120)], "line_id BIGINT, event_id STRING, content STRING")
    show = lambda d: sorted((r.seq_id, r.position, tuple(r.context), r.next) for r in nextevent.transitions(d, 3).collect())
    assert show(sequences.by_block(df, max_piece=5)) == show(sequences.by_block(df))


def test_model_selection_and_storage(spark, tmp_path):
    train = seqs_of(spark, [list("abcabcabc")] * 5)
    val = seqs_of(spark, [list("bcabca")])
    model, history = nextevent.select(train, val, max_order=4, patience=2)
    losses = [h["val_loss"] for h in history]
    assert model.order == losses.index(min(losses)) and losses[1] < losses[0]
    model.save(str(tmp_path / "m"))
    again = nextevent.NextEventModel.load(spark, str(tmp_path / "m"))
    assert nextevent.loss(again, val).first() == nextevent.loss(model, val).first()


def vectors(spark, outliers=5):
    rnd = random.Random(0)
    rows = [(f"n{k}", [rnd.gauss(0, 1) for _ in range(4)]) for k in range(500)]
    rows += [(f"out{k}", [rnd.choice((-1, 1)) * rnd.uniform(8, 10) for _ in range(4)]) for k in range(outliers)]
    return spark.createDataFrame(rows, "seq_id STRING, vector ARRAY<DOUBLE>")


def test_forest_ranks_planted_outliers_first(spark, tmp_path):
    df = vectors(spark)
    forest = iforest.fit(df, contamination=0.01)
    assert forest.nodes.count() <= 100 * (2 * 256 - 1)
    scored = iforest.score(forest, df).orderBy("score").collect()
    assert {r.seq_id for r in scored[:5]} == {f"out{k}" for k in range(5)}
    assert (scored[0].proba, scored[-1].proba) == (1.0, 0.0)
    assert sum(r.pred for r in scored) == pytest.approx(5, abs=1)
    forest.save(str(tmp_path / "f"))
    again = iforest.score(iforest.IsolationForest.load(spark, str(tmp_path / "f")), df).orderBy("score").collect()
    assert [(r.seq_id, r.score) for r in again] == [(r.seq_id, r.score) for r in scored]


def test_forest_does_not_depend_on_partitioning(spark):
    df = vectors(spark, 0)
    a = {r.seq_id: r.score for r in iforest.score(iforest.fit(df.repartition(1), 20), df).collect()}
    b = {r.seq_id: r.score for r in iforest.score(iforest.fit(df.repartition(7), 20), df).collect()}
    assert a == b
