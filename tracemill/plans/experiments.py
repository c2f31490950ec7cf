"""End-to-end detection experiments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import explore, features, iforest, matching, metrics, nextevent, sequences, split
from tracemill.session import broadcast_if_small, materialise, stored


@dataclass
class Result:
    model: Any
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame  # one row: configuration and metrics


def vectors_of(seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse occurrence vectors ``(seq_id, label, vector)``: (index, value) of the events that a sequence has.

    The index is that of the vocabulary; sequences without a known event have an empty vector. No row is as wide as the
    vocabulary.
    """
    counted = (
        seqs.select("seq_id", "label", F.explode_outer("events").alias("event"))
        .groupBy("seq_id", "label", "event")
        .agg(F.count("event").cast("double").alias("value"))
        .join(broadcast_if_small(vocab.select("event", "idx"), features.BROADCAST_VOCABULARY), "event", "left")
    )
    entry = F.when(F.col("idx").isNotNull(), F.struct(F.col("idx").alias("index"), "value"))  # NULL entries are not collected
    return counted.groupBy("seq_id", "label").agg(F.sort_array(F.collect_list(entry)).alias("vector"))


def wide_vectors(wide: DataFrame, events: Sequence[str]) -> DataFrame:
    """Vectors from a wide occurrence matrix: ids and labels dropped, event columns kept."""
    columns = [F.col(f"`{e}`").cast("double") for e in events]
    return wide.select("seq_id", "label", F.array(*columns).alias("vector"))


def forest_experiment(
    vectors: DataFrame,
    ratios: tuple[float, float, float] = (0.6, 0.2, 0.2),
    n_estimators: int = 100,
    seed: int = 42,
    dataset: str = "",
) -> Result:
    """Split, fit an isolation forest with the training anomaly share as contamination, test."""
    parts = materialise(split.stratified(vectors, ratios=ratios, seed=seed))
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    share = explore.contamination(parts).first()["contamination"]
    forest = iforest.fit(train, n_estimators=n_estimators, contamination=share, seed=seed)
    scored = iforest.score(forest, test)
    evaluated = metrics.evaluate(scored, score="proba")
    sizes = parts.agg(
        F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size")
    )
    report = evaluated.select(
        F.lit(dataset).alias("dataset"),
        F.lit("Isolation Forest").alias("model"),
        F.lit(n_estimators).alias("n_estimators"),
        F.lit(float(share)).alias("contamination"),
        sizes.select("train_size").scalar().alias("train_size"),
        sizes.select("test_size").scalar().alias("test_size"),
        F.struct(*evaluated.columns).alias("metrics"),
    )
    return Result(forest, scored, evaluated, report)


def next_event_experiment(
    seqs: DataFrame,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    top_k: int = 4,
    order: int | None = None,
    max_order: int = 10,
    patience: int = 5,
    seed: int = 42,
    dataset: str = "",
) -> Result:
    """Split, learn from normal training sequences, choose the context length on validation loss, test."""
    # The split reads its input three times; sequences are assembled once.
    parts = materialise(split.stratified(stored(seqs), ratios=ratios, seed=seed))
    train = split.normal_only(parts.where("split = 'train'"))
    val, test = parts.where("split = 'val'"), parts.where("split = 'test'")
    if order is None:
        model, history = nextevent.select(train, val, max_order, patience)
        best = min(h["val_loss"] for h in history if h["val_loss"] is not None)
    else:
        model, best = nextevent.fit(train, order), None
    detected = materialise(nextevent.detect(model, test, top_k))
    evaluated = metrics.evaluate(detected)
    report = evaluated.select(
        F.lit(dataset).alias("dataset"),
        F.lit("next event").alias("model"),
        F.lit(model.order).alias("context_length"),
        F.lit(best).cast("double").alias("best_val_loss"),
        F.lit(top_k).alias("top_k"),
        features.p95_length(train).scalar().alias("max_sequence_length"),
        F.struct(*evaluated.columns).alias("metrics"),
    )
    return Result(model, detected, evaluated, report)


def cross_dataset_next_event(train_seqs: DataFrame, other_seqs: DataFrame, order: int = 3, top_k: int = 4) -> Result:
    """Learn from the normal sequences of one dataset and test on another."""
    model = nextevent.fit(split.normal_only(train_seqs), order)
    detected = materialise(nextevent.detect(model, other_seqs, top_k))
    evaluated = metrics.evaluate(detected)
    return Result(model, detected, evaluated, evaluated)


def cross_catalogue_next_event(
    train_seqs: DataFrame, known: DataFrame, lines: DataFrame, catalogue: DataFrame, least: float = 0.5, order: int = 3, top_k: int = 4
) -> Result:
    """Learn from the normal sequences of one dataset and test on another that has other event ids.

    ``known`` and ``catalogue`` (event_id, event_template) are the templates of the two. The events of ``lines`` (line_id,
    block_id, event_id, label) take the id of the most similar known template; others are unknown to the model.
    """
    translated = matching.in_known_events(lines, matching.aligned(catalogue, known, least))
    return cross_dataset_next_event(train_seqs, sequences.by_block(translated), order, top_k)


def cross_dataset_forest(train_seqs: DataFrame, other_seqs: DataFrame, n_estimators: int = 100, seed: int = 42) -> Result:
    """Fit on one dataset's occurrence vectors, score another's in the same vocabulary; unknown events are counted."""
    vocab = features.vocabulary(train_seqs)
    share = train_seqs.where("start = 0").agg(F.avg("label")).first()[0]
    forest = iforest.fit(vectors_of(train_seqs, vocab), n_estimators=n_estimators, contamination=share, seed=seed)
    unknown = features.encode(other_seqs, vocab).groupBy("seq_id").agg(F.sum("oov_count").alias("oov_count"))
    scored = iforest.score(forest, vectors_of(other_seqs, vocab)).join(unknown, "seq_id")
    evaluated = metrics.evaluate(scored, score="proba")
    return Result(forest, scored, evaluated, evaluated)
