"""Next-event model: counts of what follows a context, with back-off to shorter contexts.

A sequence is anomalous when some event is not among the k most likely ones after the events before it.
The model is a table of ``(k, context, next, n, total, rank)`` for context lengths 0..order; the longest
context seen often enough decides. Everything is joins and aggregates over distinct (context, next) pairs,
which are few next to transitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.lookup import lookup
from tracemill.session import materialise

TOP_K = 9


def transitions(seqs: DataFrame, order: int) -> DataFrame:
    """``(seq_id, label, position, context, next)``: each event but the first with up to ``order`` before it.

    Pieces of a long sequence get the last ``order`` events of the piece before them; a piece is longer
    than any context, so one neighbour is enough. Sequences of one row need no join.
    """
    base = seqs.select("seq_id", "piece", "start", "events", "label", "length")
    whole = F.col("length") == F.size("events")
    no_head = F.array().cast("array<string>")
    short = base.where(whole).withColumn("_head", no_head)
    long = base.where(~whole)
    tails = long.select(
        "seq_id",
        (F.col("piece") + 1).alias("piece"),
        F.slice("events", F.greatest(F.lit(1), F.size("events") - order + 1), F.lit(max(order, 1))).alias("_head"),
    )
    pieced = long.join(tails, ["seq_id", "piece"], "left").withColumn("_head", F.coalesce("_head", no_head))
    both = short.unionByName(pieced.select(*short.columns))
    joined = both.select(
        "seq_id", "label", "start", F.size("_head").alias("_at"), F.concat("_head", "events").alias("_all")
    )
    # The first event of a sequence has nothing before it and is no target.
    first = F.greatest(F.lit(1), F.col("_at"))
    last = F.size("_all") - 1
    indexes = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    exploded = joined.withColumn("_i", F.explode(indexes))
    i = F.col("_i")
    return exploded.select(
        "seq_id",
        "label",
        (F.col("start") + i - F.col("_at")).alias("position"),
        F.slice("_all", F.greatest(F.lit(1), i - order + 1), F.least(F.lit(order), i)).alias("context"),
        F.element_at("_all", i + 1).alias("next"),
    )


def pairs(moves: DataFrame) -> DataFrame:
    """Distinct (context, next) with their number."""
    return moves.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))


def _suffixes(df: DataFrame, lowest: int) -> DataFrame:
    """One row per suffix of the context, of length ``lowest`` up to the whole."""
    size = F.size("context")
    lengths = F.when(size >= lowest, F.sequence(F.lit(lowest), size)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("k", F.explode(lengths)).withColumn(
        "suffix", F.slice("context", F.size("context") - F.col("k") + 1, F.col("k"))
    )


@dataclass
class NextEventModel:
    order: int
    min_count: int
    table: DataFrame  # k, context, next, n, total, rank
    events: int  # distinct next events, for smoothing

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/transitions")
        row = [(self.order, self.min_count, self.events)]
        self.table.sparkSession.createDataFrame(row, "order INT, min_count INT, events BIGINT").write.mode(
            "overwrite"
        ).parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NextEventModel:
        row = spark.read.parquet(f"{path}/model").first()
        return NextEventModel(row["order"], row["min_count"], spark.read.parquet(f"{path}/transitions"), row["events"])


def fit(seqs: DataFrame, order: int = 3, min_count: int = 1) -> NextEventModel:
    """Learn from sequences, which should be normal ones. Contexts need ``min_count`` observations."""
    seen = pairs(transitions(seqs, order))
    counted = (
        _suffixes(seen, 0)
        .groupBy("k", F.col("suffix").alias("context"), "next")
        .agg(F.sum("n").alias("n"))
    )
    # A window partition holds the successors of one context, at most the number of distinct events.
    of_context = Window.partitionBy("k", "context")
    table = (
        counted.withColumn("total", F.sum("n").over(of_context))
        .where((F.col("total") >= min_count) | (F.col("k") == 0))
        .withColumn("rank", F.row_number().over(of_context.orderBy(F.desc("n"), "next")))
    )
    stored = materialise(table)
    return NextEventModel(order, min_count, stored, stored.where(F.col("k") == 0).count())


def topk(model: NextEventModel, k: int = TOP_K) -> DataFrame:
    """The k most likely next events of each context with their probability."""
    return model.table.where(F.col("rank") <= k).select(
        "context", "rank", "next", (F.col("n") / F.col("total")).alias("probability")
    )


def predict(model: NextEventModel, contexts: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k predictions for rows with a ``context`` column, from the longest known suffix."""
    chosen = _chosen(model, contexts.select("context").distinct())
    joined = chosen.join(
        model.table.where(F.col("rank") <= k).select(
            "k", F.col("context").alias("suffix"), "rank", "next", (F.col("n") / F.col("total")).alias("probability")
        ),
        ["k", "suffix"],
    )
    return joined.select("context", "rank", "next", "probability")


def _chosen(model: NextEventModel, contexts: DataFrame) -> DataFrame:
    """The longest suffix of each distinct context that the model knows: ``(context, k, suffix)``."""
    clipped = contexts.withColumn(
        "_full", F.slice("context", F.greatest(F.lit(1), F.size("context") - model.order + 1), F.lit(max(model.order, 1)))
    )
    if model.order == 0:
        clipped = clipped.withColumn("_full", F.array().cast("array<string>"))
    known = model.table.where(F.col("k") > 0).select("k", F.col("context").alias("suffix")).distinct()
    # Length 0 always exists, so it takes part in no join.
    longest = (
        _suffixes(clipped.select(F.col("context").alias("_context"), F.col("_full").alias("context")), 1)
        .join(known, ["k", "suffix"], "left_semi")
        .groupBy("_context")
        .agg(F.max("k").alias("k"))
    )
    found = clipped.join(longest, F.col("context") == F.col("_context"), "left").withColumn("k", F.coalesce("k", F.lit(0)))
    suffix = F.when(
        F.col("k") > 0, F.slice("_full", F.size("_full") - F.col("k") + 1, F.greatest(F.lit(1), F.col("k")))
    ).otherwise(F.array().cast("array<string>"))
    return found.select("context", "k", suffix.alias("suffix"))


def judged(model: NextEventModel, moves: DataFrame, k: int = TOP_K) -> DataFrame:
    """Distinct (context, next) with the context length used, counts and ``miss``: 1 outside the top k."""
    seen = pairs(moves)
    chosen = _chosen(model, seen.select("context").distinct())
    totals = model.table.where("rank = 1").select("k", F.col("context").alias("suffix"), "total")
    hits = model.table.select(
        "k", F.col("context").alias("suffix"), "next", F.col("n").alias("n_model"), "rank"
    )
    return (
        seen.join(chosen.join(totals, ["k", "suffix"], "left"), "context")
        .join(hits, ["k", "suffix", "next"], "left")
        .select(
            "context",
            "next",
            "n",
            "k",
            F.coalesce("n_model", F.lit(0)).alias("n_model"),
            F.coalesce("total", F.lit(0)).alias("total"),
            "rank",
            F.when(F.col("rank") <= k, 0).otherwise(1).alias("miss"),
        )
    )


def loss(model: NextEventModel, seqs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Mean cross-entropy of the actual next events, with additive smoothing over the known events."""
    each = judged(model, transitions(seqs, model.order))
    p = (F.col("n_model") + F.lit(alpha)) / (F.col("total") + F.lit(alpha * (model.events + 1)))
    return each.agg(F.try_divide(F.sum(-F.log(p) * F.col("n")), F.sum("n").cast("double")).alias("loss"))


def with_misses(model: NextEventModel, moves: DataFrame, k: int = TOP_K) -> DataFrame:
    """Transitions with ``miss``. Each distinct pair is judged once; verdicts are looked up by pair."""
    verdicts = materialise(
        judged(model, moves, k).select(F.struct("context", "next").alias("_pair"), "n", "miss")
    )
    keyed = moves.withColumn("_pair", F.struct("context", "next")).withColumn("_spread", F.xxhash64("seq_id", "position"))
    return lookup(keyed, verdicts, "_pair", "n", "_spread").drop("_pair", "_spread")


def misses(model: NextEventModel, seqs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Each unexpected event with its position, the context and what was expected instead."""
    missed = materialise(with_misses(model, transitions(seqs, model.order), k).where("miss = 1").drop("miss"))
    counted = missed.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    expected = predict(model, counted, k).groupBy("context").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "next"))), lambda p: p["next"]).alias("expected")
    )
    weighed = materialise(counted.join(expected, "context"))
    spread = missed.withColumn("_spread", F.xxhash64("seq_id", "position"))
    return lookup(spread, weighed, "context", "n", "_spread").select("seq_id", "label", "position", "context", "next", "expected")


def detect(model: NextEventModel, seqs: DataFrame, k: int = TOP_K) -> DataFrame:
    """``(seq_id, label, pred, misses, transitions)``; sequences of one event are never anomalous."""
    each = with_misses(model, transitions(seqs, model.order), k).select(
        "seq_id", "label", F.col("miss").cast("long").alias("miss"), F.lit(1).cast("long").alias("one")
    )
    zero = F.lit(0).cast("long")
    rows = seqs.where(F.col("start") == 0).select("seq_id", "label", zero.alias("miss"), zero.alias("one"))
    return rows.unionByName(each).groupBy("seq_id", "label").agg(
        F.max("miss").cast("int").alias("pred"), F.sum("miss").alias("misses"), F.sum("one").alias("transitions")
    )


def select(
    train: DataFrame, val: DataFrame, max_order: int = 10, patience: int = 5, min_count: int = 1
) -> tuple[NextEventModel, list[dict]]:
    """The context length with the lowest validation loss; stops after ``patience`` lengths without gain."""
    best, best_loss, history, waited = None, float("inf"), [], 0
    for order in range(0, max_order + 1):
        model = fit(train, order, min_count)
        value = loss(model, val).first()["loss"]
        history.append({"order": order, "val_loss": value})
        if best is None or (value is not None and value < best_loss):
            best, best_loss, waited = model, value if value is not None else float("inf"), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history
