"""Isolation forest: trees grow level by level as aggregates over small hash samples, scoring is one pass over the rows.

Rows are ``(seq_id, vector)``: ``vector`` is ARRAY<DOUBLE>, or sparse, ARRAY<STRUCT<index, value>> with its non-zero entries.
Every random choice is a hash of the seed and of what it is for (row and tree, node, feature), so a forest depends on the
rows alone, not on how they are partitioned, and SQL can say the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.operators import explore, metrics
from tracemill.session import materialise, stored

EULER_GAMMA = 0.5772156649015329
# Rows that a tree's hash cut lets through on average, for each row that the tree takes.
DRAW_FACTOR = 2.0
# Row draws are a * row + b modulo this prime, with a and b of each tree.
PRIME = (1 << 31) - 1
HASH_BITS = 60
# Path lengths are added up in whole units of this share of an edge, so sums do not depend on their order.
PATH_UNIT = 1 << 32
NODES = "tree int, node int, feature int, threshold double, size int, depth int"
# Cells of the table that one scoring step fills.
CELLS_AT_ONCE = 1 << 22


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass
class IsolationForest:
    nodes: DataFrame  # at most n_estimators * (2 * max_samples - 1) rows
    n_estimators: int
    sample_size: int
    offset: float

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        row = [(self.n_estimators, self.sample_size, self.offset)]
        self.nodes.sparkSession.createDataFrame(
            row, "n_estimators INT, sample_size INT, offset DOUBLE"
        ).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        row = spark.read.parquet(f"{path}/model").first()
        return IsolationForest(
            spark.read.parquet(f"{path}/nodes"), row["n_estimators"], row["sample_size"], row["offset"]
        )


def _hash(*parts: Column | str | int) -> Column:
    """60 bits of the MD5 of the parts, joined by slashes."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def is_sparse(rows: DataFrame) -> bool:
    return isinstance(rows.schema["vector"].dataType.elementType, StructType)


def _entries(sparse: bool) -> Column:
    """The non-zero entries of a vector."""
    if sparse:
        return F.filter("vector", lambda x: x["value"] != 0)
    return F.filter(F.transform("vector", lambda v, at: F.struct(at.alias("index"), v.alias("value"))), lambda x: x["value"] != 0)


def _drawn(rows: DataFrame, n_estimators: int, seed: int, share: float) -> DataFrame:
    """(seq_id, entries, tree, _draw): each row for the trees whose draw of it falls below ``share`` of the range.

    Trees are tested within the row, so only drawn rows are copied.
    """
    factors = [(F.lit(1) + F.pmod(_hash(seed, "a", t), F.lit(PRIME - 1)), F.pmod(_hash(seed, "b", t), F.lit(PRIME))) for t in range(n_estimators)]
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), a.alias("a"), b.alias("b")) for t, (a, b) in enumerate(factors)])
    drawn = F.transform(trees, lambda t: F.struct(t["tree"].alias("tree"), F.pmod(F.col("_row") * t["a"] + t["b"], F.lit(PRIME)).alias("_draw")))
    cut = math.ceil(min(1.0, share) * PRIME)
    numbered = rows.withColumn("_row", F.pmod(_hash(F.col("seq_id")), F.lit(PRIME)))
    # Few rows are drawn at all; the others go before an array of their draws is made.
    draws = [F.pmod(F.col("_row") * a + b, F.lit(PRIME)) for a, b in factors]
    numbered = numbered.where((F.least(*draws) if len(draws) > 1 else draws[0]) < F.lit(cut))
    return numbered.select("seq_id", "entries", F.explode(F.filter(drawn, lambda t: t["_draw"] < F.lit(cut))).alias("t")).select("seq_id", "entries", "t.*")


def _allowed(seed: int, n_estimators: int, width: int, max_features: float) -> DataFrame | None:
    """(tree, index) of the features that each tree may split on; None if it may on all."""
    if max_features >= 1.0:
        return None
    spark = SparkSession.getActiveSession()
    every = spark.range(width).select(F.col("id").cast("int").alias("index")).crossJoin(F.broadcast(spark.range(n_estimators).select(F.col("id").cast("int").alias("tree"))))
    order = Window.partitionBy("tree").orderBy(_hash(seed, "feature", F.col("tree").cast("string"), F.col("index").cast("string")), "index")
    return stored(every.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(1, round(max_features * width))).drop("_rank"))


def _level(at: DataFrame, seed: int, allowed: DataFrame | None) -> DataFrame:
    """(tree, node, size, feature, threshold) of the nodes of ``at`` (tree, node, entries); no feature where none varies.

    An entry that a row does not have is 0. The feature is the varying one with the smallest hash.
    """
    # Entry -1 counts the rows of a node.
    entries = F.concat("entries", F.array(F.struct(F.lit(-1).alias("index"), F.lit(0.0).alias("value"))))
    held = at.select("tree", "node", F.explode(entries).alias("e")).groupBy("tree", "node", F.col("e.index").alias("index"))
    ranges = held.agg(F.min("e.value").alias("low"), F.max("e.value").alias("high"), F.count(F.lit(1)).cast("int").alias("n"))
    size = F.max(F.when(F.col("index") == -1, F.col("n"))).over(Window.partitionBy("tree", "node"))
    ranges = ranges.withColumn("size", size)
    some = F.col("n") < F.col("size")
    ranges = ranges.withColumns({"low": F.when(some, F.least("low", F.lit(0.0))).otherwise(F.col("low")), "high": F.when(some, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))})
    varies = F.col("high") > F.col("low")
    if allowed is not None:
        ranges = ranges.join(allowed.withColumn("_open", F.lit(True)), ["tree", "index"], "left")
        varies = varies & F.col("_open").isNotNull()
    text = [F.col(c).cast("string") for c in ("tree", "node", "index")]
    first = F.min(F.when(varies, F.struct(_hash(seed, *text).alias("h"), "index", "low", "high")))
    picked = ranges.groupBy("tree", "node").agg(F.max("size").alias("size"), first.alias("p"))
    part = _hash(seed, *text[:2]).cast("double") / F.lit(float(1 << HASH_BITS))
    return picked.select("tree", "node", "size", F.col("p.index").alias("feature"), (F.col("p.low") + part * (F.col("p.high") - F.col("p.low"))).alias("threshold"))


def _grown(sample: DataFrame, size: int, seed: int, allowed: DataFrame | None) -> DataFrame:
    """The nodes of all trees over stored ``sample`` (tree, entries). Children of node i are 2i+1 and 2i+2."""
    at, nodes = sample.withColumn("node", F.lit(0)), None
    limit = math.ceil(math.log2(max(size, 2)))
    for depth in range(limit + 1):
        if depth < limit:
            level = stored(_level(at, seed, allowed))
            value = F.coalesce(F.element_at(F.map_from_entries("entries"), F.col("feature")), F.lit(0.0))
            # At most n_estimators * max_samples nodes.
            moved = at.join(F.broadcast(level.where("feature IS NOT NULL").drop("size")), ["tree", "node"])
            at = moved.select("tree", "entries", (2 * F.col("node") + 1 + (value > F.col("threshold")).cast("int")).alias("node"))
        else:
            none = {"feature": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double")}
            level = stored(at.groupBy("tree", "node").agg(F.count(F.lit(1)).cast("int").alias("size")).withColumns(none))
        level = level.select(
            "tree", "node", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "size", F.lit(depth).alias("depth")
        )
        nodes = level if nodes is None else nodes.union(level)
    return nodes


def fit(
    vectors: DataFrame,
    n_estimators: int = 100,
    max_samples: int = 256,
    contamination: float | str = "auto",
    seed: int = 42,
    max_features: float = 1.0,
    key: str = "seq_id",
) -> IsolationForest:
    """Fit on ``(key, vector)`` rows; labels are not used.

    Every tree takes the ``max_samples`` rows with its smallest draws, whatever the number of rows: a cut on the draw lets
    twice as many through, and would be raised should a tree get too few. ``max_features`` is the share of features that a
    tree may split on.
    """
    sparse = is_sparse(vectors)
    rows = vectors.select(F.col(key).cast("string").alias("seq_id"), "vector")
    width = F.max(F.array_max(F.transform("vector", lambda x: x["index"])) + 1) if sparse else F.max(F.size("vector"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(width, F.lit(0)).alias("width")).first()
    if seen.n == 0:
        raise ValueError("cannot fit a forest on no rows")
    size = min(max_samples, seen.n)
    entries = F.transform(_entries(sparse), lambda x: F.struct(x["index"].cast("int").alias("index"), x["value"].cast("double").alias("value")))
    whole = rows.select("seq_id", entries.alias("entries"))
    factor = DRAW_FACTOR
    first = Window.partitionBy("tree").orderBy("_draw", "seq_id")
    while True:
        drawn = _drawn(whole, n_estimators, seed, factor * size / seen.n).withColumn("_rank", F.row_number().over(first))
        sample = stored(drawn.where(F.col("_rank") <= size).select("tree", "entries"))
        if factor * size >= seen.n or sample.count() == size * n_estimators:
            break
        factor *= 4
    nodes = _grown(sample, size, seed, _allowed(seed, n_estimators, seen.width, max_features))
    forest = IsolationForest(nodes, n_estimators, size, -0.5)
    if contamination != "auto":
        # The threshold is a percentile of all training scores.
        forest.offset = explore.quantiles(_raw(forest, rows), "_raw", [float(contamination)]).first()["q0"]
    return forest


def _arrays(forest: IsolationForest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node tables as arrays [tree, node]: feature (-1 in leaves), threshold, path length in units.

    The size is fixed by the parameters: trees times nodes of a tree.
    """
    table = forest.nodes.toPandas()
    width = int(table["node"].max()) + 1
    feature = np.full((forest.n_estimators, width), -1, dtype=np.int64)
    threshold = np.zeros((forest.n_estimators, width))
    path = np.zeros((forest.n_estimators, width), dtype=np.int64)
    at = (table["tree"].to_numpy(), table["node"].to_numpy())
    feature[at] = table["feature"]
    threshold[at] = table["threshold"]
    path[at] = np.round((table["depth"].to_numpy() + average_path(table["size"].to_numpy())) * PATH_UNIT).astype(np.int64)
    return feature, threshold, path


def _raw(forest: IsolationForest, vectors: DataFrame) -> DataFrame:
    """Add ``_raw`` = -2^(-mean path / average path of the sample size)."""
    feature, threshold, path = _arrays(forest)
    scale = float(average_path(forest.sample_size)) or 1.0
    # Only the features that some node asks for are looked at.
    used = np.unique(feature[feature >= 0])
    column = np.searchsorted(used, feature)

    def walked(x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for t in range(len(feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[t, node] >= 0).any():
                right = x[rows, np.where(inner, column[t, node], 0)] > threshold[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[t, node]
        return -np.power(2.0, -(total / len(feature) / PATH_UNIT / scale))

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        step = max(1, CELLS_AT_ONCE // (len(used) + 1))
        for indices, values in batches:
            out = []
            for k in range(0, len(values), step):
                own = [np.asarray(v, dtype=np.float64) for v in values.iloc[k : k + step]]
                at = [np.asarray(v, dtype=np.int64) for v in indices.iloc[k : k + step]]
                row = np.repeat(np.arange(len(own)), [len(v) for v in own])
                at, own = np.concatenate(at), np.concatenate(own)
                place = np.searchsorted(used, at)
                known = place < len(used)
                known[known] = used[place[known]] == at[known]
                x = np.zeros((int(len(values.iloc[k : k + step])), len(used) + 1))
                x[row[known], place[known]] = own[known]
                out.append(walked(x))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    entries = _entries(is_sparse(vectors))
    parts = [F.transform(entries, lambda x: x["index"].cast("long")), F.transform(entries, lambda x: x["value"].cast("double"))]
    return vectors.withColumn("_raw", F.pandas_udf(score, "double")(*parts))


def decision(forest: IsolationForest, vectors: DataFrame) -> DataFrame:
    """Add ``score`` (negative means anomaly) and ``pred``."""
    scored = _raw(forest, vectors).withColumn("score", F.col("_raw") - F.lit(float(forest.offset))).drop("_raw")
    return scored.withColumn("pred", F.when(F.col("score") < 0, 1).otherwise(0))


def score(forest: IsolationForest, vectors: DataFrame) -> DataFrame:
    """Add ``score``, ``pred`` and ``proba`` in [0, 1], higher for more anomalous; scored once and stored."""
    return metrics.min_max_flipped(materialise(decision(forest, vectors.drop("score", "pred", "proba"))))
