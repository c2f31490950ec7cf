"""Hard negatives of anchors, found by a GNAT-style multiway hyperplane tree.

A node of the tree has up to ``ARITY`` split points, chosen far from each other; a row belongs to the child of its nearest
split point (the first of equally near ones). For each split point and each sibling subtree the node stores the range of
distances from the one to all rows of the other. The split points come from a sample of at most ``SAMPLE`` rows; every row is
indexed, and the ranges are taken over all rows.

A query is an anchor with windows of scores (inner products). With |a - b|^2 = |a|^2 + |b|^2 - 2 a.b and the norms of a subtree's
rows, a window of scores is an annulus of distances around the anchor. A subtree is eliminated when, for some split point,
no distance in its range is one that a row of the annulus could have. What is left are leaves, whose rows are scored exactly.
Each query first reads the leaf that comes closest below the upper end of its window; the score of the last wanted row there
raises the lower end of the window for all other leaves.

Neighbouring leaves share a bin of about ``BLOCK_ROWS`` rows, and a leaf of more is a bin that is dealt into several blocks. The
queries of a bin are dealt into chunks of about ``CHUNK_QUERIES``; one block meets one chunk in one task, where each query
reads the leaves that it has not eliminated. So neither a large leaf nor a popular one gathers in one place, and a query
takes as many rows from a bin as it wants, not from each leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import stored

ARITY = 16
SAMPLE = 4096
LEAF_ROWS = 1024
# A node with fewer sampled rows than this is not split further.
LEAST_SAMPLE = 3 * ARITY
BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
# Queries whose scores with a block are held at once.
QUERIES_AT_ONCE = 256
# Squared distances are exact in floating point below this.
EXACT = 2**53

WINDOWS = "array<struct<need:long,low:long,high:long>>"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact for whole numbers."""
    return _squares(x)[:, None] + _squares(points)[None, :] - 2 * (x @ points.T)


@dataclass
class Node:
    points: np.ndarray
    # Index of a node, or -1 - leaf.
    children: list[int]
    # low[i, j], high[i, j]: distances from split point i to the rows of child j.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    width: int
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0
    # Of each leaf: rows, least and greatest squared norm, bin.
    rows: np.ndarray | None = None
    norms: np.ndarray | None = None
    bins: np.ndarray | None = None

    def place(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row; ``seen(node, squared distances, child of each row)`` is told of every step."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            squared = _distances(x[rows], node.points)
            child = squared.argmin(1)
            if seen is not None and len(rows):
                seen(at, squared, child)
            for j, to in enumerate(node.children):
                part = rows[child == j]
                if to < 0:
                    leaf[part] = -1 - to
                elif len(part):
                    todo.append((to, part))
        return leaf

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each query can have with the rows of each leaf; least > greatest in empty leaves."""
        near, far = (np.zeros((len(a), self.leaves)), np.full((len(a), self.leaves), np.inf))
        todo = [(0, np.zeros(len(a)), np.full(len(a), np.inf))] if self.nodes else []
        while todo:
            at, over, under = todo.pop()
            node = self.nodes[at]
            d = np.sqrt(np.maximum(_distances(a, node.points), 0))[:, :, None]
            least = np.maximum(over[:, None], np.maximum(d - node.high, node.low - d).max(1))
            most = np.minimum(under[:, None], (d + node.high).min(1))
            for j, to in enumerate(node.children):
                if to < 0:
                    near[:, -1 - to], far[:, -1 - to] = least[:, j], most[:, j]
                else:
                    todo.append((to, least[:, j], most[:, j]))
        own = _squares(a)[:, None]
        # Roots of whole numbers below 2**53 are wrong by less than this share.
        slack = 1e-9 * (own + self.norms[1]) + 1e-6
        greatest = (own + self.norms[1] - np.square(np.maximum(near, 0))) / 2 + slack
        least = (own + self.norms[0] - np.square(far)) / 2 - slack
        reach = np.sqrt(own * self.norms[1]) + slack
        greatest, least = np.minimum(greatest, reach), np.maximum(least, -reach)
        empty = self.rows == 0
        greatest[:, empty], least[:, empty] = -np.inf, np.inf
        return least, greatest


def _split_points(sample: np.ndarray) -> np.ndarray:
    """Up to ``ARITY`` rows of the sample, each the farthest from those before it."""
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < ARITY and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def grown(sample: np.ndarray, rows: int, leaf_rows: int) -> Tree:
    """A tree whose leaves will hold about ``leaf_rows`` of ``rows`` rows, as far as the sample goes."""
    tree = Tree(sample.shape[1])
    todo: list[tuple[np.ndarray, Node | None, int]] = [(sample, None, 0)]
    while todo:
        part, above, j = todo.pop(0)
        points = _split_points(part) if len(part) * rows > leaf_rows * len(sample) and (len(part) >= LEAST_SAMPLE or above is None) else part[:0]
        if len(points) < 2:
            if above is None:
                tree.nodes.append(Node(part[:1], [-1]))
            else:
                above.children[j] = -1 - tree.leaves
            tree.leaves += 1
            continue
        if above is not None:
            above.children[j] = len(tree.nodes)
        node = Node(points, [0] * len(points))
        tree.nodes.append(node)
        child = _distances(part, points).argmin(1)
        todo += [(part[child == k], node, k) for k in range(len(points))]
    return tree


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of float64."""
    data = vectors.buffers()[2]
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view("<i4").reshape(-1, width).astype(np.float64)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (id, label, vector array<long>) with the vector as ``width`` 32-bit numbers, filled up with zeros."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), width), "<i4")
            out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            raw = out.tobytes()
            packed = pa.array([raw[4 * width * k : 4 * width * (k + 1)] for k in range(len(lists))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "label", "vector"])

    return rows.mapInArrow(run, "id long, label string, vector binary")


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Add the leaf, the squared norm and a running number, by which leaves are dealt into blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        count = 0
        for batch in batches:
            x = _matrix(batch.column("vector"), shared.value.width)
            number = np.arange(count, count + len(x))
            count += len(x)
            columns = [*batch.columns, pa.array(shared.value.place(x), pa.int64()), pa.array(_squares(x).astype(np.int64)), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "vector", "leaf", "squared", "number"])

    return rows.mapInArrow(run, "id long, label string, vector binary, leaf long, squared long, number long")


def _with_ranges(tree: Tree, placed: DataFrame) -> Tree:
    """The tree with the ranges of distances and norms over all of ``placed``."""
    shared = placed.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        own = shared.value
        low = [np.full((len(n.children),) * 2, np.inf) for n in own.nodes]
        high = [np.full((len(n.children),) * 2, -np.inf) for n in own.nodes]

        def seen(at, squared, child):
            for j in np.unique(child):
                part = squared[child == j]
                low[at][:, j] = np.minimum(low[at][:, j], part.min(0))
                high[at][:, j] = np.maximum(high[at][:, j], part.max(0))

        for batch in batches:
            own.place(_matrix(batch.column(0), own.width), seen)
        for at in range(len(own.nodes)):
            i, j = np.nonzero(high[at] >= 0)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), at), pa.int64()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(low[at][i, j]), pa.array(high[at][i, j])],
                    ["node", "point", "child", "low", "high"],
                )

    parts = placed.select("vector").mapInArrow(run, "node long, point long, child long, low double, high double")
    # A row for each pair of siblings of the tree, whose size the sample bounds.
    ranges = parts.groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    for node in tree.nodes:
        node.low, node.high = (np.full((len(node.children),) * 2, x) for x in (np.inf, -np.inf))
    for r in ranges:
        tree.nodes[r.node].low[r.point, r.child], tree.nodes[r.node].high[r.point, r.child] = np.sqrt(r.low), np.sqrt(r.high)
    tree.rows, tree.norms = np.zeros(tree.leaves, np.int64), np.zeros((2, tree.leaves))
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("squared").alias("low"), F.max("squared").alias("high")).collect():
        tree.rows[r.leaf], tree.norms[:, r.leaf] = r.n, (r.low, r.high)
    tree.bins, filled = np.zeros(tree.leaves, np.int64), 0
    for leaf in range(1, tree.leaves):
        filled += tree.rows[leaf - 1]
        full = filled + tree.rows[leaf] > BLOCK_ROWS
        tree.bins[leaf] = tree.bins[leaf - 1] + full
        filled = 0 if full else filled
    return tree


def _leaves_of(queries: DataFrame, tree: Tree, first: bool) -> DataFrame:
    """A row of (key, id, label, vector, windows, leaves, bin) for each bin of which a query must read ``leaves``, with all of its windows;
    ``first``: the leaf to begin with, for each window."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    kept = ["key", "id", "label", "vector"]

    def run(batches):
        bins = shared.value.bins
        for whole in batches:
            for k in range(0, whole.num_rows, QUERIES_AT_ONCE):
                batch = whole.slice(k, QUERIES_AT_ONCE)
                windows = batch.column("windows").to_pylist()
                least, greatest = shared.value.bounds(_matrix(batch.column("vector"), shared.value.width))
                out: tuple[list, ...] = ([], [], [], [])
                for row, own in enumerate(windows):
                    alive = [np.flatnonzero((greatest[row] >= w["low"]) & (least[row] <= w["high"])) for w in own]
                    if first:
                        begun: dict[int, list] = {}
                        for w, at in zip(own, alive):
                            if len(at):
                                begun.setdefault(int(at[least[row][at].argmax()]), []).append(w)
                        reads = [(bins[leaf], [leaf], some) for leaf, some in begun.items()]
                    else:
                        left = np.unique(np.concatenate(alive)) if alive else np.zeros(0, np.int64)
                        reads = [(at, left[bins[left] == at].tolist(), own) for at in np.unique(bins[left])]
                    for at, leaves, some in reads:
                        for column, value in zip(out, (row, some, leaves, int(at))):
                            column.append(value)
                taken = batch.select(kept).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(out[1], batch.column("windows").type), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int64())],
                    [*kept, "windows", "leaves", "bin"],
                )

    return queries.select(*kept, "windows").mapInArrow(run, f"key long, id long, label string, vector binary, windows {WINDOWS}, leaves array<long>, bin long")


def _scored(pairs: DataFrame, placed: DataFrame, tree: Tree, same: bool, take: int) -> DataFrame:
    """(key, need, id, score): of each block the ``take`` best rows in each window of each query of stored ``pairs``."""
    spark = placed.sparkSession
    asked = {r.bin: r["count"] for r in pairs.groupBy("bin").count().collect()}  # at most a row for each bin
    held = np.bincount(tree.bins, tree.rows).astype(np.int64)
    shape = [(at, -(-int(held[at]) // BLOCK_ROWS), -(-n // CHUNK_QUERIES)) for at, n in asked.items()]
    # As many rows as leaves at most, which the sample bounds.
    shape = F.broadcast(spark.createDataFrame(shape, "bin long, blocks long, chunks long"))
    bins = F.broadcast(spark.createDataFrame(list(enumerate(tree.bins.tolist())), "leaf long, bin long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = pairs.join(shape, "bin").select(
        "bin", upto("blocks").alias("block"), F.pmod(F.xxhash64("key"), "chunks").alias("chunk"), "key", "id", "label", "vector", "windows", "leaves", none("long", "leaf")
    )
    right = placed.join(bins, "leaf").join(shape, "bin").select(
        "bin", F.pmod("number", "blocks").alias("block"), upto("chunks").alias("chunk"), none("long", "key"), "id", "label", "vector",
        none(WINDOWS, "windows"), none("array<long>", "leaves"), "leaf",
    )
    width = tree.width

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = lambda name: table.column(name).chunk(0)
        queries = one("key").is_valid().to_numpy(zero_copy_only=False)
        empty = pa.table({"key": pa.array([], pa.int64()), "need": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if queries.all() or not queries.any():
            return empty
        x, ids = _matrix(one("vector"), width), one("id").to_numpy(zero_copy_only=False)
        labels = one("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~queries)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        asking, keys, windows, reads = np.flatnonzero(queries), one("key"), one("windows"), one("leaves")
        leaf = one("leaf").fill_null(-1).to_numpy(zero_copy_only=False)[rows]
        first = leaf.min()
        alive = np.zeros(leaf.max() - first + 1, bool)
        found: tuple[list, ...] = ([], [], [], [])
        for k in range(0, len(asking), QUERIES_AT_ONCE):
            part = asking[k : k + QUERIES_AT_ONCE]
            scores = (x[part] @ x[rows].T).astype(np.int64)
            fits = ((labels[part][:, None] == labels[rows]) == same) & (ids[part][:, None] != ids[rows])
            for q, score, fit in zip(part.tolist(), scores, fits):
                some = np.array(reads[q].as_py()) - first
                alive[:] = False
                alive[some[(some >= 0) & (some < len(alive))]] = True
                fit &= alive[leaf - first]
                for w in windows[q].as_py():
                    at = np.flatnonzero(fit & (score >= w["low"]) & (score <= w["high"]))
                    if len(at) > take:
                        least = np.partition(score[at], len(at) - take)[len(at) - take]
                        at = at[score[at] >= least]
                    at = at[np.argsort(-score[at], kind="stable")][:take]
                    for column, values in zip(found, (np.full(len(at), keys[q].as_py()), np.full(len(at), w["need"]), ids[rows[at]], score[at])):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in found], ["key", "need", "id", "score"]) if found[0] else empty

    return left.unionByName(right).groupBy("bin", "block", "chunk").applyInArrow(run, "key long, need long, id long, score long")


def _best(found: DataFrame, take: int) -> DataFrame:
    """The ``take`` best rows of each window, by score and then id, with their ``rank``; as many per task go to the shuffle."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "need").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= take)


def search(queries: DataFrame, placed: DataFrame, tree: Tree, same: bool, take: int) -> DataFrame:
    """(key, need, id, score, rank): the ``take`` best rows of ``placed`` in each window of the stored ``queries`` (key, id, label, vector,
    windows), with the label of the query or (``same`` false) another, and not of its own id."""
    begun = _best(_scored(stored(_leaves_of(queries, tree, True)), placed, tree, same, take), take)
    raised = begun.where(F.col("rank") == take).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("need", "score"))).alias("raised"))
    higher = F.transform("windows", lambda w: F.struct(
        w["need"].alias("need"), F.greatest(w["low"], F.element_at("raised", w["need"])).alias("low"), w["high"].alias("high")
    ))
    tighter = queries.join(raised, "key", "left").withColumn("windows", F.when(F.col("raised").isNull(), F.col("windows")).otherwise(higher))
    return _best(_scored(stored(_leaves_of(tighter, tree, False)), placed, tree, same, take), take)


def indexed(rows: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Tree] | None:
    """The rows (vec_id, label, vector array<long>) in the leaves of a tree, and the tree; None if no row takes part.

    Rows with a null vec_id, label, vector or component take no part. A vector that is shorter than the longest is filled up
    with zeros. Raises ValueError if scores could reach 2**51, where floating point is no longer exact.
    """
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    whole = whole.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    if not size.n:
        return None
    width = max(1, size.width)
    if 4 * width * (size.most or 0) ** 2 >= EXACT:
        raise ValueError("components are too large for exact scores")
    packed = _packed(whole, width)
    sample = packed.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE).select("vector").collect()
    points = np.frombuffer(b"".join(bytes(r.vector) for r in sample), "<i4").reshape(-1, width).astype(np.float64)
    tree = grown(points, size.n, leaf_rows)
    placed = stored(_placed(packed, tree))
    return placed, _with_ranges(tree, placed)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows where ``anchors`` holds.

    ``rows`` has (vec_id long, label of any type, vector array<long>); other columns are not read. A score is the inner product
    with the anchor; higher ones come first, of equal ones the smaller vec_id. An anchor's positives are its first ``positives``
    rows of the same label; each one's negatives are the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, so a negative score has none. Fewer are returned where
    there are no more, and no row for a positive without negatives. Rows of the anchor's own vec_id are neither. Repeated
    anchors are mined once; any other row counts as often as it comes. Rows with a null part take no part (see
    ``indexed``); an empty table gives none.
    """
    if not 0 <= low < high:
        raise ValueError("the window must be 0 <= low < high percent of the positive score")
    spark = rows.sparkSession
    index = indexed(rows, leaf_rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    placed, tree = index
    asking = placed.withColumnRenamed("id", "vec_id").where(anchors).select(F.col("vec_id").alias("id"), "label", "vector").distinct()
    asking = asking.withColumn("key", F.xxhash64("id", "label", "vector"))
    most = EXACT  # no score is as high
    everything = F.array(F.struct(F.lit(0).cast("long").alias("need"), F.lit(-most).alias("low"), F.lit(most).alias("high")))
    asking = stored(asking.withColumn("windows", everything))
    near = stored(search(asking, placed, tree, True, positives))
    window = F.struct(
        F.col("rank").cast("long").alias("need"),
        F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"),
    )
    wanted = near.where("score >= 0").groupBy("key").agg(F.collect_list(window).alias("windows"))
    wanted = stored(asking.drop("windows").join(wanted, "key"))
    found = search(wanted, placed, tree, False, negatives)
    named = near.select("key", F.col("rank").cast("long").alias("need"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(named, ["key", "need"])
        .join(asking.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
