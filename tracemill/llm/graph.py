"""Connected components of a graph given by its edges, by contracting it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import settings, stored

# Rows of a table of texts that a Python task gets at once.
ROWS_AT_ONCE = 1000
# So many edges meet in one task at once.
EDGES_AT_ONCE = 1 << 20


@contextmanager
def large_partitions(spark: SparkSession) -> Iterator[None]:
    """While this holds, adaptive execution merges small shuffle partitions up to its advised size, not to one per core, and
    rows go to Python tasks ``ROWS_AT_ONCE`` at a time.

    The tables of a graph's rounds are small next to the texts; written in a few files they cost fewer tasks. Texts in small
    batches keep the tasks' memory low.
    """
    held = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_AT_ONCE)}
    with settings(spark, held):
        yield


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, after := root[root]):
            root = after


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root): within each ``EDGES_AT_ONCE`` edges (two long columns) of a task, every node and the smallest it reaches."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        waiting = 0

        def settled():
            columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(*columns)], ["node", "root"])

        for batch in batches:
            if waiting + batch.num_rows > EDGES_AT_ONCE and held:
                yield settled()
                waiting = 0
            held.append(batch)
            waiting += batch.num_rows
        if held:
            yield settled()

    return edges.mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst, long): the smallest node reachable.

    Null ends and loops are left out; repeated edges count once. Every task replaces its edges by stars around the
    smallest node that it sees. A node with several such roots ties them together: the roots alone are the next, smaller
    graph, and what is left of at most ``EDGES_AT_ONCE`` edges is settled in one task. No list is longer than the number of
    such pieces, whatever the degrees.
    """
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst")
    stars = stored(_stars(ends))
    if stars.count() <= EDGES_AT_ONCE:
        return _stars(stars.coalesce(1)).withColumnRenamed("root", "component")
    roots = stars.groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots"))
    labelled = stored(roots)
    tied = labelled.where(F.size("roots") > 1).select(F.explode("roots").alias("src"), F.col("label").alias("dst"))
    further = stored(components(tied)).select(F.col("node").alias("label"), "component")
    return labelled.select("node", "label").join(further, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
