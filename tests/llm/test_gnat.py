import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import gnat

SCHEMA = "vec_id long, label int, vector array<long>, leaf string, key long, id long"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    rows = [r[:3] for r in rows if None not in r[:3] and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, label, v in {(i, c, tuple(v)) for i, c, v in rows if i % 100 == 0}:
        scored = sorted((-dot(v, w), i, c) for i, c, w in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, c in scored if c != label and low * -s <= 100 * -t <= high * -s]
            out |= {(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits[:negatives])}
    return out


def clustered(seed, n, width=8):
    """Clusters of different sizes and norms, equal vectors, zeros, ties and negative scores."""
    rng = random.Random(seed)
    centres = [[rng.randrange(-200, 200) for _ in range(width)] for _ in range(12)]
    out = []
    for k in range(n):
        c = centres[min(rng.randrange(20), 11)]
        v = [x + rng.randrange(-25, 25) for x in c] if rng.random() < 0.8 else list(c)
        out.append((k * 10, rng.randrange(4), v, "x", k, None))
    return out


@pytest.mark.parametrize("leaf_rows, blocks", [(20, (8192, 4096)), (60, (13, 3)), (10**6, (50, 5))])
def test_against_all_pairs(spark, monkeypatch, leaf_rows, blocks):
    monkeypatch.setattr(gnat, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(gnat, "CHUNK_QUERIES", blocks[1])
    rows = clustered(leaf_rows, 700)
    rows += [(-100, 0, [0] * 8, "", 0, 0), (-200, 1, [-5] * 8, "", 0, 0), (7, None, [1] * 8, "", 0, 0), (None, 1, [1] * 8, "", 0, 0), (300000, 2, None, "", 0, 0), (400000, 2, [1, None], "", 0, 0)]
    rows += [(500, 9, [3] * 8, "", 0, 0), (100100, 3, [40, 30], "", 0, 0), (100101, 3, [], "", 0, 0)]
    got = gnat.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, leaf_rows=leaf_rows).collect()
    # A second row of vec_id 500 makes that anchor ambiguous: both are mined.
    assert {tuple(r) for r in got} == brute(rows)


def test_ties_repeats_and_empty_tables(spark):
    same = [(k, k % 3, [50, 0], "", 0, 0) for k in range(60)] + [(100, 0, [100, 0], "", 0, 0)] * 2
    got = {tuple(r) for r in gnat.mine(spark.createDataFrame(same, SCHEMA), F.col("vec_id") % 100 == 0, low=10, high=100).collect()}
    assert got == brute(same, low=10, high=100)
    assert gnat.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
    assert gnat.mine(spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA), F.lit(True)).collect() == []
    alone = spark.createDataFrame([(100, 1, [1], "", 0, 0)], SCHEMA)
    assert gnat.mine(alone, F.col("vec_id") % 100 == 0).collect() == []
    with pytest.raises(ValueError):
        gnat.mine(spark.createDataFrame([(100, 1, [10**9], "", 0, 0)], SCHEMA), F.lit(True))


def test_tree_eliminates_and_never_wrongly(spark):
    """Bounds hold for every row, and most leaves of clustered rows are eliminated for a narrow window."""
    rows = clustered(1, 1500)
    x = np.array([r[2] for r in rows], float)
    df = spark.createDataFrame(rows, SCHEMA)
    placed, tree = gnat.indexed(df, 30)
    assert tree.leaves > 20 and len(tree.nodes) > 1
    leaf = {r.id: r.leaf for r in placed.collect()}
    at = np.array([leaf[r[0]] for r in rows])
    assert np.array_equal(at, tree.place(x))
    assert np.array_equal(np.bincount(at, minlength=tree.leaves), tree.rows)
    least, greatest = tree.bounds(x[:200])
    scores = x[:200] @ x.T
    assert (scores >= least[:, at]).all() and (scores <= greatest[:, at]).all()
    top = np.sort(scores, axis=1)[:, -5:-4]
    assert (greatest >= top).mean() < 0.5
