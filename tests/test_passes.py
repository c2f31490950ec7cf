"""Costly steps are done once, and for the rows that need them."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import iforest
from tracemill.plans import experiments
from tracemill.queries import inputs, models
from tracemill.sources import logs

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def hashed(*parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("trees", [1, 20])
def test_rows_that_no_tree_draws_have_no_array_of_draws(spark, trees):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("seq_id"), F.array().cast("array<struct<index:int,value:double>>").alias("entries"))
    drawn = iforest._drawn(rows, trees, 5, 0.004)
    expected = set()
    for t in range(trees):
        a, b = 1 + hashed(5, "a", t) % (iforest.PRIME - 1), hashed(5, "b", t) % iforest.PRIME
        for k in range(3000):
            draw = (hashed(k) % iforest.PRIME * a + b) % iforest.PRIME
            if draw < -(-0.004 * iforest.PRIME // 1):
                expected.add((str(k), t, draw))
    assert {(r.seq_id, r.tree, r["_draw"]) for r in drawn.collect()} == expected and expected
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Filter" in line and "pmod" in line and "lambda" not in line]


@tables
def test_sequences_are_stored_before_they_are_split(spark, monkeypatch):
    kept, real = [], experiments.split.stratified
    monkeypatch.setattr(experiments.split, "stratified", lambda df, **more: kept.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, **more))
    assert models.next_event_experiment(spark, FOLDER).count() == 1
    assert len(kept) == 1 and "Aggregate" not in kept[0]


@tables
def test_lines_of_a_catalogue_are_masked_once(spark, monkeypatch):
    given, real = [], logs.parse
    monkeypatch.setattr(logs, "parse", lambda raw, pattern=None, *more, **named: given.append(pattern) or real(raw, pattern, *more, **named))
    assert models.cross_catalogue_detect(spark, FOLDER).count() > 0
    assert given.count(inputs.BLOCK_LOG_PATTERN) == 1
