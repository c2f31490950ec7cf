import random

import brute
import numpy as np
import pytest

from tracemill.llm import tiling

DOCS, ITEMS = "doc_id long, text string, item_id long, coverage int", "item_id long, text string, doc_id int"


def test_tiles_against_all_starts():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(3, 30))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at, n = rng.randrange(len(item)), rng.randrange(3, 12)
            to = rng.randrange(len(text) + 1)
            text[to:to] = item[at : at + n]
        got = tiling.tiles(np.array(item, np.uint64) + np.uint64(1), np.array(text, np.uint64) + np.uint64(1), 3)
        assert all(item[i : i + k] == text[j : j + k] for i, j, k in got)
        want = brute.tiles(item, text, 3)
        assert [k for *_, k in got][:1] == [k for *_, k in want][:1]
        assert abs(sum(k for *_, k in got) - sum(k for *_, k in want)) <= 3


@pytest.mark.parametrize("block", [1, 2, 100])
def test_reordered_passages(spark, block):
    rng = random.Random(1)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, short = word(30), word(20), word(4)
    noise = [" ".join(word(40)) for _ in range(3)]
    mixed_up = a[20:] + word(500) + a[:10] + word(3) + a[10:20]
    docs = [
        (1, f"{noise[0]} {' '.join(a).upper()}, {noise[1]}", 0, 0),
        (2, " ".join(mixed_up), 0, 0),
        (3, " ".join(a[:15] + word(50)), 0, 0),
        (4, "; ".join(b) + ". " + " ".join(a), 0, 0),
        (5, noise[2], 0, 0), (6, None, 0, 0), (7, "", 0, 0), (8, " ".join(short), 0, 0),
        (None, " ".join(b), 0, 0), (4, "; ".join(b) + ". " + " ".join(a), 0, 0),
        (9, " ".join(word(20_000) + b), 0, 0),
    ]
    items = [(10, " ".join(a), 0), (11, " ".join(b), 0), (12, " ".join(short), 0), (13, None, 0), (14, "", 0), (11, " ".join(b), 0), (None, " ".join(a), 0)]
    docs_, items_ = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = tiling.leaks(docs_, items_, block_items=block).collect()
    want = [(1, 10, 30, 30), (2, 10, 30, 30), (4, 10, 30, 30), (4, 11, 20, 20), (4, 10, 30, 30), (4, 11, 20, 20), (None, 11, 20, 20), (9, 11, 20, 20)]
    assert sorted(((r.doc_id, r.item_id, r.item_words, r.tiled_words) for r in got), key=str) == sorted(want, key=str)
    assert {(r.n_tiles, tuple(t.item_at for t in r.tiles)) for r in got if r.doc_id == 2} == {(3, (0, 10, 20))}
    clean = tiling.clean(docs_, items_, block_items=block)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7, 8] and clean.columns == docs_.columns


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", 0, 0)], DOCS), spark.createDataFrame([], ITEMS)
    assert tiling.leaks(docs, items).count() == 0 and tiling.clean(docs, items).count() == 1
    assert tiling.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)).count() == 0


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in items.collect()]
    want = sorted((r.doc_id, *x) for r in docs.collect() for x in brute.leaked(r.text, bench))
    got = sorted((r.doc_id, r.item_id, r.item_words, r.tiled_words) for r in tiling.leaks(docs, items).collect())
    assert got == want and len(got) > 0
