import random
from collections import Counter, defaultdict

import brute
import pytest

from tracemill.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, shard int"


def rows(n=400):
    rng = random.Random(2)
    out = []
    for k in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None])
        text = rng.choice([None, "", "same text here", " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 300)))])
        out.append((k if k % 9 else None, text, source, "s", 1))
    return out + [(7007, "again and again", "a", "s", 1)] * 3 + [(900, None, "empty", "s", 1)]


def test_mixing_against_plain_version(spark):
    data = rows()
    got = mixing.planned(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    want = Counter((i, t, s, c) for (i, t, s, *_), c in zip(data, brute.copies([r[:3] for r in data])))
    # Rows alike in source, size and id may trade their copies.
    key = lambda i, t, s: (i, len(brute.WORD.findall(t or "")), s)
    assert Counter((*key(i, t, s), c) for (i, t, s, c), m in want.items() for _ in range(m)) == Counter((*key(r.doc_id, r.text, r.source), r.copies) for r in got)
    goal = brute.targets({s: sum(len(brute.WORD.findall(t or "")) for _, t, x, *_ in data if x == s) for s in {r[2] for r in data}})
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and abs(r.target - float(goal[r.source])) < 1e-6
    assert all(abs(taken[s] - float(goal[s])) <= 600 for s in goal)
    mixed = mixing.mixed(spark.createDataFrame(data, SCHEMA))
    assert mixed.columns == ["doc_id", "text", "source", "size", "shard"] and mixed.count() == sum(r.copies for r in got)


def test_mixing_without_words(spark):
    assert mixing.planned(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.copies for r in mixing.planned(spark.createDataFrame([(1, None, "a", "s", 1)], SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("limit", [500, 4000, 10**9])
def test_sharding_against_plain_version(spark, limit):
    data = [r for r in dict.fromkeys(rows()) if r[0] is not None] + [(5000, "é" * 3000, "a", "s", 1)]
    got = {r.doc_id: r for r in sharding.sharded(spark.createDataFrame(data, SCHEMA), limit).collect()}
    want = brute.shards([r[:2] for r in data], limit)
    assert {i: r.shard for i, r in got.items()} == {d[0]: b for d, b in zip(data, want)}
    held = defaultdict(list)
    for r in got.values():
        held[r.shard].append(r.n_bytes)
    assert all(sum(b) <= limit or len(b) == 1 for b in held.values())
    assert all(r.shard_bytes == sum(held[r.shard]) and r.shard_docs == len(held[r.shard]) and r.shard_depth == len(r.shard) for r in got.values())


def test_rows_alike_overflow(spark):
    data = [(1, "twelve bytes", "a", "s", 1)] * 50 + [(2, "other", "a", "s", 1), (None, None, None, None, None)]
    got = sharding.sharded(spark.createDataFrame(data, SCHEMA), 40)
    held = Counter()
    for r in got.collect():
        held[r.shard] += r.n_bytes
        assert r.shard_bytes <= 40
    assert got.count() == 52 and max(held.values()) <= 40 and len(held) >= 17 and "text" in got.columns
    assert sharding.sharded(spark.createDataFrame([], SCHEMA), 40).count() == 0
