import random
import time

import brute
import numpy as np
import pytest

from tracemill.llm import ngram_join
from tracemill.llm.graph import components

SCHEMA = "doc_id long, text string, token string, rep long"


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    """Unlike texts, a passage that all share, exact copies, and a group of near copies at all distances."""
    rng = random.Random(seed)
    passage = words(rng, 12)
    texts = [" ".join(words(rng, rng.randrange(1, 60)) + passage) for _ in range(30)]
    base = words(rng, 60)
    for _ in range(40):
        edited = list(base)
        for _ in range(rng.randrange(0, 4)):
            edited[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(edited).upper() if rng.random() < 0.3 else "\n".join(edited))
    texts += ["one two", "one  two", "One\tTwo", "two one", "", "  \n", None, "a", "b", "a"] + [texts[3]] * 5
    texts.append(" ".join(words(rng, 5000, 10**6)))
    rows = [(k * 7 % 1009, t, "x", k) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (2, 50)])
@pytest.mark.parametrize("postings, block", [(32, 128), (1, 4), (3, 1)])
def test_against_all_pairs(spark, monkeypatch, size, percent, postings, block):
    if (postings, block) != (1, 4) and size != 3:
        pytest.skip("each path once with the other thresholds")
    monkeypatch.setattr(ngram_join, "MAX_POSTINGS", postings)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rows = corpus(size)
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components([(r[0], r[1]) for r in rows], size, percent)
    assert len(got) == len(rows)


def test_edges(spark):
    rows = [(5, "a b c d", None, None), (5, "a b c d", None, None), (2, "A B C D", "t", 1), (None, "a b c d", None, 3), (9, None, None, None), (9, None, None, 4)]
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 0, None), (9, 0, 9), (9, 0, 9)], key=str)
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted((r.doc_id, r.token) for r in kept.where("doc_id IS NOT NULL").collect()) == [(2, "t"), (9, None)]
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == ["doc_id", "text", "token", "rep"]
    assert ngram_join.classes(spark.createDataFrame([], SCHEMA), 3, 90).count() == 0


def test_one_id_and_several_texts(spark):
    """Rows are told apart by their text, not by their id alone: an unlike row does not go with its namesake."""
    x, y, z = "a b c d e f", "p q r s t u v", "1 2 3 4 5"
    rows = [(1, x, "1x", 0), (2, x, "2x", 0), (2, y, "2y", 0), (3, z, "3z", 0), (3, z.replace("1", "1 "), "3z again", 0), (3, "", "3 empty", 0), (2, y, "2y", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, 3, 90).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (2, 5, 2), (2, 5, 2), (3, 0, 3), (3, 3, 3), (3, 3, 3)]
    for _ in range(2):
        kept = sorted(r.token[:2] for r in ngram_join.one_of_each(df, 3, 90).collect())
        assert kept == ["1x", "2y", "3 ", "3z"]


def test_a_token_of_very_many(spark, monkeypatch):
    """Every token counts as one of very many hits: nothing is dealt out by token, the links are the same."""
    monkeypatch.setattr(ngram_join, "HOT_HITS", 0)
    rows = corpus(3)
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components([(r[0], r[1]) for r in rows], 3, 90)


def test_pairs_pass_both_filters():
    """Pairs that share no prefix token under one of the orders are not verified, and no link is lost by it."""
    rng = random.Random(2)
    grade = np.array([[rng.randrange(256) for _ in range(1 << 12)] for _ in (0, 1)], np.uint8)
    sets = [np.unique(np.array([rng.randrange(1, 1 << 62) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(20)]
    for _ in range(60):
        s = sets[rng.randrange(20)]
        sets.append(np.unique(np.concatenate((s[rng.randrange(3) :], np.array([rng.randrange(1, 1 << 62) for _ in range(rng.randrange(3))], np.uint64)))))
    with np.errstate(over="ignore"):
        found = set(ngram_join._links_of(sets, sets, 80, grade))
    size = lambda a, b: len(np.intersect1d(a, b))
    assert found == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * size(a, b) >= 80 * (len(a) + len(b) - size(a, b))}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(1, 1), (None, 3), (7, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(7, 60)}}


def test_packed_counters():
    """Counters come back, also large ones, and a table with few tokens takes far less than a byte for each counter."""
    rng = np.random.default_rng(4)
    tables = [np.zeros(1 << 15, np.uint32), rng.poisson(0.2, 1 << 15).astype(np.uint32), rng.integers(0, 1 << 32, 1 << 15).astype(np.uint32)]
    tables.append(np.array([0, 254, 255, 256] * (1 << 13), np.uint64))
    out = np.zeros(1 << 15, np.uint64)
    for table in tables:
        ngram_join._add_packed(out, ngram_join._packed(table))
    assert np.array_equal(out, np.sum(tables, axis=0, dtype=np.uint64))
    assert len(ngram_join._packed(tables[0])) < 100 and len(ngram_join._packed(tables[1])) < 1 << 13


def test_copies_between_blocks_follow_the_family(spark, monkeypatch):
    """Each text of a family of many blocks travels to a bounded number of tasks, not to one for each block."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 1)
    monkeypatch.setattr(ngram_join, "WIDE", 8, raising=False)
    sent, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda tasks, *a: sent.append(tasks.count()) or verified(tasks, *a))
    base = words(random.Random(5), 60)
    # Each copy is near the first, most are unlike each other.
    rows = [(k, " ".join(base[:k] + [f"new{k}"] * (k > 0) + base[k + 1 :]), None, None) for k in range(48)]
    got = ngram_join.classes(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components([r[:2] for r in rows], 3, 90)
    assert len(sent) == 2 and sent[0] == 48 and sent[1] <= 2 * 8 * 48


def test_shuffles_go_with_their_step(spark):
    """What a step has shuffled is not on the disk when the next one has ended; the session's settings are as before."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv

    def shuffles():
        files = env.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    df = spark.createDataFrame(corpus(3), SCHEMA)
    before, held = shuffles(), dict(spark.conf.getAll)
    for find in (ngram_join.classes, ngram_join.one_of_each):
        find(df, 3, 90)
        left = shuffles() - before
        for _ in range(50):
            if len(left) <= 8:
                break
            time.sleep(0.2)
            left = shuffles() - before
        assert len(left) <= 8  # a frame that is returned may have been tried for emptiness
    assert dict(spark.conf.getAll) == held
