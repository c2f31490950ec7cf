import random
import re

import pytest
import xxhash

from tracemill.llm import graph, simhash
from tracemill.llm.graph import components

SCHEMA = "doc_id long, text string, fingerprint string, key long, least long"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_print(text, size=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(found[k : k + size]) for k in range(len(found) - size + 1)] if len(found) >= size else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    """{(id, print): smallest id} of (id, print) rows."""
    label = {p: p for _, p in prints}
    todo = sorted(label)
    for a in todo:
        for b in todo:
            if a < b and bin(a ^ b).count("1") <= most and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {p: new if c == old else c for p, c in label.items()}
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return {(i, p): least.get(label[p]) for i, p in prints}


def corpus():
    rng = random.Random(5)
    word = lambda: f"Wörd{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    base = [word() for _ in range(300)]
    for _ in range(120):
        edited = list(base)
        for _ in range(rng.randrange(0, 6)):
            edited[rng.randrange(300)] = word()
        texts.append("\n".join(edited))
    return texts + [None, "", " \t", "one", "ONE", "one two", "a\x1cb \xa0", texts[0], texts[0].upper(), "x " * 40000]


def test_against_all_pairs(spark):
    rows = [(k * 31 % 997, t, "p", k, None) for k, t in enumerate(corpus())] + [(None, "one", "", 0, 0), (None, "only here", "", 0, 0), (31, "text of its own", "", 0, 0)]
    expected = brute_components([(r[0], brute_print(r[1])) for r in rows], 2)
    for dense in (64, 2):
        simhash.DENSE = dense
        got = simhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {(r.doc_id, r.fingerprint % (1 << 64)): r.component_id for r in got} == expected
        assert len(got) == len(rows)
    simhash.DENSE = 64
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_links_at_every_distance(spark, most):
    """Both ways of finding links, on fingerprints with known distances in one segment, the other and both."""
    rng = random.Random(most)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        p = rng.getrandbits(64)
        prints.add(p)
        for flips in range(1, 7):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
            prints.add(p ^ sum(1 << b for b in rng.sample(range(32 * (flips % 2), 32 + 32 * (flips % 2)), flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    whole = {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= most}
    assert {frozenset(r) for r in simhash.links(df, most).collect()} == whole
    met = {frozenset(r) for r in simhash._meeting(df, most).collect()}
    assert met <= whole
    group = lambda rows: {r.node: r.component for r in components(rows).collect()}
    edges = spark.createDataFrame([tuple(e) for e in whole], "src long, dst long")
    assert group(edges) == group(simhash._meeting(df, most))


def test_a_crowded_entry_costs_rows_in_proportion(spark):
    """Fingerprints that share a half: the number of rows behind their links does not grow with the square."""
    df = spark.createDataFrame([(k,) for k in range(3000)], "fingerprint long")
    found = components(simhash.links(df, 2)).collect()
    assert len(found) == 3000 and {r.component for r in found} == {0}
    assert simhash._meeting(df, 2).count() <= 65 * 3000


def test_contraction_in_pieces(spark, monkeypatch):
    """Components when no task may hold more than a few edges."""
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    whole = {tuple(r) for r in components(df).collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert whole == set(label.items())
    import numpy as np

    nodes, roots = graph.forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert {(n, r) for n, r in zip(nodes.tolist(), roots.tolist()) if n in label} == whole


def test_contraction_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        edges = [(k, k + 1) for k in range(90)] + [(500, k) for k in range(501, 560)]
        random.Random(1).shuffle(edges)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**{k: 0 for k in range(91)}, **{k: 500 for k in range(500, 560)}}
