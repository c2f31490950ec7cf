import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracemill.llm import periodic
from tracemill.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, period long, n_words long"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=24, times=3):
    """By every period: maximal stretches that hold it, without those that hold a smaller one at the same ends."""
    found = {}
    for q in range(1, len(w) // times + 1):
        x = 0
        while x + q < len(w):
            end = x
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end - x >= (times - 1) * q:
                found.setdefault((x, end + q), q)
            x = end + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, times * q))


def brute_row(text):
    w = split(text)
    spans = brute_runs(w)
    gone = {k for s, n, q in spans for k in range(s + q, s + n)}
    return len(w), spans, " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(doc_id, text):
    w = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[:a] + [w[a + k % p] for k in range(n - a)])


def strings(seed):
    """Words over small and large alphabets: nested and adjacent periods, Fibonacci and Thue-Morse words, squares, noise."""
    rng = random.Random(seed)
    fib, tm = ["a", "ab"], "a"
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    while len(tm) < 900:
        tm += tm.translate(str.maketrans("ab", "ba"))
    out = [list(fib[-1][:800]), list(tm[:800]), list("ab" * 50 + "c") * 6, list("ab" * 50 + "c") * 2, ["x"] * 500, []]
    out.append([c for k in range(5) for c in (["a", "b"] * 20 + [f"c{k}"]) * 4])
    for alphabet in (1, 2, 3, 5, 400):
        for _ in range(8):
            text = []
            while len(text) < rng.randrange(30, 700):
                block = [str(rng.randrange(alphabet)) for _ in range(rng.randrange(1, 60))]
                if len(text) > 40 and rng.random() < 0.3:
                    block = text[-rng.randrange(2, 40) :]
                part = block * rng.choice([1, 1, 2, 3, 3, 4, 7])
                text += part[: len(part) - rng.randrange(0, len(block))]
            out.append(text)
    nested = (["a", "b", "b"] * 9 + ["c"]) * 4 + ["d"]
    out += [nested * 4, list(map(str, range(100))) * 3, list(map(str, range(100))) * 3 + ["0"] * 30]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_every_period(seed):
    for text in strings(seed):
        numbers = {}
        w = np.array([numbers.setdefault(x, len(numbers)) for x in text] + [-1], np.int64)
        with np.errstate(over="ignore"):
            got = [r for r in periodic.runs_of(w, len(text)) if r[1] >= 24]
        assert got == brute_runs(text), text


def test_rows(spark):
    texts = [" ".join(x) for x in strings(1)] + [None, "", " \n\t", "one", "a\x1cb " * 30, "\xa0 x y " * 20, "again " * 24, "again " * 23, "word " * 30000]
    rows = [(k % 40, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, "p q " * 40, None, None, None)] * 2
    got = periodic.runs(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    plain = {t: (30000, [(0, 30000, 1)], "word") if t == "word " * 30000 else brute_row(t) for t in {r[1] for r in rows}}
    expected = [(r[0], *plain[r[1]]) for r in rows]
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == expected
    assert periodic.runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(spark.createDataFrame([], SCHEMA), times=2)


def test_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = {}
    for r in docs:
        w = split(planted(r.doc_id, r.text))
        if len(w) > 3000:
            continue  # the plain version takes the square of it; long texts are in the other tests
        _, spans, collapsed = brute_row(" ".join(w))
        best = max(spans, key=lambda s: (s[1] * 10**9 // s[2], -s[0], -s[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if spans else None
        expected[r.doc_id] = (len(spans), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in spans)), sha(collapsed))
    rows = REGISTRY.queries["op12_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id in expected} == expected
    assert sum(r.n_runs > 0 for r in rows) >= 10
