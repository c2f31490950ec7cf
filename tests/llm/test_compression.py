import random

import brute

from tracemill.llm import compression as c

SCHEMA = "doc_id long, text string, kept string, n_words int"


def rows():
    rng = random.Random(3)
    prose = lambda n: " ".join(f"{rng.choice(['the', 'of', 'and', 'to'])} {''.join(rng.choices('etaoinshrdlu', k=rng.randrange(2, 9)))}" for _ in range(n))
    junk = "".join(chr(33 + b % 94) + (" " if b % 9 == 0 else "") for b in rng.randbytes(6000))
    return [
        (1, prose(100)), (2, prose(4000)), (3, "spam ham eggs\n" * 400), (4, junk), (5, None), (6, ""), (7, " \n\t\n"), (8, "only few words"),
        (9, "a | b\na | b\n\n \na | b\nc <d>"), (None, prose(60)), (1, prose(60)), (10, prose(300) + "　é" * 50 + "\x1c\x85 x"), (11, "word " * 49), (12, " ".join(map(str, range(50)))),
        (13, prose(200) + " " + junk),
    ]


def test_against_plain_counts(spark):
    got = c.measures(spark.createDataFrame([(i, t, "x", 0) for i, t in rows()], SCHEMA)).collect()
    want = []
    for i, t in rows():
        raw = (t or "").encode()
        base = brute.measures(t)
        size = c.CHUNK_BYTES
        n = (len(raw) + size // 2) // size
        parts = [brute.ratio(raw[k * size : len(raw) if k == n - 1 else (k + 1) * size]) for k in range(n)] if n > 1 else []
        low, high = sum(r < c.CHUNK_LOW for r in parts), sum(r > c.CHUNK_HIGH for r in parts)
        limits = [b for b in c.BANDS if len(raw) >= b.bytes]
        good = not limits or (limits[-1].low <= brute.ratio(raw) <= limits[-1].high and low + high <= c.CHUNK_SHARE * max(n, 1))
        want.append((i, *base, good and not base[-1], len(raw), low, high))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bytes", "low_chunks", "high_chunks")
    assert sorted([tuple(r[x] for x in names) for r in got], key=str) == sorted(want, key=str)
    verdict = {r.doc_id: r.kept for r in got if r.doc_id not in (1, None)}
    assert verdict[2] and not verdict[3] and not verdict[4] and verdict[12]


def test_kept_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows()], SCHEMA)
    kept = c.kept(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in c.measures(df).where("kept").collect())
    assert c.measures(df.limit(0)).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in c.measures(docs).collect()}
    assert got == {r.doc_id: brute.measures(r.text) for r in docs.collect()}
