import brute

import corpus_pipeline
from tracemill.llm import compression, sharding


def plain(rows, items):
    """The pipeline's result as (doc_id, shard) pairs, stage by stage; rows of (doc_id, text, source)."""
    sound = []
    for r in rows:
        raw = r[1].encode()
        n = (len(raw) + 2048) // 4096
        parts = [brute.ratio(raw[k * 4096 : len(raw) if k == n - 1 else (k + 1) * 4096]) for k in range(n)] if n > 1 else []
        bad = sum(p < compression.CHUNK_LOW or p > compression.CHUNK_HIGH for p in parts)
        band = [b for b in compression.BANDS if len(raw) >= b.bytes]
        if not brute.measures(r[1])[-1] and (not band or band[-1].low <= brute.ratio(raw) <= band[-1].high) and bad <= n / 2:
            sound.append(r)
    group = brute.components([r[:2] for r in sound], 5, 80)
    leads = [r for r in sound if group[r[0]][1] == r[0]]
    clean = [r for r in leads if not brute.leaked(r[1], items)]
    mixed = [r for r, c in zip(clean, brute.copies(clean)) for _ in range(c)]
    assert len(rows) > len(sound) > len(leads) > len(clean)
    return sorted((r[0], s) for r, s in zip(mixed, brute.shards([r[:2] for r in mixed], sharding.LIMIT_BYTES)))


def test_stages_against_plain_version(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.shard) for r in out.collect()) == plain(docs, items)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    extra = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS size", "'x' AS token", "0 AS depth")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, "/root/testdata/sf0.001").columns == extra.columns, name
        assert stage(spark, extra.limit(0), "/root/testdata/sf0.001").count() == 0


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "", None, None, None), (1, None, "x", None, 3), (2, "word " * 100_000, None, "a", None)]
    df = spark.createDataFrame(rows * 2, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "/root/testdata/sf0.001").count() >= 0, name
