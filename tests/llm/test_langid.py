from tracemill.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs.where(langid.held_out()), model).collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    long = {lang: next(r.text for r in docs.where(f"lang = '{lang}' AND n_chars > 4000").limit(1).collect()) for lang in ("en", "de")}
    text = long["en"][:3000] + "\n" + long["de"][:1000]
    (row,) = langid.predict(spark.createDataFrame([(1, text, "xx", "s")], SCHEMA), model).collect()
    assert row.lang_pred == "en" and row.n_languages == 2 and 0.6 < row.score < 0.9 and row.lang == "xx"


def test_edges(spark):
    rows = [(k, "aba bab abba", "a", "s") for k in range(3)] + [(3, "xyx yxy", "b", "s"), (4, None, "b", "s"), (5, "12 ?", None, "s"), (6, "aba", None, "s"), (6, "aba", None, "s"), (None, "YXY", None, "s"), (7, "", "c", None), (8, "aba " * 50_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    assert model.languages == ("a", "b")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect())
    assert got == sorted([(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "und"), (5, "und"), (6, "a"), (6, "a"), (-1, "b"), (7, "und"), (8, "a")])
    none = langid.fit(df.where("lang = 'q'"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
