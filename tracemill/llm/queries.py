"""The registered queries of this subpackage, one for each operator, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import chat, compression, gnat, html_diff, langid, licences, mixing, ngram_join, periodic, sharding, simhash, tiling, warc
from tracemill.session import scratch_folder
from tracemill.queries import Registry

REGISTRY = Registry()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@REGISTRY.add("op1_ngram_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.classes(table(spark, folder, "documents"), size=3, percent=90)


@REGISTRY.add("op2_licence_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices within documents."""
    return licences.scan(table(spark, folder, "documents"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@REGISTRY.add(
    "op3_chat_formatting",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
        UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(
            length('<|im_start|>') + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n>')) + 1
            + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length('<|im_end|>') + 1
        )::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation and one of control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    out = chat.formatted(chat.conversation_trees(rows.union(control)))
    out = out.withColumns({"turns": chat.parsed(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@REGISTRY.add("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of each page."""
    return html_diff.main_text(table(spark, folder, "pages"))


@REGISTRY.add("op5_benchmark_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, by greedy string tiling."""
    return tiling.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tiles")


@REGISTRY.add(
    "op6_sharding",
    f"""
    WITH keyed AS (
        SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS h
        FROM documents
    ),
    nodes AS (SELECT doc_id, n_bytes, d, h >> (60 - d) AS bucket FROM keyed, (SELECT unnest(range(0, 61)) AS d)),
    sums AS (SELECT d, bucket, sum(n_bytes) AS bytes, count(*) AS docs FROM nodes GROUP BY ALL),
    fitting AS (
        SELECT doc_id, n_bytes, n.d, n.bucket, bytes, docs, row_number() OVER (PARTITION BY doc_id ORDER BY n.d) AS k
        FROM nodes n JOIN sums s ON n.d = s.d AND n.bucket = s.bucket WHERE bytes <= {sharding.LIMIT_BYTES} OR docs = 1
    )
    SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(bucket), d::INTEGER, '0') END AS shard,
        d::INTEGER AS shard_depth, bytes::BIGINT AS shard_bytes, docs::BIGINT AS shard_docs
    FROM fitting WHERE k = 1
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of each document, by extendible hashing."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.sharded(docs).drop("text")


@REGISTRY.add("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "n_languages")


MIXING_SQL = """
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
    ),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM sources),
    asked AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
        FROM weighed WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM asked),
    placed AS (
        SELECT doc_id, size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
            row_number() OVER (PARTITION BY s.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS r,
            ('0x' || substr(md5('mix/0/' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target, copies, copies * size AS taken
    FROM (SELECT *, least(floor((r + 1) * each + o) - floor(r * each + o), 2)::BIGINT AS copies FROM placed)
"""


@REGISTRY.add("op8_mixing", MIXING_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mix takes each document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.planned(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


@REGISTRY.add("op9_warc_chunks")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    archives = scratch_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), archives)
    return warc.records(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@REGISTRY.add("op10_compression_bands")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts, base rules and compression verdict of each document."""
    return compression.measures(table(spark, folder, "documents"))


@REGISTRY.add("op11_simhash_near_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 64-bit fingerprints differ in at most two bits."""
    found = simhash.classes(table(spark, folder, "documents"), size=3, most=2)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten repeats a part of itself up to its end; the others are as they were."""
    split = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = split.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    split = split.withColumns({"n": F.size("words"), "g": F.floor(F.col("h") / 10)})
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return split.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@REGISTRY.add("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in each document, and digests of them and of the text without the repeats."""
    found = periodic.runs(with_repeats(table(spark, folder, "documents")), least=24, times=3)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best)))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


HARD_NEGATIVES_SQL = """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""


@REGISTRY.add("op13_hard_negatives", HARD_NEGATIVES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of one row in a hundred, among rows of other labels that are less alike than its nearest of the same."""
    rows = table(spark, folder, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return gnat.mine(rows, F.col("vec_id") % 100 == 0)
