"""Sources, sinks and run modes: the driver's tables written in every stored form, read back by the library, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import features, iforest, metrics, nextevent, order
from tracemill.plans import experiments, preprocess
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.explore import rounded
from tracemill.queries.models import TOP_K, REGISTRY as MODELS
from tracemill.queries.models import embedding_vectors, model, scored
from tracemill.queries.sequences import event_sequences
from tracemill.queries.templates import MATCH_SQL, catalogue
from tracemill.session import materialise, scratch_folder
from tracemill.sources import logs, summary, tables

REGISTRY = Registry()
add = REGISTRY.add

_CSV = {"header": True, "quote": '"', "escape": '"'}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@add(
    "raw_log_scan",
    f"""WITH {i.DOCUMENT_LINES},
    physical AS (SELECT row_number() OVER (ORDER BY line_id) AS line_id, raw FROM document_lines)
    SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS row_idx, raw FROM physical WHERE length(raw) > 0""",
)
def raw_log_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of ``documents`` as text files in order, read back as numbered lines; blank lines count but do not appear."""
    path = scratch_folder(spark, "raw")
    texts = i.table(spark, folder, "documents").where("text IS NOT NULL")
    texts.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return logs.read_logs(spark, path)


@add("default_labels", f"WITH {i.ALERT_LINES} SELECT line_id, content, 0 AS label FROM alert_content")
def default_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without a label hook are normal."""
    return logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN).select("line_id", "content", "label")


CATALOGUE_SQL = """
    SELECT 'E' || row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS event_id,
      'order "' || o_orderpriority || '", state <*>' || chr(10) || o_orderstatus || ', cost <*>' AS event_template, count(*) AS occurrence_count
    FROM orders GROUP BY o_orderpriority, o_orderstatus"""


@add("catalogue_files", f"WITH c AS ({CATALOGUE_SQL}) SELECT form, c.* FROM c, (VALUES ('csv'), ('table')) f(form)")
def catalogue_files(spark: SparkSession, folder: str) -> DataFrame:
    """A template catalogue with quotes, commas and line feeds, saved as CSV and as a table."""
    counted = i.table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("occurrence_count"))
    key = F.concat_ws("\n", "o_orderpriority", "o_orderstatus")
    ranked = order.rank_of(materialise(counted.withColumn("_key", key)), "_key", "r")
    shape = F.concat(F.lit('order "'), "o_orderpriority", F.lit('", state <*>\n'), "o_orderstatus", F.lit(", cost <*>"))
    found = ranked.select(F.concat(F.lit("E"), F.col("r").cast("string")).alias("event_id"), shape.alias("event_template"), "occurrence_count")
    path = scratch_folder(spark, "catalogue")
    named = found.select(F.col("event_id").alias("EventId"), F.col("event_template").alias("EventTemplate"), F.col("occurrence_count").alias("OccurrenceCount"))
    named.write.options(**_CSV).csv(f"{path}/templates.csv")
    tables.write_table(found, f"{path}/templates")
    forms = [tables.read_catalogue(spark, f"{path}/{name}").withColumn("form", F.lit(form)) for name, form in (("templates.csv", "csv"), ("templates", "table"))]
    return forms[0].unionByName(forms[1])


@add("label_file", f"WITH {i.BLOCK_LABELS} SELECT block_id, label FROM block_labels")
def label_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "labels")
    i.block_labels(spark, folder).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label")).write.options(**_CSV).csv(path)
    return tables.read_labels(spark, path)


@add("first_rows", "SELECT (SELECT least(100, count(*)) FROM orders)::BIGINT AS n, 0::BIGINT AS unlike")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of a CSV file: how many there are, and how many are not rows of the table."""
    path = scratch_folder(spark, "rows")
    rows = i.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows.write.options(**_CSV).csv(path)
    first = tables.read_first_rows(spark, path, 100, "o_orderkey BIGINT, o_custkey BIGINT")
    return first.withColumn("_n", F.lit(1)).join(rows.withColumn("_known", F.lit(1)), ["o_orderkey", "o_custkey"], "left").agg(
        F.count("_n").alias("n"), F.count_if(F.col("_known").isNull()).alias("unlike")
    )


_WIDE_SQL = ", ".join(f"count(*) FILTER (event_id = '{e}')::INTEGER AS \"{e}\"" for e in EVENT_TYPES)


def wide_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The occurrence matrix of ``events``, saved as CSV with an id, a label and a column that nobody reads."""
    path = scratch_folder(spark, "matrix")
    wide = features.occurrence_wide(event_sequences(spark, folder), EVENT_TYPES).withColumn("Type", F.lit(7))
    tables.write_occurrence(wide.withColumnsRenamed({"seq_id": "BlockId", "label": "Label"}), path)
    return tables.read_occurrence_matrix(spark, path, EVENT_TYPES)


@add("wide_matrix_scan", f"WITH {i.EVENT_LOG} SELECT block_id AS seq_id, {_WIDE_SQL}, max(label) AS label FROM event_log GROUP BY block_id")
def wide_matrix_scan(spark: SparkSession, folder: str) -> DataFrame:
    return wide_matrix(spark, folder)


@add(
    "wide_matrix_vectors",
    f"""WITH {i.EVENT_LOG}, w AS (SELECT block_id AS seq_id, {_WIDE_SQL}, max(label) AS label FROM event_log GROUP BY block_id)
    SELECT seq_id, label, concat_ws(',', {", ".join(f'"{e}"' for e in EVENT_TYPES)}) AS vector FROM w""",
)
def wide_matrix_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and labels aside, the event columns as one vector."""
    vectors = experiments.wide_vectors(wide_matrix(spark, folder), EVENT_TYPES)
    return vectors.withColumn("vector", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ","))


@add(
    "sequence_files",
    f"""WITH {i.SEQUENCES} SELECT form, seq_id, array_to_string(events, ' ') AS events, label, length FROM seqs, (VALUES ('run'), ('benchmark')) f(form)""",
)
def sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences as a run stores them, and in the benchmark layout with labels in words."""
    path = scratch_folder(spark, "sequences")
    seqs = tables.write_table(event_sequences(spark, folder), f"{path}/run")
    words = F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("label")
    seqs.select("seq_id", "events", words).write.parquet(f"{path}/benchmark")
    forms = [tables.read_sequences(spark, f"{path}/{form}").select(F.lit(form).alias("form"), "seq_id", F.array_join("events", " ").alias("events"), "label", "length") for form in ("run", "benchmark")]
    return forms[0].union(forms[1])


@add(
    "vocabulary_files",
    f"""WITH {i.EVENT_LOG}, v AS (SELECT event_id AS event, row_number() OVER (ORDER BY event_id)::INTEGER AS idx FROM (SELECT DISTINCT event_id FROM event_log)
      UNION ALL SELECT '<PAD>', 0)
    SELECT form, event, idx FROM v, (VALUES ('table'), ('json'), ('csv'), ('reverse')) f(form) WHERE form <> 'reverse' OR idx > 0""",
)
def vocabulary_files(spark: SparkSession, folder: str) -> DataFrame:
    """A vocabulary as a table, and without padding from 0 as JSON, as CSV and as JSON from index to event."""
    path = scratch_folder(spark, "vocabulary")
    vocab = tables.write_table(features.vocabulary(event_sequences(spark, folder)), f"{path}/table")
    old = vocab.where("idx > 0").select("event", (F.col("idx") - 1).alias("idx"))
    one = old.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event", "idx")))).alias("value"))
    one.write.text(f"{path}/vocab.json")
    back = old.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string"), "event")))).alias("value"))
    back.write.text(f"{path}/reverse.json")
    old.select(F.col("event").alias("EventId"), F.col("idx").alias("Index"), F.lit("a, b").alias("EventTemplate")).write.options(**_CSV).csv(f"{path}/vocab.csv")
    forms = [tables.read_vocabulary(spark, f"{path}/{name}").select(F.lit(form).alias("form"), "event", "idx") for name, form in (("table", "table"), ("vocab.json", "json"), ("vocab.csv", "csv"))]
    reverse = tables.read_reverse_vocabulary(spark, f"{path}/reverse.json").select(F.lit("reverse").alias("form"), "event", (F.col("idx") + 1).alias("idx"))
    return forms[0].union(forms[1]).union(forms[2]).union(reverse)


@add(
    "encode_by_join",
    f"""WITH {i.SEQUENCES}, v AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM (SELECT DISTINCT event_id FROM event_log WHERE event_id <> 'view'))
    SELECT block_id AS seq_id, string_agg(coalesce(idx, 0)::VARCHAR, ' ' ORDER BY line_id) AS ids, count(*) FILTER (idx IS NULL)::INTEGER AS oov_count
    FROM event_log LEFT JOIN v USING (event_id) GROUP BY block_id""",
)
def encode_by_join(spark: SparkSession, folder: str) -> DataFrame:
    """Events translated by a join, the form for vocabularies beyond a map; one event type is not in the vocabulary."""
    seqs = materialise(event_sequences(spark, folder))
    known = features.vocabulary(seqs.withColumn("events", F.array_remove("events", "view")))
    found = features.encode(seqs, known, most=0)
    return found.select("seq_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "oov_count")


@add("result_file", MODELS.sql["metrics"])
def result_file(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment results saved as JSON and read back."""
    path = scratch_folder(spark, "result")
    found = metrics.evaluate(scored(spark, folder), score="score")
    tables.write_result(found, path)
    return rounded(spark.read.schema(found.schema).json(path))


@add("saved_next_event_model", MODELS.sql["next_detect"])
def saved_next_event_model(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "model")
    model(spark, folder).save(path)
    return nextevent.detect(nextevent.NextEventModel.load(spark, path), event_sequences(spark, folder), TOP_K)


@add("saved_forest", MODELS.sql["iforest_embeddings"])
def saved_forest(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "model")
    vectors = embedding_vectors(spark, folder)
    iforest.fit(vectors).save(path)
    return rounded(iforest.score(iforest.IsolationForest.load(spark, path), vectors).drop("vector"))


MATCH_RUN_SQL = f"""{MATCH_SQL},
lines AS (
  SELECT m.line_id, m.masked, m.event_id, CASE WHEN a.raw LIKE '- %' THEN 0 ELSE 1 END AS label, row_number() OVER (ORDER BY m.line_id) - 1 AS i
  FROM matched m JOIN alert_masked a USING (line_id)),
windows AS (
  SELECT s, list(event_id ORDER BY i) AS events, max(label) AS label
  FROM (SELECT unnest(range(0, (SELECT count(*) FROM lines) - 19, 5)) AS s) JOIN lines ON i >= s AND i < s + 20 GROUP BY s),
cells AS (SELECT s, event, count(*) AS n FROM (SELECT s, unnest(events) AS event FROM windows) GROUP BY 1, 2),
vocab AS (SELECT event, row_number() OVER (ORDER BY event) AS idx FROM (SELECT DISTINCT event FROM cells)),
run_tables AS (
  SELECT 'parsed' AS "table", line_id::VARCHAR AS id, event_id || ' ' || label || ' ' || masked AS value FROM lines
  UNION ALL SELECT 'templates', c.event_id, (SELECT count(*) FROM lines l WHERE l.event_id = c.event_id)::VARCHAR FROM catalogue c
  UNION ALL SELECT 'sequences', s::VARCHAR, array_to_string(events, ' ') || ' ' || label FROM windows
  UNION ALL SELECT 'metadata', s::VARCHAR, 'sliding_window ' || (s + 20) || ' 20' FROM windows
  UNION ALL SELECT 'vocabulary', event, idx::VARCHAR FROM vocab UNION ALL SELECT 'vocabulary', '<PAD>', '0'
  UNION ALL SELECT 'padded', s::VARCHAR, string_agg(idx::VARCHAR, ' ' ORDER BY k) FROM (SELECT s, unnest(events) AS event, generate_subscripts(events, 1) AS k FROM windows) JOIN vocab USING (event) GROUP BY s
  UNION ALL SELECT 'occurrence', s::VARCHAR, string_agg(idx || ':' || n, ' ' ORDER BY idx) FROM cells JOIN vocab USING (event) GROUP BY s
  UNION ALL SELECT 'statistics', s::VARCHAR, '20 ' || count(*) || ' ' || max(n) FROM cells GROUP BY s
  UNION ALL SELECT 'summary', 'num_sequences', count(*)::VARCHAR FROM windows
  UNION ALL SELECT 'summary', 'anomaly_sequences', sum(label)::VARCHAR FROM windows
  UNION ALL SELECT 'summary', 'vocab_size', (count(*) + 1)::VARCHAR FROM vocab)"""


def match_run(spark: SparkSession, folder: str) -> str:
    """The folder of a stored run in mode ``match`` with all its outputs."""
    path = scratch_folder(spark, "run")
    names = catalogue(spark).select(F.col("event_id").alias("EventId"), F.col("event_template").alias("EventTemplate"))
    names.write.options(**_CSV).csv(f"{path}/templates.csv")
    config = {
        "dataset": {"name": "alerts", "mode": "match", "output_dir": f"{path}/out"},
        "parsing": {
            "log_line_pattern": i.ALERT_LOG_PATTERN, "masking_patterns": [{"pattern": p, "mask": m} for p, m in i.ALERT_LOG_MASKS],
            "label_extraction": "bgl", "templates_file": f"{path}/templates.csv",
        },
        "sequencing": {"grouping_strategy": "sliding_window", "window_size": 20, "stride": 5},
        "features": {"save_occurrence_matrix": True, "save_statistical": True},
        "output": {"save_templates": True, "save_metadata": True, "save_parsed_logs": True},
    }
    preprocess.run(spark, config, raw=i.alert_lines(spark, folder))
    return f"{path}/out"


def run_rows(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(table, id, value) of the stored tables of a run."""
    join = lambda c, sep=" ": F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
    window = F.split_part("seq_id", F.lit("_"), F.lit(-1))
    cells = F.filter(F.transform("counts", lambda n, k: F.when(n > 0, F.concat_ws(":", k.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    columns = {
        "parsed": (F.col("line_id").cast("string"), F.concat_ws(" ", "event_id", F.col("label").cast("string"), "masked")),
        "templates": (F.col("event_id"), F.col("occurrence_count").cast("string")),
        "sequences": (F.col("window_start").cast("string"), F.concat_ws(" ", join("events"), F.col("label").cast("string"))),
        "metadata": (F.col("window_start").cast("string"), F.concat_ws(" ", "strategy", F.col("window_end").cast("string"), F.col("length").cast("string"))),
        "vocabulary": (F.col("event"), F.col("idx").cast("string")),
        "padded": (window, join("ids")),
        "occurrence": (window, F.array_join(cells, " ")),
        "statistics": (window, F.concat_ws(" ", *[F.col(c).cast("string") for c in ("seq_length", "unique_events", "max_event_freq")])),
    }
    out = None
    for name in names:
        if name == "summary":
            rows = summary.read_summary(spark, f"{path}/summary_text").where(F.col("key").isin("num_sequences", "anomaly_sequences", "vocab_size"))
            rows = rows.select(F.lit(name).alias("table"), F.col("key").alias("id"), "value")
        else:
            key, value = columns[name]
            rows = spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("table"), key.alias("id"), value.alias("value"))
        out = rows if out is None else out.union(rows)
    return out


RUN_TABLES = ("parsed", "templates", "sequences", "metadata", "vocabulary", "padded", "occurrence", "statistics", "summary")


@add("match_run_tables", f'WITH {MATCH_RUN_SQL} SELECT "table", id, value FROM run_tables')
def match_run_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored table of a run in mode ``match``: parsed lines, templates, sequences, features, metadata and summary text."""
    return run_rows(spark, match_run(spark, folder), RUN_TABLES)


LOADED = ("templates", "sequences", "vocabulary", "summary")


@add("load_run_tables", f"""WITH {MATCH_RUN_SQL} SELECT "table", id, value FROM run_tables WHERE "table" IN {LOADED}""")
def load_run_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A run in mode ``load`` over the tables of an earlier run."""
    out = f"{scratch_folder(spark, 'run')}/out"
    preprocess.run(spark, {"dataset": {"name": "alerts", "mode": "load", "output_dir": out}, "loading": {"source_dir": match_run(spark, folder)}})
    return run_rows(spark, out, LOADED)
