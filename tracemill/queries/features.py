"""Vocabulary, padding, occurrence, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import features, sequences
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.sequences import WINDOWS_SQL, block_log_sequences, event_sequences

REGISTRY = Registry()
add = REGISTRY.add

EVENTS = ["click", "error", "purchase", "signup", "view"]
_CASES = " ".join(f"WHEN '{e}' THEN {n}" for n, e in enumerate(EVENTS, 1))


def ids_text():
    return F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids")



VOCAB_SQL = f"""{i.SEQUENCES},
vocab AS (
  SELECT event, CAST(row_number() OVER (ORDER BY event) AS INTEGER) AS idx FROM (SELECT DISTINCT event_id AS event FROM event_log)
  UNION ALL SELECT '<PAD>', 0),
coded AS (
  SELECT block_id AS seq_id, list(v.idx ORDER BY line_id) AS ids, max(label) AS label
  FROM event_log JOIN vocab v ON event_id = v.event GROUP BY block_id)"""


@add("vocabulary", f"WITH {VOCAB_SQL} SELECT event, idx FROM vocab")
def vocabulary(spark, folder):
    return features.vocabulary(event_sequences(spark, folder))


@add(
    "block_log_vocabulary",
    f"""WITH {i.BLOCK_SEQUENCES} SELECT event, CAST(row_number() OVER (ORDER BY event) AS INTEGER) AS idx
    FROM (SELECT DISTINCT unnest(events) AS event FROM block_seqs) UNION ALL SELECT '<PAD>', 0""",
)
def block_log_vocabulary(spark, folder):
    return features.vocabulary(block_log_sequences(spark, folder))


def _padded_sql(low: str) -> str:
    return f"""WITH {VOCAB_SQL}, cut AS (SELECT seq_id, label, ids[{low}] AS ids FROM coded)
    SELECT seq_id, label, array_to_string(list_concat(ids, [0 FOR x IN range(60 - len(ids))]), ' ') AS ids FROM cut"""


@add("padded_head", _padded_sql("1:60"))
def padded_head(spark, folder):
    seqs = event_sequences(spark, folder)
    return features.padded(seqs, features.vocabulary(seqs), 60, "head").select("seq_id", "label", ids_text())


@add("padded_tail", _padded_sql("greatest(1, len(ids) - 59):len(ids)"))
def padded_tail(spark, folder):
    seqs = event_sequences(spark, folder)
    return features.padded(seqs, features.vocabulary(seqs), 60, "tail").select("seq_id", "label", ids_text())


@add(
    "padded_longest",
    f"""WITH {VOCAB_SQL}, width AS (SELECT max(length) AS w FROM seqs)
    SELECT seq_id, label, array_to_string(list_concat(ids, [0 FOR x IN range(w - len(ids))]), ' ') AS ids FROM coded, width""",
)
def padded_longest(spark, folder):
    seqs = event_sequences(spark, folder)
    return features.padded(seqs, features.vocabulary(seqs)).select("seq_id", "label", ids_text())


@add(
    "encode_with_unknown",
    f"""WITH {i.EVENT_LOG} SELECT block_id AS seq_id, string_agg(CASE event_id WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 0 END::VARCHAR, ' ' ORDER BY line_id) AS ids,
    CAST(count(*) FILTER (WHERE event_id NOT IN ('click', 'error')) AS INTEGER) AS oov_count FROM event_log GROUP BY block_id""",
)
def encode_with_unknown(spark, folder):
    vocab = spark.createDataFrame([("<PAD>", 0), ("click", 1), ("error", 2)], "event STRING, idx INT")
    return features.encode(event_sequences(spark, folder), vocab).select("seq_id", ids_text(), "oov_count")


@add("decode", f"WITH {i.SEQUENCES} SELECT seq_id, array_to_string(events, ' ') AS events FROM seqs")
def decode(spark, folder):
    seqs = event_sequences(spark, folder)
    vocab = features.vocabulary(seqs)
    return features.decode(features.padded(seqs, vocab), vocab).select("seq_id", F.array_join("events", " ").alias("events"))


@add("p95_length", f"WITH {i.SEQUENCES} SELECT CAST(floor(quantile_cont(length, 0.95)) AS INTEGER) AS max_length FROM seqs")
def p95_length(spark, folder):
    return features.p95_length(event_sequences(spark, folder))


@add("occurrence_long", f"WITH {i.STATS} SELECT seq_id, event, n FROM event_n")
def occurrence_long(spark, folder):
    return features.occurrence(event_sequences(spark, folder))


@add(
    "block_log_occurrence",
    f"WITH {i.BLOCK_SEQUENCES} SELECT seq_id, event, count(*) AS n FROM (SELECT seq_id, unnest(events) AS event FROM block_seqs) GROUP BY 1, 2",
)
def block_log_occurrence(spark, folder):
    return features.occurrence(block_log_sequences(spark, folder))


@add(
    "occurrence_known_events",
    f"WITH {i.STATS} SELECT seq_id, event, n FROM event_n WHERE event IN ('click', 'error')",
)
def occurrence_known_events(spark, folder):
    vocab = spark.createDataFrame([("<PAD>", 0), ("click", 1), ("error", 2)], "event STRING, idx INT")
    return features.occurrence(event_sequences(spark, folder), vocab)


_WIDE = ", ".join(f"count(*) FILTER (WHERE event_id = '{e}') AS {e}" for e in EVENTS)


@add(
    "occurrence_wide",
    f"WITH {i.EVENT_LOG} SELECT block_id AS seq_id, {_WIDE}, max(label) AS label FROM event_log GROUP BY block_id",
)
def occurrence_wide(spark, folder):
    return features.occurrence_wide(event_sequences(spark, folder), EVENTS)


@add(
    "occurrence_dense",
    f"""WITH {i.EVENT_LOG} SELECT block_id AS seq_id, max(label) AS label,
    '0 ' || {" || ' ' || ".join(f"count(*) FILTER (WHERE event_id = '{e}')" for e in EVENTS)} AS counts FROM event_log GROUP BY block_id""",
)
def occurrence_dense(spark, folder):
    seqs = event_sequences(spark, folder)
    dense = features.occurrence_dense(seqs, features.vocabulary(seqs))
    return dense.withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), " "))


@add("occurrence_unpivot", f"WITH {i.STATS} SELECT seq_id, event, n FROM event_n")
def occurrence_unpivot(spark, folder):
    return features.unpivoted(occurrence_wide(spark, folder), "seq_id", EVENTS)


def rounded(stats):
    return stats.select(
        "seq_id",
        "label",
        "seq_length",
        "unique_events",
        F.round("entropy", 6).alias("entropy"),
        "max_event_freq",
        F.round("repetition_rate", 6).alias("repetition_rate"),
        F.round("diversity", 6).alias("diversity"),
    )


ROUNDED = """seq_id, label, seq_length, unique_events, round(entropy, 6) AS entropy, max_event_freq,
round(repetition_rate, 6) AS repetition_rate, round(diversity, 6) AS diversity"""


@add("sequence_stats", f"WITH {i.STATS} SELECT {ROUNDED} FROM stats")
def sequence_stats(spark, folder):
    return rounded(features.statistics(event_sequences(spark, folder)))


_STATS_OF = """counted AS (SELECT seq_id, label, len(events) AS length, unnest(events) AS event FROM {0}),
n AS (SELECT seq_id, label, length, event, count(*) AS n FROM counted GROUP BY ALL),
stats AS (SELECT seq_id, label, CAST(length AS INTEGER) AS seq_length, CAST(count(*) AS INTEGER) AS unique_events,
  sum(-(n / length) * log2(n / length + 1e-10)) AS entropy, max(n) AS max_event_freq, max(n) / length AS repetition_rate,
  count(*) / length AS diversity FROM n GROUP BY seq_id, label, length)"""


@add("block_log_stats", f"WITH {i.BLOCK_SEQUENCES}, {_STATS_OF.format('block_seqs')} SELECT {ROUNDED} FROM stats")
def block_log_stats(spark, folder):
    return rounded(features.statistics(block_log_sequences(spark, folder)))


@add(
    "window_stats",
    f"""WITH {WINDOWS_SQL}, w AS (SELECT CAST(window_start AS VARCHAR) AS seq_id, label, events FROM windows), {_STATS_OF.format('w')}
    SELECT {ROUNDED} FROM stats""",
)
def window_stats(spark, folder):
    windows = sequences.build(i.event_log(spark, folder), "sliding_window", window_size=20, stride=5)
    return rounded(features.statistics(windows))


@add(
    "dataset_info",
    f"""WITH {i.SEQUENCES} SELECT count(*) AS num_sequences, CAST(max(length) AS INTEGER) AS max_length,
    (SELECT count(DISTINCT event_id) + 1 FROM event_log) AS vocab_size,
    count(*) FILTER (WHERE label = 0) AS normal_count, count(*) FILTER (WHERE label = 1) AS anomaly_count FROM seqs""",
)
def dataset_info(spark, folder):
    seqs = event_sequences(spark, folder)
    vocab = features.vocabulary(seqs)
    return features.dataset_info(features.padded(seqs, vocab), vocab)


@add(
    "padding_removed",
    f"""WITH {i.SEQUENCES} SELECT seq_id, CAST(least(length, 60) AS INTEGER) AS effective_length,
    CAST(list_unique(events[1:60]) AS INTEGER) AS distinct_ids FROM seqs""",
)
def padding_removed(spark, folder):
    from tracemill.functions import arrays

    seqs = event_sequences(spark, folder)
    padded = features.padded(seqs, features.vocabulary(seqs), 60)
    return padded.select(
        "seq_id",
        arrays.effective_length(F.col("ids")).alias("effective_length"),
        arrays.distinct_count(arrays.without_padding(F.col("ids"))).alias("distinct_ids"),
    )
