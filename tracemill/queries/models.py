"""Splits, next-event model, isolation forest, metrics, and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import explore, features, iforest, matching, metrics, nextevent, sequences, split
from tracemill.plans import experiments, preprocess
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.explore import rounded
from tracemill.queries.sequences import block_labelled, block_log_events, block_log_sequences, event_sequences
from tracemill.queries.templates import mining_sql
from tracemill.session import materialise
from tracemill.sources import logs

REGISTRY = Registry()
add = REGISTRY.add

ORDER, TOP_K = 2, 3

def split_sql(seqs: str = "seqs", train: float = 0.7, val: float = 0.15, test: float = 0.15) -> str:
    """``splits`` (seq_id, label, split) of the sequences in ``seqs``."""
    return f"""
split_ranked AS (
  SELECT seq_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || seq_id)) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM {seqs}),
split_sized AS (SELECT *, floor(n * CAST({test} AS DOUBLE) + 0.5) AS n_test FROM split_ranked),
splits AS (
  SELECT seq_id, label, CASE WHEN r < n_test THEN 'test'
    WHEN r < n_test + floor((n - n_test) * (CAST({val} AS DOUBLE) / (CAST({train} AS DOUBLE) + CAST({val} AS DOUBLE))) + 0.5) THEN 'val' ELSE 'train' END AS split
  FROM split_sized)"""


SPLIT_SQL = f"{i.SEQUENCES}, {split_sql()}"


@add("stratified_split", f"WITH {SPLIT_SQL} SELECT seq_id, label, split FROM splits")
def stratified_split(spark, folder):
    return split.stratified(event_sequences(spark, folder)).select("seq_id", "label", "split")


@add("split_counts", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS anomalies FROM splits GROUP BY split")
def split_counts(spark, folder):
    return split.split_counts(split.stratified(event_sequences(spark, folder)))


@add("contamination", f"WITH {SPLIT_SQL} SELECT round(avg(label), 6) AS contamination FROM splits WHERE split = 'train'")
def contamination(spark, folder):
    return rounded(explore.contamination(split.stratified(event_sequences(spark, folder))))


def text_of(column: str):
    return F.array_join(column, " ").alias(column)


MOVES_SQL = f"""{i.SEQUENCES},
placed AS (
  SELECT e.block_id AS seq_id, s.label, event_id AS next, row_number() OVER w - 1 AS position,
         lag(event_id, 1) OVER w AS c1, lag(event_id, 2) OVER w AS c2
  FROM event_log e JOIN seqs s ON e.block_id = s.seq_id WINDOW w AS (PARTITION BY e.block_id ORDER BY line_id)),
moves AS (SELECT seq_id, label, position, concat_ws(' ', c2, c1) AS context, next FROM placed WHERE position > 0)"""

def model_sql(train: str = "label = 0", test: str = "true") -> str:
    """The model, its verdict on each transition, and detection, as SQL over the event log."""
    return f"""{MOVES_SQL},
suffixes AS (
  SELECT m.*, k, CASE k WHEN 0 THEN '' WHEN 1 THEN split_part(context, ' ', -1) ELSE context END AS suffix
  FROM moves m, (VALUES (0), (1), (2)) AS o(k) WHERE k < 2 OR context LIKE '% %'),
counted AS (SELECT k, suffix, next, count(*) AS n FROM suffixes WHERE {train} GROUP BY 1, 2, 3),
model AS (
  SELECT *, sum(n) OVER (PARTITION BY k, suffix) AS total, row_number() OVER (PARTITION BY k, suffix ORDER BY n DESC, next) AS r FROM counted),
chosen AS (
  SELECT s.seq_id, s.label, s.position, s.context, s.next, max(s.k) AS k, max_by(s.suffix, s.k) AS suffix
  FROM suffixes s WHERE s.k = 0 OR EXISTS (SELECT 1 FROM model m WHERE m.k = s.k AND m.suffix = s.suffix) GROUP BY 1, 2, 3, 4, 5),
judged AS (
  SELECT c.*, m.n, m.r, t.total, CASE WHEN m.r <= {TOP_K} THEN 0 ELSE 1 END AS miss
  FROM chosen c LEFT JOIN model m ON c.k = m.k AND c.suffix = m.suffix AND c.next = m.next
  LEFT JOIN (SELECT DISTINCT k, suffix, total FROM model) t ON c.k = t.k AND c.suffix = t.suffix),
detected AS (
  SELECT s.seq_id, s.label, CAST(coalesce(max(miss), 0) AS INTEGER) AS pred, CAST(coalesce(sum(miss), 0) AS BIGINT) AS misses, count(j.position) AS transitions
  FROM seqs s LEFT JOIN judged j USING (seq_id) WHERE {test} GROUP BY s.seq_id, s.label)"""


MODEL_SQL = model_sql()


def model(spark, folder):
    return nextevent.fit(split.normal_only(event_sequences(spark, folder)), ORDER)


@add("next_pairs", f"WITH {MOVES_SQL} SELECT seq_id, position, context, next FROM moves")
def next_pairs(spark, folder):
    moves = nextevent.transitions(event_sequences(spark, folder), ORDER)
    return moves.select("seq_id", "position", text_of("context"), "next")


@add(
    "next_topk",
    f"WITH {MODEL_SQL} SELECT suffix AS context, CAST(r AS INTEGER) AS rank, next, round(n / total, 6) AS probability FROM model WHERE r <= {TOP_K}",
)
def next_topk(spark, folder):
    return rounded(nextevent.topk(model(spark, folder), TOP_K).withColumn("context", F.array_join("context", " ")))


@add(
    "next_predict",
    f"""WITH {MODEL_SQL} SELECT DISTINCT c.context, CAST(m.r AS INTEGER) AS rank, m.next, round(m.n / m.total, 6) AS probability
    FROM chosen c JOIN model m ON c.k = m.k AND c.suffix = m.suffix WHERE m.r <= {TOP_K}""",
)
def next_predict(spark, folder):
    moves = nextevent.transitions(event_sequences(spark, folder), ORDER)
    predicted = nextevent.predict(model(spark, folder), moves, TOP_K)
    return rounded(predicted.withColumn("context", F.array_join("context", " ")))


@add(
    "next_misses",
    f"""WITH {MODEL_SQL}, tops AS (SELECT k, suffix, string_agg(next, ' ' ORDER BY r) AS expected FROM model WHERE r <= {TOP_K} GROUP BY 1, 2)
    SELECT seq_id, label, position, context, next, expected FROM judged JOIN tops USING (k, suffix) WHERE miss = 1""",
)
def next_misses(spark, folder):
    missed = nextevent.misses(model(spark, folder), event_sequences(spark, folder), TOP_K)
    return missed.select("seq_id", "label", "position", text_of("context"), "next", text_of("expected"))


@add("next_detect", f"WITH {MODEL_SQL} SELECT seq_id, label, pred, misses, transitions FROM detected")
def next_detect(spark, folder):
    return nextevent.detect(model(spark, folder), event_sequences(spark, folder), TOP_K)


@add(
    "next_loss",
    f"""WITH {MODEL_SQL}, v AS (SELECT count(*) AS events FROM model WHERE k = 0)
    SELECT round(avg(-ln((coalesce(n, 0) + 1.0) / (coalesce(total, 0) + events + 1))), 6) AS loss FROM judged, v""",
)
def next_loss(spark, folder):
    return rounded(nextevent.loss(model(spark, folder), event_sequences(spark, folder)))


BLOCK_LOG_SQL = f"""{i.BLOCK_SEQUENCES},
log AS (
  SELECT m.block_id AS seq_id, s.label, m.line_id, 'e' || lpad(CAST(dense_rank() OVER (ORDER BY m.masked) AS VARCHAR), 9, '0') AS event
  FROM block_masked m JOIN block_seqs s ON m.block_id = s.seq_id)"""
EVENT_LOG_SQL = f"""{i.SEQUENCES},
log AS (SELECT e.block_id AS seq_id, s.label, e.line_id, e.event_id AS event FROM event_log e JOIN seqs s ON e.block_id = s.seq_id)"""


def back_off_sql(order: int, train: str) -> str:
    """Transitions of ``log`` (seq_id, label, line_id, event) with every suffix of up to ``order`` events, and the model of those in ``train``."""
    lags = "".join(f", lag(event, {k}) OVER w AS c{k}" for k in range(1, order + 1))
    each = [
        f"SELECT seq_id, label, position, next, {k} AS k, {'concat_ws(' + repr(' ') + ', ' + ', '.join(f'c{j}' for j in range(k, 0, -1)) + ')' if k else repr('')} AS suffix "
        f"FROM steps WHERE position >= {max(k, 1)}"
        for k in range(order + 1)
    ]
    return f"""
steps AS (SELECT seq_id, label, event AS next, row_number() OVER w - 1 AS position{lags} FROM log WINDOW w AS (PARTITION BY seq_id ORDER BY line_id)),
suffixes AS ({" UNION ALL ".join(each)}),
counted AS (SELECT k, suffix, next, count(*) AS n FROM suffixes WHERE {train} GROUP BY 1, 2, 3),
model AS (
  SELECT *, sum(n) OVER (PARTITION BY k, suffix) AS total, row_number() OVER (PARTITION BY k, suffix ORDER BY n DESC, next) AS r FROM counted),
known AS (SELECT DISTINCT k, suffix, total FROM model)"""


def detected_sql(order: int, top_k: int, train: str) -> str:
    return f"""{back_off_sql(order, train)},
chosen AS (
  SELECT s.seq_id, s.position, s.next, max(s.k) AS k, max_by(s.suffix, s.k) AS suffix
  FROM suffixes s JOIN known m ON m.k = s.k AND m.suffix = s.suffix GROUP BY 1, 2, 3),
judged AS (
  SELECT c.seq_id, CASE WHEN m.r <= {top_k} THEN 0 ELSE 1 END AS miss
  FROM chosen c LEFT JOIN model m ON c.k = m.k AND c.suffix = m.suffix AND c.next = m.next),
detected AS (
  SELECT l.seq_id, l.label, CAST(coalesce(max(miss), 0) AS INTEGER) AS pred, CAST(coalesce(sum(miss), 0) AS BIGINT) AS misses, count(miss) AS transitions
  FROM (SELECT DISTINCT seq_id, label FROM log) l LEFT JOIN judged j USING (seq_id) GROUP BY 1, 2)"""


@add(
    "next_event_selection",
    f"""WITH {EVENT_LOG_SQL}, {split_sql()},
    {back_off_sql(3, "label = 0 AND seq_id IN (SELECT seq_id FROM splits WHERE split = 'train')")},
    best AS (
      SELECT o, s.seq_id, s.position, s.next, max(s.k) AS k, max_by(s.suffix, s.k) AS suffix
      FROM suffixes s JOIN known m ON m.k = s.k AND m.suffix = s.suffix JOIN (VALUES (0), (1), (2), (3)) AS orders(o) ON s.k <= o
      WHERE s.seq_id IN (SELECT seq_id FROM splits WHERE split = 'val') GROUP BY 1, 2, 3, 4),
    losses AS (
      SELECT o, avg(-ln((coalesce(m.n, 0) + 1.0) / (t.total + (SELECT count(*) FROM model WHERE k = 0) + 1))) AS loss
      FROM best b LEFT JOIN model m ON b.k = m.k AND b.suffix = m.suffix AND b.next = m.next JOIN known t ON b.k = t.k AND b.suffix = t.suffix GROUP BY o),
    firsts AS (SELECT max(loss) FILTER (o = 0) AS l0, max(loss) FILTER (o = 1) AS l1, max(loss) FILTER (o = 2) AS l2 FROM losses)
    SELECT CAST(o AS INTEGER) AS "order", round(loss, 6) AS val_loss FROM losses, firsts WHERE o < 3 OR l1 < l0 OR l2 < least(l0, l1)""",
)
def next_event_selection(spark, folder):
    """Validation loss for each context length until it stops improving."""
    parts = materialise(split.stratified(event_sequences(spark, folder)))
    _, history = nextevent.select(
        split.normal_only(parts.where("split = 'train'")), parts.where("split = 'val'"), max_order=3, patience=2
    )
    return rounded(spark.createDataFrame(history, "order INT, val_loss DOUBLE"))


@add(
    "block_log_next_detect",
    f"WITH {BLOCK_LOG_SQL}, {detected_sql(3, 2, 'label = 0')} SELECT seq_id, label, pred, misses, transitions FROM detected",
)
def block_log_next_detect(spark, folder):
    seqs = materialise(block_log_sequences(spark, folder))
    return nextevent.detect(nextevent.fit(split.normal_only(seqs), 3), seqs, 2)


@add(
    "next_event_experiment",
    f"""WITH {BLOCK_LOG_SQL}, {split_sql("block_seqs")},
    {detected_sql(2, 2, "label = 0 AND seq_id IN (SELECT seq_id FROM splits WHERE split = 'train')")},
    c AS (
      SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
        count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
      FROM detected WHERE seq_id IN (SELECT seq_id FROM splits WHERE split = 'test'))
    SELECT round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tn, fp, fn, tp FROM c""",
)
def next_event_experiment(spark, folder):
    """Split, fit, detect, evaluate on the block log."""
    return rounded(experiments.next_event_experiment(block_log_sequences(spark, folder), top_k=2, order=2).metrics)


_EVEN, _ODD = (f"CAST(seq_id AS BIGINT) % 2 = {r}" for r in (0, 1))


@add(
    "cross_dataset_detect",
    f"""WITH {model_sql("label = 0 AND " + _EVEN, _ODD)} SELECT seq_id, label, pred, misses, transitions FROM detected""",
)
def cross_dataset_detect(spark, folder):
    """Learn from even users' sequences, test on odd users'; both halves together are the whole log."""
    seqs = materialise(event_sequences(spark, folder))
    even = F.col("seq_id").cast("bigint") % 2 == 0
    return experiments.cross_dataset_next_event(seqs.where(even), seqs.where(~even), 2, TOP_K).predictions


def _tokens_sql(catalogue: str) -> str:
    return f"(SELECT DISTINCT t, unnest(regexp_split_to_array(t, '\\s+')) AS w FROM (SELECT DISTINCT masked AS t FROM {catalogue}))"


LEAST_ALIKE = 0.2
ALIGN_SQL = f"""{i.BLOCK_SEQUENCES}, {i.ALERT_MASKED},
known_tokens AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {_tokens_sql("block_masked")} WHERE w NOT IN ('', '<*>')),
other_tokens AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {_tokens_sql("alert_masked")} WHERE w NOT IN ('', '<*>')),
alike AS (SELECT o.t, k.t AS known_id, 2.0::DOUBLE * count(*) / (max(o.n) + max(k.n)) AS similarity FROM other_tokens o JOIN known_tokens k USING (w) GROUP BY 1, 2),
alignment AS (
  SELECT t AS event_id, known_id, similarity FROM alike WHERE similarity >= {LEAST_ALIKE}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY similarity DESC, known_id) = 1)"""


def catalogue_of(lines):
    """Distinct masked messages as templates under their own text."""
    return lines.select(F.col("masked").alias("event_id"), F.col("masked").alias("event_template")).distinct()


def alert_messages(spark, folder):
    return logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN, i.ALERT_LOG_MASKS).select("line_id", "masked")


def both_catalogues(spark, folder):
    alerts = alert_messages(spark, folder)
    blocks = logs.parse(i.block_lines(spark, folder), i.BLOCK_LOG_PATTERN, i.BLOCK_LOG_MASKS).select("masked")
    return alerts, materialise(catalogue_of(alerts)), materialise(catalogue_of(blocks))


@add("catalogue_alignment", f"WITH {ALIGN_SQL} SELECT event_id, known_id, round(similarity, 6) AS similarity FROM alignment")
def catalogue_alignment(spark, folder):
    """For each message shape of one log the most similar one of the other."""
    _, other, known = both_catalogues(spark, folder)
    return rounded(matching.aligned(other, known, LEAST_ALIKE))


@add(
    "cross_catalogue_detect",
    f"""WITH {ALIGN_SQL},
    texts AS (
      SELECT 'a' || m.block_id AS seq_id, s.label, m.line_id, m.masked AS t FROM block_masked m JOIN block_seqs s ON m.block_id = s.seq_id
      UNION ALL SELECT 'b' || e.user_id, max(CASE WHEN e.value > {i.ANOMALOUS_VALUE} THEN 1 ELSE 0 END) OVER (PARTITION BY e.user_id), a.line_id, coalesce(known_id, '<UNK>')
      FROM alert_masked a JOIN events e ON a.line_id = e.event_id LEFT JOIN alignment l ON a.masked = l.event_id),
    log AS (SELECT seq_id, label, line_id, 'e' || lpad(CAST(dense_rank() OVER (ORDER BY t) AS VARCHAR), 9, '0') AS event FROM texts),
    {detected_sql(2, 2, "label = 0 AND seq_id LIKE 'a%'")}
    SELECT substr(seq_id, 2) AS seq_id, label, pred, misses, transitions FROM detected WHERE seq_id LIKE 'b%'""",
)
def cross_catalogue_detect(spark, folder):
    """Learn from the block log, test on the alert log in the block log's events."""
    alerts = alert_messages(spark, folder)
    blocks = block_log_events(spark, folder)  # the masked lines, made once for the catalogue and the sequences
    other, known = materialise(catalogue_of(alerts)), materialise(catalogue_of(blocks.select(F.col("event_id").alias("masked"))))
    log = i.event_log(spark, folder).select("line_id", "block_id", "label")
    lines = alerts.withColumnRenamed("masked", "event_id").join(log, "line_id")
    seqs = materialise(block_labelled(spark, folder, sequences.build(blocks, "block_id")))
    return experiments.cross_catalogue_next_event(seqs, known, lines, other, LEAST_ALIKE, 2, 2).predictions


SCORED = f"SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CASE WHEN value > 60 THEN 1 ELSE 0 END AS pred, value AS score FROM events"


def scored(spark, folder):
    e = i.table(spark, folder, "events")
    return e.select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("value") > 60, 1).otherwise(0).alias("pred"),
        F.col("value").alias("score"),
    )


CONFUSION_SQL = f"""scored AS ({SCORED}),
c AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored)"""

AUC_SQL = """ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored),
area AS (SELECT (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc FROM ranked)"""


@add("confusion", f"WITH {CONFUSION_SQL} SELECT tn, fp, fn, tp FROM c")
def confusion(spark, folder):
    return metrics.confusion(scored(spark, folder))


@add(
    "metrics",
    f"""WITH {CONFUSION_SQL}, {AUC_SQL}
    SELECT round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tn, fp, fn, tp, round(auc, 6) AS auc FROM c, area""",
)
def evaluate(spark, folder):
    return rounded(metrics.evaluate(scored(spark, folder), score="score"))


@add("roc_auc", f"WITH scored AS ({SCORED}), {AUC_SQL} SELECT round(auc, 6) AS auc FROM area")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored(spark, folder)))


@add(
    "roc_points",
    f"""WITH scored AS ({SCORED}), s AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM scored GROUP BY score)
    SELECT round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, score AS threshold
    FROM s WINDOW w AS (ORDER BY score DESC)""",
)
def roc_points(spark, folder):
    return rounded(metrics.roc_points(scored(spark, folder)))


@add(
    "min_max_scores",
    "SELECT event_id, round(1 - (value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS proba FROM events",
)
def min_max_scores(spark, folder):
    return rounded(metrics.min_max_flipped(i.table(spark, folder, "events"), "value").select("event_id", "proba"))


def _h(*parts: str) -> str:
    joined = " || '/' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def _average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {iforest.EULER_GAMMA}::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} END"


def forest_sql(trees: int = 100, samples: int = 256, seed: int = 42, max_features: float = 1.0, width: str = "0") -> str:
    """``forest_raw`` (seq_id, raw) of all ``scored_rows`` by a forest fitted on ``fitted_rows`` (seq_id VARCHAR both), whose non-zero
    entries are in ``entries`` (seq_id, idx, value). Levels are written out, as many as a sample can have."""
    p, depth = iforest.PRIME, max(1, (samples - 1).bit_length())
    allowed = "true" if max_features >= 1 else "(tree, idx) IN (SELECT (tree, idx) FROM forest_features)"
    out = [f"""
forest_trees AS (SELECT t::INTEGER AS tree, 1 + {_h(str(seed), "'a'", "t")} % {p - 1} AS a, {_h(str(seed), "'b'", "t")} % {p} AS b FROM range({trees}) r(t)),
forest_size AS (SELECT least({samples}, count(*)) AS psi, ceil(log2(greatest(least({samples}, count(*)), 2))) AS deepest FROM fitted_rows),
forest_features AS (
  SELECT tree, idx FROM (SELECT tree, f AS idx, row_number() OVER (PARTITION BY tree ORDER BY {_h(str(seed), "'feature'", "tree", "f")}, f) AS k
  FROM forest_trees, range({width}) r(f)) WHERE k <= greatest(1, round_even({max_features}::DOUBLE * {width}, 0))),
level_0 AS MATERIALIZED (
  SELECT tree, seq_id, 0 AS node FROM (
    SELECT tree, seq_id, row_number() OVER (PARTITION BY tree ORDER BY ({_h("seq_id")} % {p} * a + b) % {p}, seq_id) AS k FROM fitted_rows, forest_trees)
  WHERE k <= (SELECT psi FROM forest_size))"""]
    for d in range(depth + 1):
        out.append(f"size_{d} AS MATERIALIZED (SELECT tree, node, count(*) AS size FROM level_{d} GROUP BY 1, 2)")
        if d == depth:
            out.append(f"nodes_{d} AS (SELECT tree, node, NULL::BIGINT AS feature, NULL::DOUBLE AS threshold, size, {d} AS depth FROM size_{d})")
            break
        out.append(f"""
range_{d} AS (
  SELECT s.tree, s.node, s.idx, CASE WHEN n < size THEN least(low, 0) ELSE low END AS low, CASE WHEN n < size THEN greatest(high, 0) ELSE high END AS high
  FROM (SELECT tree, node, idx, min(value) AS low, max(value) AS high, count(*) AS n FROM level_{d} JOIN entries USING (seq_id) GROUP BY 1, 2, 3) s
  JOIN size_{d} z ON s.tree = z.tree AND s.node = z.node),
pick_{d} AS MATERIALIZED (
  SELECT tree, node, idx AS feature, low + ({_h(str(seed), "tree", "node")}::DOUBLE / {float(1 << 60)}::DOUBLE) * (high - low) AS threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {_h(str(seed), "tree", "node", "idx")}, idx) AS k FROM range_{d} WHERE high > low AND {allowed})
  WHERE k = 1 AND {d} < (SELECT deepest FROM forest_size)),
nodes_{d} AS (SELECT tree, node, feature, threshold, size, {d} AS depth FROM size_{d} LEFT JOIN pick_{d} USING (tree, node)),
level_{d + 1} AS MATERIALIZED (
  SELECT l.tree, l.seq_id, 2 * l.node + 1 + (coalesce(value, 0) > threshold)::INTEGER AS node FROM level_{d} l
  JOIN pick_{d} k ON l.tree = k.tree AND l.node = k.node LEFT JOIN entries e ON l.seq_id = e.seq_id AND k.feature = e.idx)""")
    nodes = " UNION ALL ".join(f"SELECT * FROM nodes_{d}" for d in range(depth + 1))
    out.append(f"forest_nodes AS MATERIALIZED ({nodes})")
    out.append("walk_0 AS (SELECT tree, seq_id, 0 AS node FROM scored_rows, forest_trees)")
    for d in range(depth):
        out.append(f"""walk_{d + 1} AS (
  SELECT w.tree, w.seq_id, CASE WHEN feature IS NULL THEN w.node ELSE 2 * w.node + 1 + (coalesce(value, 0) > threshold)::INTEGER END AS node
  FROM walk_{d} w JOIN forest_nodes n ON w.tree = n.tree AND w.node = n.node LEFT JOIN entries e ON w.seq_id = e.seq_id AND n.feature = e.idx)""")
    path = f"round((depth + {_average_path('size')}) * {float(iforest.PATH_UNIT)}::DOUBLE)::BIGINT"
    out.append(f"""forest_raw AS MATERIALIZED (
  SELECT seq_id, -pow(2.0::DOUBLE, -(sum({path})::DOUBLE / {trees} / {float(iforest.PATH_UNIT)}::DOUBLE
    / (SELECT CASE WHEN psi <= 1 THEN 1 ELSE {_average_path('psi')} END FROM forest_size))) AS raw
  FROM walk_{depth} w JOIN forest_nodes n ON w.tree = n.tree AND w.node = n.node GROUP BY seq_id)""")
    return ",\n".join(out)


def _judged_sql(rows: str, offset: str) -> str:
    """``judged`` (seq_id, score, pred, proba) of the ``rows``."""
    return f"""forest_scored AS (SELECT seq_id, raw - ({offset}) AS score FROM forest_raw WHERE seq_id IN (SELECT seq_id FROM {rows})),
judged AS (
  SELECT seq_id, score, CASE WHEN score < 0 THEN 1 ELSE 0 END AS pred,
    1 - coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0) AS proba FROM forest_scored)"""


_EVENT_ENTRIES = f"""{i.STATS},
vocab AS (SELECT event, row_number() OVER (ORDER BY event) AS idx FROM (SELECT DISTINCT event FROM event_n)),
entries AS (SELECT seq_id, idx, n::DOUBLE AS value FROM event_n JOIN vocab USING (event)),
fitted_rows AS (SELECT seq_id FROM seqs), scored_rows AS (SELECT seq_id FROM seqs)"""


@add(
    "iforest_scores",
    f"""WITH {_EVENT_ENTRIES}, {forest_sql()}, {_judged_sql("seqs", "SELECT quantile_cont(raw, 0.1::DOUBLE) FROM forest_raw")}
    SELECT seq_id, label, round(score, 6) AS score, pred, round(proba, 6) AS proba FROM judged JOIN seqs USING (seq_id)""",
)
def iforest_scores(spark, folder):
    """Occurrence vectors of all sequences, scored by a forest fitted on them; one in ten is anomalous."""
    seqs = materialise(event_sequences(spark, folder))
    vectors = materialise(experiments.vectors_of(seqs, features.vocabulary(seqs)))
    forest = iforest.fit(vectors, contamination=0.1)
    return rounded(iforest.score(forest, vectors).drop("vector"))


_EMBEDDING_ENTRIES = """
vectors AS (SELECT vec_id::VARCHAR AS seq_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
cells AS (SELECT seq_id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS idx FROM vectors),
entries AS MATERIALIZED (SELECT * FROM cells WHERE value <> 0),
fitted_rows AS (SELECT seq_id FROM vectors), scored_rows AS (SELECT seq_id FROM vectors)"""


def embedding_vectors(spark, folder):
    rows = i.table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("string").alias("seq_id"), F.col("embedding").cast("array<double>").alias("vector"))


@add(
    "iforest_embeddings",
    f"WITH {_EMBEDDING_ENTRIES}, {forest_sql()}, {_judged_sql('vectors', '-0.5')} SELECT seq_id, round(score, 6) AS score, pred, round(proba, 6) AS proba FROM judged",
)
def iforest_embeddings(spark, folder):
    vectors = embedding_vectors(spark, folder)
    return rounded(iforest.score(iforest.fit(vectors), vectors).drop("vector"))


@add(
    "iforest_some_features",
    f"""WITH {_EMBEDDING_ENTRIES}, {forest_sql(30, 64, 7, 0.25, "(SELECT max(idx) + 1 FROM cells)")}, {_judged_sql('vectors', '-0.5')}
    SELECT seq_id, round(score, 6) AS score, pred, round(proba, 6) AS proba FROM judged""",
)
def iforest_some_features(spark, folder):
    """A smaller forest whose trees each split on a quarter of the features."""
    vectors = embedding_vectors(spark, folder)
    forest = iforest.fit(vectors, n_estimators=30, max_samples=64, seed=7, max_features=0.25)
    return rounded(iforest.score(forest, vectors).drop("vector"))


@add(
    "forest_experiment",
    f"""WITH {i.BLOCK_SEQUENCES}, {split_sql("block_seqs", 0.6, 0.2, 0.2)},
    block_n AS (SELECT block_id AS seq_id, masked AS event, count(*) AS n FROM block_masked WHERE block_id IS NOT NULL GROUP BY 1, 2),
    vocab AS (SELECT event, row_number() OVER (ORDER BY event) AS idx FROM (SELECT DISTINCT event FROM block_n)),
    entries AS MATERIALIZED (SELECT seq_id, idx, n::DOUBLE AS value FROM block_n JOIN vocab USING (event)),
    fitted_rows AS MATERIALIZED (SELECT seq_id FROM splits WHERE split = 'train'), scored_rows AS MATERIALIZED (SELECT seq_id FROM splits WHERE split <> 'val'),
    tested AS (SELECT seq_id FROM splits WHERE split = 'test'),
    {forest_sql()}, train_raw AS (
      SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS r, (count(*) OVER () - 1) * (SELECT avg(label) FROM splits WHERE split = 'train') AS place
      FROM forest_raw WHERE seq_id IN (SELECT seq_id FROM fitted_rows)),
    ends AS (SELECT max(raw) FILTER (r = floor(place)) AS low, max(raw) FILTER (r = ceil(place)) AS high, max(place) AS place FROM train_raw),
    {_judged_sql("tested", "SELECT low + (high - low) * (place - floor(place)) FROM ends")},
    scored AS (SELECT label, pred, proba AS score FROM judged JOIN splits USING (seq_id)),
    c AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored),
    {AUC_SQL}
    SELECT round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
      tn, fp, fn, tp, round(coalesce(auc, 0), 6) AS auc FROM c, area""",
)
def forest_experiment(spark, folder):
    """Split, fit, score, evaluate on the block log's occurrence vectors."""
    seqs = materialise(block_log_sequences(spark, folder))
    return rounded(experiments.forest_experiment(experiments.vectors_of(seqs, features.vocabulary(seqs))).metrics)


@add(
    "full_run_summary",
    f"""WITH RECURSIVE {i.ALERT_MASKED}, {mining_sql("alert_masked")},
    lines AS (
      SELECT a.line_id, CASE WHEN a.raw LIKE '- %' THEN 0 ELSE 1 END AS label, m.event_id, m.event_template FROM alert_masked a JOIN mined m USING (masked)),
    found AS (SELECT event_id, event_template, count(*) AS n FROM lines GROUP BY 1, 2),
    kept AS (SELECT event_id FROM found WHERE n >= 5 AND NOT regexp_matches(event_template, '{"|".join(text.NOISE_PATTERNS)}')),
    numbered AS (
      SELECT row_number() OVER (ORDER BY line_id) - 1 AS i, label, CASE WHEN event_id IN (SELECT event_id FROM kept) THEN event_id ELSE '<UNK>' END AS event
      FROM lines),
    starts AS (SELECT unnest(range(0, (SELECT count(*) FROM lines) - 19, 5)) AS s),
    windows AS (SELECT s, max(label) AS label FROM starts JOIN numbered ON i >= s AND i < s + 20 GROUP BY s)
    SELECT 'alerts' AS dataset, (SELECT count(*) FROM found) AS num_templates, count(*) AS num_sequences,
      count(*) FILTER (label = 0) AS normal_sequences, count(*) FILTER (label = 1) AS anomaly_sequences, round(avg(label), 6) AS anomaly_rate,
      20.0::DOUBLE AS avg_sequence_length, (SELECT count(DISTINCT event) + 1 FROM numbered WHERE i < (SELECT max(s) + 20 FROM starts)) AS vocab_size,
      (SELECT count(*) FROM kept) AS kept_templates FROM windows""",
)
def full_run_summary(spark, folder):
    """A full run over the alert lines: parse, mask, mine, filter, window, features."""
    config = {
        "dataset": {"name": "alerts", "mode": "full"},
        "parsing": {
            "log_line_pattern": i.ALERT_LOG_PATTERN,
            "masking_patterns": [{"pattern": p, "mask": m} for p, m in i.ALERT_LOG_MASKS],
            "label_extraction": "bgl",
            "min_template_occurrence": 5,
        },
        "sequencing": {"grouping_strategy": "sliding_window", "window_size": 20, "stride": 5},
    }
    run = preprocess.run(spark, config, raw=i.alert_lines(spark, folder))
    return rounded(run["summary"].drop("duration_seconds", "timestamp"))


@add(
    "sequence_summary",
    f"""WITH {i.SEQUENCES} SELECT 'events' AS dataset, CAST(0 AS BIGINT) AS num_templates, count(*) AS num_sequences,
    count(*) FILTER (WHERE label = 0) AS normal_sequences, count(*) FILTER (WHERE label = 1) AS anomaly_sequences,
    round(avg(label), 6) AS anomaly_rate, round(avg(length), 6) AS avg_sequence_length,
    (SELECT count(DISTINCT event_id) + 1 FROM event_log) AS vocab_size FROM seqs""",
)
def sequence_summary(spark, folder):
    seqs = event_sequences(spark, folder)
    return rounded(preprocess.sequence_summary(seqs, features.vocabulary(seqs), None, "events"))
