"""Exploration of sequences and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import explore, features, split
from tracemill.plans import report
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.features import EVENTS
from tracemill.queries.sequences import block_log_sequences, event_sequences
from tracemill.session import materialise

REGISTRY = Registry()
add = REGISTRY.add


def rounded(df, *keep):
    """Doubles at six decimals, so that the last bits of a sum do not matter."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


def stats(spark, folder):
    return features.statistics(event_sequences(spark, folder))


@add(
    "class_distribution",
    f"""WITH {i.BLOCK_SEQUENCES} SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM block_seqs), 6)::DOUBLE AS percent
    FROM block_seqs GROUP BY label""",
)
def class_distribution(spark, folder):
    return rounded(explore.class_distribution(block_log_sequences(spark, folder)))


@add(
    "class_balance",
    f"""WITH {i.SEQUENCES} SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS anomaly,
    round(avg(label) * 100, 6) AS anomaly_percent, round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS imbalance_ratio FROM seqs""",
)
def class_balance(spark, folder):
    return rounded(explore.class_balance(event_sequences(spark, folder)))


def _summary_sql(column: str) -> str:
    return f"""count({column}) AS n, min({column}) AS min, max({column}) AS max, round(avg({column}), 6) AS mean,
    round(quantile_cont({column}, 0.5), 6) AS median, round(stddev_pop({column}), 6) AS std"""


@add("length_stats", f"WITH {i.SEQUENCES} SELECT {_summary_sql('length')} FROM seqs")
def length_stats(spark, folder):
    return rounded(explore.length_stats(event_sequences(spark, folder)))


@add("length_stats_by_class", f"WITH {i.BLOCK_SEQUENCES} SELECT label, {_summary_sql('length')} FROM block_seqs GROUP BY label")
def length_stats_by_class(spark, folder):
    return rounded(explore.length_stats(block_log_sequences(spark, folder), "label"))


@add(
    "length_comparison",
    f"""WITH {i.SEQUENCES}, s AS (SELECT label, {_summary_sql('length')} FROM seqs GROUP BY label),
    long AS (UNPIVOT (SELECT label, n::DOUBLE AS n, min::DOUBLE AS min, max::DOUBLE AS max, mean, median, std FROM s)
             ON n, min, max, mean, median, std INTO NAME metric VALUE value)
    SELECT metric, max(value) FILTER (WHERE label = 0) AS normal, max(value) FILTER (WHERE label = 1) AS anomaly FROM long GROUP BY metric""",
)
def length_comparison(spark, folder):
    return rounded(explore.length_comparison(event_sequences(spark, folder)))


@add("diversity", f"WITH {i.STATS} SELECT {_summary_sql('unique_events')} FROM stats")
def diversity(spark, folder):
    return rounded(explore.diversity_stats(stats(spark, folder)))


@add("diversity_by_class", f"WITH {i.STATS} SELECT label, {_summary_sql('unique_events')} FROM stats GROUP BY label")
def diversity_by_class(spark, folder):
    return rounded(explore.diversity_stats(stats(spark, folder), "label"))


@add(
    "repetition_by_class",
    f"""WITH {i.STATS} SELECT label, round(avg(repetition_rate), 6) AS repetition_rate,
    round(avg(seq_length / unique_events), 6) AS repetition_ratio FROM stats GROUP BY label""",
)
def repetition_by_class(spark, folder):
    return rounded(explore.repetition(stats(spark, folder)))


CLASS_EVENTS = f"""{i.SEQUENCES},
class_n AS (SELECT s.label, event_id AS event, count(*) AS n FROM event_log e JOIN seqs s ON e.block_id = s.seq_id GROUP BY 1, 2)"""


@add("event_counts_by_class", f"WITH {CLASS_EVENTS} SELECT label, event, n FROM class_n")
def event_counts_by_class(spark, folder):
    return explore.event_counts(event_sequences(spark, folder))


@add(
    "token_totals",
    f"WITH {CLASS_EVENTS} SELECT label, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS distinct_events FROM class_n GROUP BY label",
)
def token_totals(spark, folder):
    return explore.token_totals(event_sequences(spark, folder))


@add(
    "event_totals",
    f"""WITH {CLASS_EVENTS} SELECT event, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / (SELECT count(*) FROM seqs), 6) AS mean_per_sequence
    FROM class_n GROUP BY event""",
)
def event_totals(spark, folder):
    return rounded(explore.event_totals(event_sequences(spark, folder)))


@add(
    "event_means_by_class",
    f"""WITH {CLASS_EVENTS}, sizes AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM seqs),
    means AS (SELECT event, coalesce(sum(n) FILTER (WHERE label = 0), 0) / max(n0) AS normal_mean, coalesce(sum(n) FILTER (WHERE label = 1), 0) / max(n1) AS anomaly_mean
      FROM class_n, sizes GROUP BY event)
    SELECT event, round(normal_mean, 6) AS normal_mean, round(anomaly_mean, 6) AS anomaly_mean, round(anomaly_mean - normal_mean, 6) AS difference FROM means""",
)
def event_means_by_class(spark, folder):
    return rounded(explore.event_means_by_class(event_sequences(spark, folder)))


@add(
    "extreme_events",
    f"""WITH {CLASS_EVENTS}, t AS (SELECT event, CAST(sum(n) AS BIGINT) AS n FROM class_n GROUP BY event)
    SELECT (SELECT event FROM t ORDER BY n DESC, event LIMIT 1) AS most_frequent, max(n) AS most_n,
           (SELECT event FROM t ORDER BY n, event LIMIT 1) AS least_frequent, min(n) AS least_n FROM t""",
)
def extreme_events(spark, folder):
    return explore.extreme_events(event_sequences(spark, folder))


SHARE_SQL = f"""{CLASS_EVENTS},
shares AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY label) AS share FROM class_n),
both_shares AS (
  SELECT event, CAST(coalesce(max(n) FILTER (WHERE label = 0), 0) AS BIGINT) AS normal_n, CAST(coalesce(max(n) FILTER (WHERE label = 1), 0) AS BIGINT) AS anomaly_n,
    round(coalesce(max(share) FILTER (WHERE label = 0), 0), 6)::DOUBLE AS normal_percent, round(coalesce(max(share) FILTER (WHERE label = 1), 0), 6)::DOUBLE AS anomaly_percent
  FROM shares GROUP BY event)"""


@add("event_share_by_class", f"WITH {SHARE_SQL} SELECT * FROM both_shares")
def event_share_by_class(spark, folder):
    return rounded(explore.event_share(event_sequences(spark, folder)))


TOP_SQL = f"""{SHARE_SQL},
ranked AS (SELECT label, event, n, round(share, 6)::DOUBLE AS share_percent, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, event) AS INTEGER) AS rank FROM shares)"""


@add("top_events_per_class", f"WITH {TOP_SQL} SELECT label, event, n, share_percent, rank FROM ranked WHERE rank <= 3")
def top_events_per_class(spark, folder):
    return rounded(explore.top_events(event_sequences(spark, folder), 3))


def _union_sql(order: str) -> str:
    return f"WITH {TOP_SQL} SELECT * FROM both_shares WHERE event IN (SELECT event FROM ranked WHERE rank <= 3) ORDER BY {order} LIMIT 3"


@add("top_union", _union_sql("normal_percent DESC, event"))
def top_union(spark, folder):
    return rounded(explore.top_union(event_sequences(spark, folder), 3))


@add("top_union_by_name", _union_sql("event"))
def top_union_by_name(spark, folder):
    return rounded(explore.top_union(event_sequences(spark, folder), 3, "event"))


def _quality_sql() -> str:
    parts = []
    for label, side in ((0, "normal"), (1, "anomaly")):
        for column, name in (("seq_length", "total"), ("unique_events", "nonzero")):
            parts += [f"round({f}({column}) FILTER (WHERE label = {label}), 6) AS {side}_{name}_{n}" for f, n in (("avg", "mean"), ("stddev_pop", "std"))]
    gaps = [
        f"round(abs(avg({c}) FILTER (WHERE label = 1) - avg({c}) FILTER (WHERE label = 0)), 6) AS {n}_gap"
        for c, n in (("seq_length", "total"), ("unique_events", "nonzero"))
    ]
    return f"WITH {i.STATS} SELECT {', '.join(parts + gaps)} FROM stats"


@add("feature_quality", _quality_sql())
def feature_quality(spark, folder):
    return rounded(explore.feature_quality(stats(spark, folder)))


# Steps of the integral behind a p-value.
_STEPS = 4000


@add(
    "t_test",
    f"""WITH {i.SEQUENCES}, m AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
      avg(length) FILTER (WHERE label = 0) AS m0, avg(length) FILTER (WHERE label = 1) AS m1,
      var_samp(length) FILTER (WHERE label = 0) AS v0, var_samp(length) FILTER (WHERE label = 1) AS v1 FROM seqs),
    s AS (
      SELECT (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t, CAST(n0 + n1 - 2 AS DOUBLE) AS v FROM m),
    density AS (
      SELECT k, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(abs(t) * k / {_STEPS}, 2) / v, -(v + 1) / 2) AS d
      FROM s, range({_STEPS} + 1) r(k)),
    p AS (SELECT CASE WHEN (SELECT t FROM s) IS NOT NULL THEN greatest(0, 1 - 2 * sum(d * CASE WHEN k IN (0, {_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * (SELECT abs(t) FROM s) / {_STEPS} / 3) END AS p FROM density)
    SELECT round(t, 6) AS t_statistic, v AS degrees_of_freedom, round(p, 6) AS p_value, p < {explore.SIGNIFICANCE} AS significant FROM s, p""",
)
def t_test(spark, folder):
    """The SQL integrates the density of t by Simpson's rule."""
    return rounded(explore.t_test(event_sequences(spark, folder), "length"))


def _histogram_sql(source: str, column: str, bins: int, by: str | None, shared: bool) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    lo, hi = (f"min(min({column})) OVER ()", f"max(max({column})) OVER ()") if by and shared else (f"min({column})", f"max({column})")
    on = f"USING ({by})" if by else "ON true"
    match = f"f.{by} = c.{by} AND " if by else ""
    out = f"f.{by}, " if by else ""
    return f"""limits AS (SELECT {key}count({column}) AS total, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi FROM {source} {group}),
    opened AS (SELECT {key}total, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM limits),
    sized AS (SELECT *, (hi - lo) / {bins} AS width FROM opened),
    guessed AS (SELECT {key}CAST({column} AS DOUBLE) AS x, lo, width, least({bins - 1}, CAST(floor(({column} - lo) / width) AS INTEGER)) AS g FROM {source} JOIN sized {on}),
    placed AS (SELECT {key}CASE WHEN x < lo + g * width AND g > 0 THEN g - 1 WHEN x >= lo + (g + 1) * width AND g < {bins - 1} THEN g + 1 ELSE g END AS bin FROM guessed),
    c AS (SELECT {key}bin, count(*) AS n FROM placed GROUP BY {key}bin),
    f AS (SELECT *, unnest(range(0, {bins})) AS bin FROM sized)
    SELECT {out}CAST(f.bin AS INTEGER) AS bin, round(lo + f.bin * width, 6) AS bin_low, round(lo + (f.bin + 1) * width, 6) AS bin_high,
      coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * width), 6) AS density FROM f LEFT JOIN c ON {match}f.bin = c.bin"""


@add("histogram", f"WITH {i.SEQUENCES}, {_histogram_sql('seqs', 'length', 20, None, True)}")
def histogram(spark, folder):
    return rounded(explore.histogram(explore.heads(event_sequences(spark, folder)), "length", 20))


@add("value_histogram", f"WITH {_histogram_sql('events', 'value', 50, None, True)}")
def value_histogram(spark, folder):
    return rounded(explore.histogram(i.table(spark, folder, "events"), "value", 50))


@add("histogram_by_class", f"WITH {i.SEQUENCES}, {_histogram_sql('seqs', 'length', 10, 'label', True)}")
def histogram_by_class(spark, folder):
    return rounded(explore.histogram(explore.heads(event_sequences(spark, folder)), "length", 10, "label"))


@add("histogram_own_range", f"WITH {i.SEQUENCES}, {_histogram_sql('seqs', 'length', 10, 'label', False)}")
def histogram_own_range(spark, folder):
    return rounded(explore.histogram(explore.heads(event_sequences(spark, folder)), "length", 10, "label", False))


@add(
    "value_quantiles",
    "SELECT round(quantile_cont(value, 0.25), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.95), 6) AS q2 FROM events",
)
def value_quantiles(spark, folder):
    return rounded(explore.quantiles(i.table(spark, folder, "events"), "value", [0.25, 0.5, 0.95]))


@add(
    "box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
      count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""",
)
def box_stats(spark, folder):
    return rounded(explore.box_stats(i.table(spark, folder, "events"), "value", "event_type"))


@add(
    "normal_only",
    f"WITH {i.SEQUENCES} SELECT seq_id, length FROM seqs WHERE label = 0",
)
def normal_only(spark, folder):
    return split.normal_only(event_sequences(spark, folder)).select("seq_id", "length")


@add(
    "normal_only_counts",
    f"WITH {i.SEQUENCES} SELECT count(*) AS before, count(*) FILTER (WHERE label = 0) AS after, count(*) FILTER (WHERE label <> 0) AS removed FROM seqs",
)
def normal_only_counts(spark, folder):
    return split.normal_only_counts(explore.heads(event_sequences(spark, folder)))


@add(
    "align_check",
    f"WITH {i.SEQUENCES} SELECT count(*) AS aligned, CAST(0 AS BIGINT) AS mismatches FROM seqs",
)
def align_check(spark, folder):
    seqs = event_sequences(spark, folder)
    return split.alignment(seqs.select("seq_id", "label"), features.occurrence_wide(seqs, EVENTS))


@add(
    "align_mismatches",
    f"""WITH {i.SEQUENCES}, pairs AS (SELECT CAST(seq_id AS BIGINT) % 7 AS seven, CAST(seq_id AS BIGINT) % 5 AS five FROM seqs)
    SELECT count(*) FILTER (seven <> 0 AND five <> 1) AS aligned, count(*) FILTER (seven = 0 OR five = 1) AS mismatches FROM pairs""",
)
def align_mismatches(spark, folder):
    """Sequences against a matrix that lacks one in seven and has another label for one in five."""
    seqs = event_sequences(spark, folder)
    wide = features.occurrence_wide(seqs, EVENTS).where(F.col("seq_id").cast("bigint") % 7 != 0)
    flipped = F.when(F.col("seq_id").cast("bigint") % 5 == 1, 1 - F.col("label")).otherwise(F.col("label"))
    return split.alignment(seqs.select("seq_id", "label"), wide.withColumn("label", flipped))


@add(
    "occurrence_label_join",
    f"""WITH {i.BLOCK_SEQUENCES}, n AS (SELECT seq_id, event, count(*) AS n FROM (SELECT seq_id, unnest(events) AS event FROM block_seqs) GROUP BY 1, 2)
    SELECT n.seq_id, event, n, l.label FROM n LEFT JOIN block_labels l ON n.seq_id = l.block_id""",
)
def occurrence_label_join(spark, folder):
    counts = features.occurrence(block_log_sequences(spark, folder))
    labels = i.block_labels(spark, folder).select(
        F.col("block_id").alias("seq_id"), F.when(F.col("label") == "Anomaly", 1).otherwise(0).alias("label")
    )
    return counts.join(labels, "seq_id", "left")


def _report_sql() -> str:
    def rows(section: str, source: str, columns: list[str], key: str | None = None) -> str:
        picks = []
        for c in columns:
            name = f"'{c}.' || {key}" if key else f"'{c}'"
            picks.append(f"SELECT '{section}' AS section, {name} AS metric, CAST({c} AS DOUBLE) AS value FROM {source}")
        return " UNION ALL ".join(picks)

    summary = ["n", "min", "max", "mean", "median", "std"]
    parts = [
        rows("labels", "balance", ["total", "normal", "anomaly", "anomaly_percent", "imbalance_ratio"]),
        rows("length", "len_all", summary),
        rows("length", "len_class", summary, "label"),
        rows("diversity", "div_all", summary),
        rows("diversity", "div_class", summary, "label"),
        rows("repetition", "rep", ["repetition_rate", "repetition_ratio"], "label"),
        rows("tokens", "tok", ["tokens", "distinct_events"], "label"),
        rows("events", "ext", ["most_n", "least_n"]),
    ]
    return f"""WITH {i.STATS},
    class_n AS (SELECT s.label, event_id AS event, count(*) AS n FROM event_log e JOIN seqs s ON e.block_id = s.seq_id GROUP BY 1, 2),
    totals AS (SELECT sum(n) AS n FROM class_n GROUP BY event),
    balance AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS anomaly,
      round(avg(label) * 100, 6) AS anomaly_percent, round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS imbalance_ratio FROM seqs),
    len_all AS (SELECT {_summary_sql('length')} FROM seqs), len_class AS (SELECT label, {_summary_sql('length')} FROM seqs GROUP BY label),
    div_all AS (SELECT {_summary_sql('unique_events')} FROM stats), div_class AS (SELECT label, {_summary_sql('unique_events')} FROM stats GROUP BY label),
    rep AS (SELECT label, round(avg(repetition_rate), 6) AS repetition_rate, round(avg(seq_length / unique_events), 6) AS repetition_ratio FROM stats GROUP BY label),
    tok AS (SELECT label, sum(n) AS tokens, count(*) AS distinct_events FROM class_n GROUP BY label),
    ext AS (SELECT max(n) AS most_n, min(n) AS least_n FROM totals)
    {" UNION ALL ".join(parts)}"""


@add("dataset_report", _report_sql())
def dataset_report(spark, folder):
    return rounded(report.dataset_report(materialise(event_sequences(spark, folder))))
