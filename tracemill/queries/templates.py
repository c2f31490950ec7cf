"""Template tables, filters, matching, mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import features, matching, mining, templates
from tracemill.queries import Registry
from tracemill.queries import inputs as i
from tracemill.queries.sequences import event_sequences
from tracemill.session import materialise
from tracemill.sources import logs

REGISTRY = Registry()
add = REGISTRY.add

MIN_OCCURRENCE = 2

# Templates of both lines formats: (id, text). "E8" has no line.
CATALOGUE = [
    ("E1", "machine check at <NODE> axis X+ code <NUM> since <TS>"),
    ("E2", "user <NUM> selected plane <PLANE> item <*>"),
    ("E3", "user <NUM> paid <NUM> units"),
    ("E4", "r<*>=0x<*>"),
    ("E5", "cache parity report <NUM> on <DATE>"),
    ("E6", "user <*>"),
    ("E7", "machine check at <*>"),
    ("E8", "power module <*> failed"),
]
_VALUES = ", ".join(f"('{e}', '{t}')" for e, t in CATALOGUE)
CATALOGUE_SQL = f"catalogue(event_id, event_template) AS (VALUES {_VALUES})"

# Distinct masked messages, numbered by first line, as the simplest template table.
ID_SQL = f"""{i.ALERT_MASKED},
template_table AS (
  SELECT 'E' || row_number() OVER (ORDER BY min(line_id)) AS event_id, masked AS event_template, count(*) AS occurrence_count
  FROM alert_masked GROUP BY masked),
flagged AS (
  SELECT *, regexp_matches(event_template, '{"|".join(text.NOISE_PATTERNS)}') AS noise FROM template_table)"""


def masked_lines(spark, folder):
    return logs.parse(
        i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN, i.ALERT_LOG_MASKS, text.alert_tag_label
    )


def template_table(spark, folder):
    distinct = masked_lines(spark, folder).groupBy(F.col("masked").alias("event_template")).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("line_id").alias("first_line")
    )
    return templates.with_event_ids(materialise(distinct)).select("event_id", "event_template", "occurrence_count")


def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "event_id STRING, event_template STRING")


def lines_with_ids(spark, folder):
    table = template_table(spark, folder).select("event_id", "event_template")
    return masked_lines(spark, folder).join(table, F.col("masked") == F.col("event_template"))


@add("template_counts", f"WITH {ID_SQL} SELECT event_id, event_template, occurrence_count FROM template_table")
def template_counts(spark, folder):
    return templates.by_frequency(templates.counts(lines_with_ids(spark, folder)))


@add(
    "noise_filter",
    f"WITH {ID_SQL} SELECT event_id, event_template, occurrence_count FROM flagged WHERE NOT noise AND occurrence_count >= {MIN_OCCURRENCE}",
)
def noise_filter(spark, folder):
    return templates.filter_templates(template_table(spark, folder), MIN_OCCURRENCE)


@add(
    "rare_filter",
    f"WITH {ID_SQL} SELECT event_id, event_template, occurrence_count FROM template_table WHERE occurrence_count >= {MIN_OCCURRENCE}",
)
def rare_filter(spark, folder):
    return templates.filter_templates(template_table(spark, folder), MIN_OCCURRENCE, remove_noise=False)


@add(
    "filter_coverage",
    f"""WITH {ID_SQL} SELECT
    count(*) FILTER (WHERE occurrence_count >= {MIN_OCCURRENCE} AND NOT noise) AS kept_templates,
    CAST(coalesce(sum(occurrence_count) FILTER (WHERE occurrence_count >= {MIN_OCCURRENCE} AND NOT noise), 0) AS BIGINT) AS kept_lines,
    count(*) FILTER (WHERE occurrence_count < {MIN_OCCURRENCE}) AS rare_templates,
    CAST(coalesce(sum(occurrence_count) FILTER (WHERE occurrence_count < {MIN_OCCURRENCE}), 0) AS BIGINT) AS rare_lines,
    count(*) FILTER (WHERE occurrence_count >= {MIN_OCCURRENCE} AND noise) AS noise_templates,
    CAST(coalesce(sum(occurrence_count) FILTER (WHERE occurrence_count >= {MIN_OCCURRENCE} AND noise), 0) AS BIGINT) AS noise_lines,
    round(coalesce(sum(occurrence_count) FILTER (WHERE occurrence_count >= {MIN_OCCURRENCE} AND NOT noise), 0) * 100.0
      / sum(occurrence_count), 6)::DOUBLE AS coverage_percent FROM flagged""",
)
def filter_coverage(spark, folder):
    covered = templates.coverage(template_table(spark, folder), MIN_OCCURRENCE)
    return covered.withColumn("coverage_percent", F.round("coverage_percent", 6))


UNK_SQL = f"""{ID_SQL},
unk_lines AS (
  SELECT m.line_id, CASE WHEN t.occurrence_count >= {MIN_OCCURRENCE} AND NOT t.noise THEN t.event_id ELSE '<UNK>' END AS event_id,
         CASE WHEN t.occurrence_count >= {MIN_OCCURRENCE} AND NOT t.noise THEN t.event_template ELSE '<UNK>' END AS event_template
  FROM alert_masked m JOIN flagged t ON m.masked = t.event_template)"""


@add("rare_to_unk", f"WITH {UNK_SQL} SELECT line_id, event_id, event_template FROM unk_lines")
def rare_to_unk(spark, folder):
    kept = templates.filter_templates(template_table(spark, folder), MIN_OCCURRENCE)
    return templates.to_unk(lines_with_ids(spark, folder), kept).select("line_id", "event_id", "event_template")


@add(
    "unk_share",
    f"""WITH {UNK_SQL} SELECT count(*) FILTER (WHERE event_id = '<UNK>') AS unknown_lines, count(*) AS lines,
    round(count(*) FILTER (WHERE event_id = '<UNK>') * 100.0 / count(*), 6)::DOUBLE AS unknown_percent FROM unk_lines""",
)
def unk_share(spark, folder):
    shared = templates.unk_share(rare_to_unk(spark, folder))
    return shared.withColumn("unknown_percent", F.round("unknown_percent", 6))


@add(
    "removed_events",
    f"""WITH {ID_SQL} SELECT event_id, count(*) AS n FROM alert_masked m JOIN flagged t ON m.masked = t.event_template
    WHERE t.noise OR t.occurrence_count < {MIN_OCCURRENCE} GROUP BY event_id""",
)
def removed_events(spark, folder):
    kept = templates.filter_templates(template_table(spark, folder), MIN_OCCURRENCE)
    outside = lines_with_ids(spark, folder).join(kept, "event_id", "left_anti")
    return outside.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


def _top_sql(side: str, order: str) -> str:
    return f"""(SELECT '{side}' AS side, event_id,
      CASE WHEN length(event_template) > 60 THEN left(event_template, 60) || '...' ELSE event_template END AS template_short,
      occurrence_count, round(occurrence_count * 100.0 / (SELECT sum(occurrence_count) FROM template_table), 6)::DOUBLE AS share_percent
      FROM template_table ORDER BY {order} LIMIT 20)"""


@add(
    "top_bottom_templates",
    f"WITH {ID_SQL} {_top_sql('top', 'occurrence_count DESC, event_id')} UNION ALL {_top_sql('bottom', 'occurrence_count, event_id DESC')}",
)
def top_bottom_templates(spark, folder):
    ends = templates.top_and_bottom(template_table(spark, folder), 20)
    return ends.withColumn("share_percent", F.round("share_percent", 6))


# The template language allows any run of characters between literals; SQL tests it with LIKE.
_LIKE = "replace(replace(replace(event_template, '%', '\\%'), '_', '\\_'), '<*>', '%')"
MATCH_SQL = f"""{i.ALERT_MASKED}, {CATALOGUE_SQL},
candidates AS (
  SELECT m.masked, c.event_id, c.event_template, row_number() OVER (
      PARTITION BY m.masked ORDER BY length(replace(c.event_template, '<*>', '')) DESC, c.event_id) AS r
  FROM (SELECT DISTINCT masked FROM alert_masked) m JOIN catalogue c ON m.masked LIKE {_LIKE} ESCAPE '\\'),
matched AS (
  SELECT m.line_id, m.masked, coalesce(c.event_id, '<UNK>') AS event_id, coalesce(c.event_template, '<UNK>') AS event_template
  FROM alert_masked m LEFT JOIN candidates c ON m.masked = c.masked AND c.r = 1)"""


@add("template_match", f"WITH {MATCH_SQL} SELECT line_id, event_id, event_template FROM matched")
def template_match(spark, folder):
    return matching.match(masked_lines(spark, folder), catalogue(spark)).select("line_id", "event_id", "event_template")


@add(
    "match_statistics",
    f"""WITH {MATCH_SQL} SELECT c.event_id, c.event_template, count(m.line_id) AS occurrence_count
    FROM catalogue c LEFT JOIN matched m USING (event_id) GROUP BY 1, 2""",
)
def match_statistics(spark, folder):
    return templates.match_statistics(template_match(spark, folder), catalogue(spark))


LARGE_CATALOGUE_SQL = f"""{i.ALERT_LINES},
catalogue(event_id, event_template) AS (
  SELECT DISTINCT 'S' || u || '-' || k, 'user ' || u || ' selected plane B item ' || k || ' of <*>' FROM alert_parts
  UNION SELECT DISTINCT 'P' || u, 'user ' || u || ' paid <*> units' FROM alert_parts
  UNION SELECT DISTINCT 'R' || u || '-' || k, 'r' || k || '<*>x' || lpad(u, 8, '0') FROM alert_parts WHERE event_type IN ('signup', 'view')
  UNION SELECT DISTINCT 'N' || u, 'r<*>' || right(u, 2) FROM alert_parts
  UNION VALUES ('C1', 'm<*> check <*>'), ('C2', 'c<*>2'), ('B1', '<*> <*> <*> <*> <*>'), ('B2', '<*> <*> <*> <*> <*>'))"""


@add(
    "large_catalogue_match",
    f"""WITH {LARGE_CATALOGUE_SQL},
    candidates AS (
      SELECT m.content, c.event_id, c.event_template, row_number() OVER (
          PARTITION BY m.content ORDER BY length(replace(c.event_template, '<*>', '')) DESC, c.event_id) AS r
      FROM (SELECT DISTINCT content FROM alert_content) m JOIN catalogue c ON m.content LIKE {_LIKE} ESCAPE '\\')
    SELECT line_id, coalesce(c.event_id, '<UNK>') AS event_id, coalesce(c.event_template, '<UNK>') AS event_template
    FROM alert_content a LEFT JOIN candidates c ON a.content = c.content AND c.r = 1""",
)
def large_catalogue_match(spark, folder):
    """Unmasked messages against thousands of templates, many of them without a whole word."""
    lines = materialise(logs.parse(i.alert_lines(spark, folder), i.ALERT_LOG_PATTERN).select("line_id", "content"))
    parts = i.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("u"), F.regexp_extract("props", r"(\d+)", 1).alias("k"), "event_type"
    )
    text_of = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    u, k = F.col("u"), F.col("k")
    made = [
        parts.select(text_of("S", u, "-", k), text_of("user ", u, " selected plane B item ", k, " of <*>")),
        parts.select(text_of("P", u), text_of("user ", u, " paid <*> units")),
        parts.where(F.col("event_type").isin("signup", "view")).select(text_of("R", u, "-", k), text_of("r", k, "<*>x", F.lpad(u, 8, "0"))),
        parts.select(text_of("N", u), text_of("r<*>", F.right(u, F.lit(2)))),
        spark.createDataFrame([("C1", "m<*> check <*>"), ("C2", "c<*>2"), ("B1", "<*> <*> <*> <*> <*>"), ("B2", "<*> <*> <*> <*> <*>")], "a string, b string"),
    ]
    known = made[0]
    for more in made[1:]:
        known = known.union(more)
    known = materialise(known.toDF("event_id", "event_template").distinct())
    return matching.match(lines, known, "content").select("line_id", "event_id", "event_template")


def mining_sql(lines: str) -> str:
    """Common table expressions from ``lines`` (line_id, masked) to ``mined`` (masked, event_id, event_template)."""
    return f"""
messages AS (SELECT masked, count(*) AS n, min(line_id) AS first_line FROM {lines} GROUP BY masked),
split AS (SELECT masked, n, first_line, regexp_split_to_array(masked, '\\s+') AS parts FROM messages),
words AS (SELECT masked, n, first_line, unnest(parts) AS token, generate_subscripts(parts, 1) AS spot FROM split),
sized AS (
  SELECT masked, n, first_line, count(*) AS size, max(CASE WHEN spot = 1 THEN CASE WHEN regexp_matches(token, '\\d') THEN '<*>' ELSE token END END) AS prefix
  FROM words GROUP BY 1, 2, 3),
own AS (
  SELECT size, prefix FROM (SELECT size, prefix, row_number() OVER (PARTITION BY size ORDER BY sum(n) DESC, prefix) AS r FROM sized GROUP BY 1, 2)
  WHERE r <= 100),
placed AS (
  SELECT s.masked, s.first_line, s.size, s.size || ' ' || coalesce(o.prefix, '<*>') AS leaf
  FROM sized s LEFT JOIN own o ON s.size = o.size AND s.prefix = o.prefix),
placed_words AS (SELECT p.masked, p.first_line, p.size, p.leaf, w.spot, w.token FROM placed p JOIN words w ON p.masked = w.masked),
constants AS (SELECT leaf, spot, token, count(*) AS n FROM placed_words WHERE token <> '<*>' GROUP BY 1, 2, 3 HAVING count(*) > 1),
signed_words AS (
  SELECT p.masked, p.first_line, p.size, p.leaf, p.spot, CASE WHEN c.token IS NULL THEN '<*>' ELSE p.token END AS token, c.n
  FROM placed_words p LEFT JOIN constants c ON p.leaf = c.leaf AND p.spot = c.spot AND p.token = c.token),
signed AS (
  SELECT masked, first_line, size, leaf, string_agg(token, ' ' ORDER BY spot) AS signature, count(*) FILTER (token <> '<*>') AS held
  FROM signed_words GROUP BY 1, 2, 3, 4),
signatures AS (
  SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY m DESC, id) AS place FROM (
    SELECT leaf, size, signature, count(*) AS m, min(first_line) AS id FROM signed WHERE held >= 0.4::DOUBLE * size GROUP BY 1, 2, 3)),
marks AS (
  SELECT s.leaf, s.id, s.size, s.place, w.spot, w.token, row_number() OVER (PARTITION BY s.id ORDER BY w.n, w.spot) AS rarity
  FROM signatures s JOIN signed_words w ON s.id = w.first_line WHERE w.n IS NOT NULL),
pairs AS (
  SELECT a.id, b.id AS up, b.place, count(*) AS equal, min(a.rarity) AS rarest FROM marks a JOIN marks b ON a.leaf = b.leaf AND a.spot = b.spot AND a.token = b.token
  WHERE b.place < a.place GROUP BY a.id, b.id, b.place, a.size HAVING count(*) >= 0.4::DOUBLE * a.size),
links AS (SELECT id, up FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY equal DESC, rarest, place) AS r FROM pairs) WHERE r = 1),
chains AS (
  SELECT id, id AS spot FROM signatures
  UNION ALL SELECT c.id, l.up FROM chains c JOIN links l ON c.spot = l.id),
roots AS (SELECT id, spot AS cluster FROM chains WHERE spot NOT IN (SELECT id FROM links)),
members AS (
  SELECT g.masked, g.first_line, CASE WHEN g.held >= 0.4::DOUBLE * g.size THEN r.cluster ELSE g.first_line END AS cluster
  FROM signed g LEFT JOIN signatures s ON g.leaf = s.leaf AND g.signature = s.signature LEFT JOIN roots r ON s.id = r.id),
agreed AS (
  SELECT cluster, spot, CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS token
  FROM members m JOIN words w ON m.masked = w.masked GROUP BY 1, 2),
shown AS (SELECT cluster, string_agg(token, ' ' ORDER BY spot) AS event_template FROM agreed GROUP BY 1),
named AS (SELECT cluster, 'E' || row_number() OVER (ORDER BY min(first_line)) AS event_id FROM members GROUP BY cluster),
mined AS (SELECT m.masked, n.event_id, s.event_template FROM members m JOIN named n ON m.cluster = n.cluster JOIN shown s ON m.cluster = s.cluster)"""


DOCUMENT_MASKED = f"""{i.DOCUMENT_LINES},
document_masked AS (SELECT line_id, regexp_replace(raw, '\\d+', '<NUM>', 'g') AS masked FROM kept_lines)"""


@add(
    "template_mining",
    f"""WITH RECURSIVE {i.ALERT_MASKED}, {mining_sql("alert_masked")}
    SELECT event_id, event_template, count(*) AS occurrence_count FROM alert_masked JOIN mined USING (masked) GROUP BY 1, 2""",
)
def template_mining(spark, folder):
    """Mined templates of the alert lines and how many lines each covers."""
    return templates.counts(mining.mine(masked_lines(spark, folder), depth=4, sim_th=0.4))


@add(
    "document_template_mining",
    f"""WITH RECURSIVE {DOCUMENT_MASKED}, {mining_sql("document_masked")}
    SELECT line_id, event_id, event_template FROM document_masked JOIN mined USING (masked)""",
)
def document_template_mining(spark, folder):
    parsed = logs.parse(i.document_lines(spark, folder), None, [(r"\d+", "<NUM>")])
    return mining.mine(parsed).select("line_id", "event_id", "event_template")


@add(
    "template_text",
    f"""WITH {i.EVENT_LOG}, names(event_id, event_template) AS (VALUES ('click', 'user selected an item'), ('error', 'machine check'))
    SELECT line_id, e.event_id, coalesce(n.event_template, 'Unknown') AS event_template FROM event_log e LEFT JOIN names n USING (event_id)""",
)
def template_text(spark, folder):
    names = spark.createDataFrame(
        [("click", "user selected an item"), ("error", "machine check")], "event_id STRING, event_template STRING"
    )
    lines = i.event_log(spark, folder).select("line_id", "event_id")
    return templates.template_text(lines, names)


@add(
    "vocabulary_text",
    f"""WITH {i.EVENT_LOG}, vocab AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS idx FROM (SELECT DISTINCT event_id FROM event_log)),
    names(event_id, event_template) AS (VALUES ('click', 'user selected an item'), ('error', 'machine check'))
    SELECT event_id, idx, event_template FROM vocab JOIN names USING (event_id)""",
)
def vocabulary_text(spark, folder):
    names = spark.createDataFrame(
        [("click", "user selected an item"), ("error", "machine check")], "event_id STRING, event_template STRING"
    )
    return templates.vocabulary_text(features.vocabulary(event_sequences(spark, folder)), names)
