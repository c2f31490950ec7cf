"""Match lines to a known template catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators.lookup import lookup
from tracemill.session import broadcast_if_small, materialise

# Templates tested in one expression; on streams larger catalogues take several passes, elsewhere they are indexed.
TEMPLATES_PER_PASS = 400
# Event ids that are sent to all tasks.
BROADCAST_EVENTS = 200_000
# Characters of the pieces of words by which templates without a whole word are found, the longest that a template has first.
GRAMS = {"h": 8, "g": 3}
# Keys that are sent to all tasks, so that only keys of some template are shuffled with their messages.
BROADCAST_KEYS = 200_000
# Templates that are sent to all tasks: those of blanks and wildcards alone, one for each number of blanks.
BROADCAST_BLANK = 10_000
_INDEX = "event_id string, event_template string, pattern string, literal int, keys array<string>"


def ranked_templates(catalogue: DataFrame, wildcards: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """Catalogue rows on the driver, most literal characters first: (event id, text, pattern, longest literal).

    A catalogue is an input table of templates, hundreds of rows; expressions are built from it.
    """
    rows = [(r["event_id"], r["event_template"]) for r in catalogue.select("event_id", "event_template").collect()]

    def literal_size(template: str) -> int:
        return sum(len(p) for p in text.template_pieces(template, wildcards))

    rows.sort(key=lambda r: (-literal_size(r[1]), r[0]))
    out = []
    for event_id, template in rows:
        words = [w for p in text.template_pieces(template, wildcards) for w in p.split()]
        out.append((event_id, template, text.template_pattern(template, wildcards), max(words, key=len, default="")))
    return out


def _first_match(message: Column, ranked: list[tuple[str, str, str, str]]) -> Column:
    """Struct of the first (most specific) template that fits, or NULL."""
    found = None
    for event_id, template, pattern, word in ranked:
        # A plain substring test on the longest literal word spares most regular expressions.
        fits = F.rlike(message, F.lit(text.java_pattern(pattern)))
        test = F.contains(message, F.lit(word)) & fits if word else fits
        value = F.struct(F.lit(event_id).alias("event_id"), F.lit(template).alias("event_template"))
        found = F.when(test, value) if found is None else found.when(test, value)
    return found


def match_messages(
    messages: DataFrame, catalogue: DataFrame, column: str = "masked", wildcards=(text.WILDCARD, "[*]")
) -> DataFrame:
    """Add ``event_id`` and ``event_template`` by testing templates in the order of their literal length.

    No join: the catalogue becomes one CASE expression per pass, so this also runs on a stream.
    Messages that fit no template get ``<UNK>``.
    """
    ranked = ranked_templates(catalogue, wildcards)
    best = F.lit(None).cast("struct<event_id:string,event_template:string>")
    out = messages.withColumn("_match", best)
    for at in range(0, len(ranked), TEMPLATES_PER_PASS):
        case = _first_match(F.col(column), ranked[at : at + TEMPLATES_PER_PASS])
        out = out.withColumn("_match", F.when(F.col("_match").isNotNull(), F.col("_match")).otherwise(case))
    return (
        out.withColumn("event_id", F.coalesce("_match.event_id", F.lit(text.UNKNOWN)))
        .withColumn("event_template", F.coalesce("_match.event_template", F.lit(text.UNKNOWN)))
        .drop("_match")
    )


def _whole_words(template: str, wildcards: Sequence[str]) -> list[str]:
    """Literal words of a template that no wildcard touches: every message of the template has them."""
    pieces, out = text.template_pieces(template, wildcards), []
    for k, piece in enumerate(pieces):
        words = piece.split()
        if words and k > 0 and not piece[:1].isspace():
            words = words[1:]
        if words and k < len(pieces) - 1 and not piece[-1:].isspace():
            words = words[:-1]
        out += words
    return sorted(set(out))


def _keys(template: str, wildcards: Sequence[str]) -> list[str]:
    """What every message of a template has, of the most telling kind that the template offers: whole words ("w"), runs of
    ``GRAMS`` characters within a word ("h", "g"), characters ("c"), or nothing but blanks ("")."""
    if words := _whole_words(template, wildcards):
        return ["w" + w for w in words]
    pieces = [w for p in text.template_pieces(template, wildcards) for w in p.split()]
    for kind, size in GRAMS.items():
        if grams := {kind + w[k : k + size] for w in pieces for k in range(len(w) - size + 1)}:
            return sorted(grams)
    return sorted({"c" + c for w in pieces for c in w}) or [""]


def template_index(catalogue: DataFrame, wildcards: Sequence[str]) -> DataFrame:
    """Templates with their pattern, number of literal characters and keys."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = batch["event_template"]
            yield pd.DataFrame(
                {
                    "event_id": batch["event_id"],
                    "event_template": shown,
                    "pattern": [text.java_pattern(text.template_pattern(t, wildcards)) for t in shown],
                    "literal": [sum(map(len, text.template_pieces(t, wildcards))) for t in shown],
                    "keys": [_keys(t, wildcards) for t in shown],
                }
            )

    return catalogue.select("event_id", "event_template").where("event_template IS NOT NULL").mapInPandas(describe, _INDEX)


def _runs(word: Column, size: int) -> Column:
    """The runs of ``size`` characters of a word, none if it is shorter."""
    starts = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(word, at, F.lit(size)))


def _message_keys(column: str, kinds: Sequence[str]) -> Column:
    """The keys of a message, of the ``kinds`` that some template is found by."""
    words = F.filter(F.split(column, r"(?U)\s+"), lambda w: w != "")

    def marked(kind: str, each: Column) -> Column:
        return F.transform(F.array_distinct(each), lambda w: F.concat(F.lit(kind), w))

    found = [marked("w", words)] if "w" in kinds else []
    found += [marked(kind, F.flatten(F.transform(words, lambda w: _runs(w, size)))) for kind, size in (*GRAMS.items(), ("c", 1)) if kind in kinds]
    return F.concat(*found) if found else F.array().cast("array<string>")


def match_indexed(
    messages: DataFrame, catalogue: DataFrame, column: str = "masked", wildcards=(text.WILDCARD, "[*]")
) -> DataFrame:
    """As ``match_messages``, for catalogues of any size: an inverted index from the rarest key of each template to the messages
    that have it. Nothing passes through the driver, and no template is tested on every message but those of blanks alone."""
    described = template_index(catalogue, wildcards)
    # Of templates with one pattern, the first wins everywhere.
    rank = F.struct((-F.col("literal")).alias("l"), "event_id")
    index = described.groupBy("pattern").agg(F.min_by(F.struct("event_id", "event_template", "literal", "keys"), rank).alias("t"))
    index = materialise(index.select("pattern", "t.*"))
    keys = index.select("pattern", F.explode("keys").alias("_key"))
    often = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_df"))
    rarest = keys.join(often, "_key").groupBy("pattern").agg(F.min_by("_key", F.struct("_df", "_key")).alias("_key"))
    keyed = materialise(index.drop("keys").join(rarest, "pattern"))
    kinds = [r[0] for r in keyed.select(F.substring("_key", 1, 1)).distinct().collect()]  # at most five
    test = F.rlike(F.col(column), F.col("pattern"))
    asked = materialise(keyed.where("_key != ''").select("_key").distinct())
    held = messages.select(column, F.explode(_message_keys(column, kinds)).alias("_key"))
    held = held.join(broadcast_if_small(asked, BROADCAST_KEYS), "_key", "left_semi")
    # Spark's estimate of exploded rows is that of the rows before, so it would send them all through the driver.
    tried = held.hint("merge").join(keyed.where("_key != ''"), "_key").where(test)
    blank = materialise(keyed.where("_key = ''").select("pattern", "literal", "event_id", "event_template"))
    columns = [column, "event_id", "event_template", "literal"]
    every = tried.select(*columns)
    if "" in kinds:
        every = every.union(messages.select(column).join(broadcast_if_small(blank, BROADCAST_BLANK), test).select(*columns))
    best = F.min_by(F.struct("event_id", "event_template"), F.struct(-F.col("literal"), F.col("event_id")))
    found = every.groupBy(column).agg(best.alias("_found"))
    chosen = {c: F.coalesce(f"_found.{c}", F.lit(text.UNKNOWN)) for c in ("event_id", "event_template")}
    return messages.join(found, column, "left").withColumns(chosen).drop("_found")


def match(
    parsed: DataFrame, catalogue: DataFrame, column: str = "masked", wildcards=(text.WILDCARD, "[*]")
) -> DataFrame:
    """Match every line; each distinct message is tested once and the result is looked up.

    Catalogues of more than TEMPLATES_PER_PASS templates are not tested one by one but found by a word.
    """
    distinct = parsed.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    small = catalogue.limit(TEMPLATES_PER_PASS + 1).count() <= TEMPLATES_PER_PASS
    find = match_messages if small else match_indexed
    matched = materialise(find(distinct, catalogue, column, wildcards))
    return lookup(parsed, matched, column, "_n", "line_id")


def aligned(catalogue: DataFrame, known: DataFrame, least: float = 0.5, wildcards=(text.WILDCARD, "[*]")) -> DataFrame:
    """(event_id, known_id, similarity): for each template the most similar one of another catalogue, if any.

    Similarity is the Dice coefficient of the sets of tokens, wildcards aside, at least ``least``; of equally similar templates the
    one with the smaller id is taken. Two sets that are so similar share one of their rarest tokens, so only templates
    that do are compared.
    """
    token_sets = {}
    for side, rows in (("a", catalogue), ("b", known)):
        parts = F.array_distinct(F.filter(F.split("event_template", r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*wildcards)))
        token_sets[side] = rows.select("event_id", F.explode(parts).alias("token"))
    both = token_sets["a"].union(token_sets["b"])
    often = both.groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def ordered(rows: DataFrame, name: str) -> DataFrame:
        held = rows.join(often, "token").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
        return held.select(F.col("event_id").alias(name), F.col("t.token").alias(f"{name}_tokens"))

    # Sets of sizes x and y share at least least / (2 - least) of each.
    share = least / (2 - least)
    sets = [materialise(ordered(token_sets[side], name)) for side, name in (("a", "event_id"), ("b", "known_id"))]
    rare = []
    for rows, name in zip(sets, ("event_id", "known_id")):
        size = F.size(f"{name}_tokens")
        prefix = F.greatest(F.lit(1), size - F.ceil(size * share - 1e-9).cast("int") + 1)
        rare.append(rows.select(name, F.explode(F.slice(f"{name}_tokens", F.lit(1), prefix)).alias("token")))
    pairs = rare[0].join(rare[1], "token").select("event_id", "known_id").distinct()
    common = F.size(F.array_intersect("event_id_tokens", "known_id_tokens"))
    dice = 2.0 * common / (F.size("event_id_tokens") + F.size("known_id_tokens"))
    scored = pairs.join(sets[0], "event_id").join(sets[1], "known_id").select("event_id", "known_id", dice.alias("similarity"))
    best = scored.where(F.col("similarity") >= least).groupBy("event_id").agg(F.min_by(F.struct("known_id", "similarity"), F.struct(-F.col("similarity"), F.col("known_id"))).alias("b"))
    return best.select("event_id", "b.known_id", "b.similarity")


def in_known_events(lines: DataFrame, alignment: DataFrame) -> DataFrame:
    """Lines with the ids of another catalogue; events without a counterpart become unknown."""
    ids = materialise(alignment.select("event_id", "known_id"))
    return lines.join(broadcast_if_small(ids, BROADCAST_EVENTS), "event_id", "left").withColumn("event_id", F.coalesce("known_id", F.lit(text.UNKNOWN))).drop("known_id")
