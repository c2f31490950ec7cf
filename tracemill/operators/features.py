"""Vocabulary, id arrays, occurrence vectors and statistics of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill.functions.text import PADDING
from tracemill.operators import order
from tracemill.session import broadcast_if_small, materialise

# Vocabularies up to this size are looked up inside the row; larger ones by a join.
MAP_VOCABULARY = 2_000
BROADCAST_VOCABULARY = 5_000_000
# Longest dense row that ``padded`` will build.
MAX_ROW = 1_000_000
# Columns of one block of a matrix that may be of any width.
BLOCK_COLUMNS = 2_000


def events_of(seqs: DataFrame, *more: str | Column) -> DataFrame:
    """One row per event: ``(event, *more)``."""
    return seqs.select(*more, F.explode("events").alias("event"))


def vocabulary(seqs: DataFrame) -> DataFrame:
    """``(event, idx)``: distinct events numbered from 1 in code point order, and padding as 0; stored."""
    distinct = materialise(events_of(seqs).distinct())
    ranked = order.rank_of(distinct, "event", "idx").select("event", F.col("idx").cast("int"))
    padding = seqs.sparkSession.range(1).select(F.lit(PADDING).alias("event"), F.lit(0).alias("idx"))
    return materialise(ranked.unionByName(padding))


def shifted(vocab: DataFrame) -> DataFrame:
    """A 0-based vocabulary without padding as a 1-based one with it."""
    padding = vocab.sparkSession.range(1).select(F.lit(PADDING).alias("event"), F.lit(0).alias("idx"))
    return vocab.select("event", (F.col("idx") + 1).cast("int").alias("idx")).unionByName(padding)


def inverse(vocab: DataFrame) -> DataFrame:
    return vocab.select("idx", "event")


def _translate(seqs: DataFrame, vocab: DataFrame, source: str, key: str, value: str, missing: Column, most: int | None = None) -> DataFrame:
    """Translate the array ``source`` entry by entry into an array column ``_out``, by a map of up to ``most`` entries or a join."""
    most = MAP_VOCABULARY if most is None else most
    if vocab.limit(most + 1).count() <= most:
        lookup = vocab.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()
        found = F.transform(source, lambda e: F.coalesce(F.try_element_at("_lookup", e), missing))
        return seqs.withColumn("_lookup", lookup).withColumn("_out", found).drop("_lookup")
    entries = seqs.select("seq_id", "piece", F.posexplode(source).alias("_at", "_entry"))
    small = broadcast_if_small(vocab.select(F.col(key).alias("_entry"), F.col(value).alias("_value")), BROADCAST_VOCABULARY)
    found = entries.join(small, "_entry", "left").groupBy("seq_id", "piece").agg(
        F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_value", missing).alias("_value")))).alias("_pairs")
    )
    out = found.select("seq_id", "piece", F.transform("_pairs", lambda p: p["_value"]).alias("_out"))
    return seqs.join(out, ["seq_id", "piece"], "left").withColumn(
        "_out", F.coalesce("_out", F.array().cast(out.schema["_out"].dataType))
    )


def encode(seqs: DataFrame, vocab: DataFrame, most: int | None = None) -> DataFrame:
    """Add ``ids`` (0 for events outside the vocabulary) and ``oov_count``; vocabularies beyond ``most`` entries are joined."""
    out = _translate(seqs, vocab, "events", "event", "idx", F.lit(0), most).withColumnRenamed("_out", "ids")
    return out.withColumn("oov_count", F.size("ids") - F.size(arrays.without_padding(F.col("ids"))))


def decode(padded_seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``events`` for an ``ids`` column, padding left out."""
    trimmed = padded_seqs.withColumn("_kept", arrays.without_padding(F.col("ids")))
    if "piece" not in trimmed.columns:
        trimmed = trimmed.withColumn("piece", F.lit(0).cast("long"))
    out = _translate(trimmed, vocab, "_kept", "idx", "event", F.lit(None).cast("string"))
    return out.withColumnRenamed("_out", "events").drop("_kept")


def p95_length(seqs: DataFrame) -> DataFrame:
    """The 95th percentile of sequence length, cut to an integer."""
    lengths = seqs.where(F.col("start") == 0).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # Distinct lengths are few: k of them need at least k²/2 events.
    return lengths.agg(F.floor(F.percentile("length", 0.95, F.col("n"))).cast("int").alias("max_length"))


def padded(
    seqs: DataFrame, vocab: DataFrame, max_length: int | Column | None = None, truncate: str = "head"
) -> DataFrame:
    """``(seq_id, label, ids, oov_count)``: ids cut to ``max_length`` (default: the longest) and filled with 0.

    ``truncate`` says which end of a long sequence is kept. Only the kept part of each piece is encoded.
    """
    if truncate not in ("head", "tail"):
        raise ValueError("truncate must be 'head' or 'tail'")
    if max_length is None:
        width = seqs.agg(F.max("length")).scalar()
    else:
        width = max_length if isinstance(max_length, Column) else F.lit(max_length).cast("long")
    width = F.when(width <= MAX_ROW, width).otherwise(
        F.raise_error(F.lit("a dense row would be too long: give max_length, or use encode for whole sequences"))
    )
    low = F.lit(0).cast("long") if truncate == "head" else F.greatest(F.lit(0).cast("long"), F.col("length") - width)
    high = width if truncate == "head" else F.col("length")
    marked = seqs.withColumn("_whole", F.size("events") == F.col("length"))
    cut = marked.withColumn("events", arrays.overlap(F.col("events"), F.col("start"), low, high))
    coded = encode(cut, vocab)
    single = coded.where("_whole").select("seq_id", "label", "ids", "oov_count")
    joined = (
        coded.where("NOT _whole")
        .where((F.size("ids") > 0) | (F.col("start") == 0))
        .groupBy("seq_id")
        .agg(
            F.first("label").alias("label"),
            F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("_parts"),
            F.sum("oov_count").cast("int").alias("oov_count"),
        )
        .select("seq_id", "label", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"), "oov_count")
    )
    both = single.unionByName(joined)
    return both.withColumn("ids", arrays.padded(F.col("ids"), width.cast("int")))


def padded_blocks(seqs: DataFrame, vocab: DataFrame, max_length: int | None = None, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """``(seq_id, label, block, ids, oov_count)``: the matrix of ``padded`` in blocks of ``columns`` columns, for any width.

    Block k holds the columns from ``k * columns`` on, the last one those that are left. Every sequence has block 0; further
    blocks that would hold padding alone are left out, so the rows grow with the events, not with the longest sequence.
    """
    most = seqs.agg(F.max("length")).first()[0] or 0 if max_length is None else max_length
    zero, step, width = (F.lit(x).cast("long") for x in (0, columns, most))
    cut = seqs.withColumn("events", arrays.overlap(F.col("events"), F.col("start"), zero, width))
    coded = encode(cut, vocab).where((F.size("ids") > 0) | (F.col("start") == 0))
    first = F.floor(F.col("start") / step)
    last = F.greatest(first, F.floor((F.col("start") + F.size("ids") - 1) / step))
    parts = coded.select("seq_id", "label", "start", "length", "ids", F.explode(F.sequence(first, last)).alias("block"))
    low = F.col("block") * step
    parts = parts.withColumn("_part", arrays.overlap(F.col("ids"), F.col("start"), low, low + step))
    whole = F.size("ids") == F.least("length", width)
    joined = (
        parts.where(~whole).groupBy("seq_id", "label", "block")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "_part"))), lambda x: x["_part"])).alias("_part"))
    )
    both = parts.where(whole).select("seq_id", "label", "block", "_part").unionByName(joined)
    here = F.least(step, width - F.col("block") * step).cast("int")
    oov = F.size(F.filter("_part", lambda x: x == 0))
    return both.select("seq_id", "label", "block", arrays.padded(F.col("_part"), here).alias("ids"), oov.alias("oov_count"))


def occurrence_blocks(seqs: DataFrame, vocab: DataFrame, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """``(seq_id, label, block, counts)``: the matrix of ``occurrence_dense`` in blocks of ``columns`` vocabulary entries.

    Every sequence has block 0, which begins with the padding column; further blocks of zeros alone are left out.
    """
    events = F.concat("events", F.array(F.lit(PADDING)))
    counted = seqs.select("seq_id", "label", F.explode(events).alias("event")).groupBy("seq_id", "label", "event").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counted = counted.join(broadcast_if_small(vocab, BROADCAST_VOCABULARY), "event")
    n = F.when(F.col("idx") == 0, 0).otherwise(F.col("n"))
    cells = counted.select("seq_id", "label", F.floor(F.col("idx") / columns).alias("block"), (F.col("idx") % columns).alias("at"), n.alias("n"))
    maps = cells.groupBy("seq_id", "label", "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("_n"))
    maps = maps.withColumn("_size", vocab.agg(F.max("idx") + 1).scalar())
    here = F.least(F.lit(columns).cast("long"), F.col("_size") - F.col("block") * columns).cast("int")
    dense = F.transform(F.sequence(F.lit(0), here - 1), lambda k: F.coalesce(F.try_element_at("_n", k), F.lit(0)))
    return maps.select("seq_id", "label", "block", dense.alias("counts"))


def _whole(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences that lie in one row, with ``counts`` (event, n) of their distinct events, and the pieces of the others.

    Once a sequence is sorted, the counts are the lengths of its stretches of equal events.
    """
    whole = F.size("events") == F.col("length")
    # Each step is a column of its own: an expression inside a lambda would be computed for every element.
    rows = seqs.where(whole).withColumn("_sorted", F.sort_array(F.filter("events", lambda e: e.isNotNull())))
    places = F.sequence(F.lit(0), F.size("_sorted"))
    starts = F.filter(places, lambda k: (k == 0) | F.coalesce(F.get("_sorted", k) != F.get("_sorted", k - 1), F.lit(True)))
    rows = rows.withColumn("_starts", F.when(F.size("_sorted") > 0, starts).otherwise(F.array().cast("array<int>")))
    # The last start is the end.
    rows = rows.withColumn("_ends", F.slice("_starts", F.lit(2), F.size("_starts")))
    counts = F.transform("_ends", lambda to, j: F.struct(F.get("_sorted", to - 1).alias("event"), (to - F.get("_starts", j)).cast("long").alias("n")))
    return rows.withColumn("counts", counts).drop("_sorted", "_starts", "_ends"), seqs.where(~whole)


def occurrence(seqs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Long form ``(seq_id, event, n)``; events outside a given vocabulary are left out. Only pieces of cut sequences are shuffled."""
    whole, pieces = _whole(seqs)
    known = broadcast_if_small(vocab.select("event"), BROADCAST_VOCABULARY) if vocab is not None else None
    limited = lambda df: df if known is None else df.join(known, "event", "left_semi")
    # Outer, and then without the empty row: an inner generator has Spark filter on the size of "counts" below it, with all of its
    # steps put into one expression, which is computed again for every element.
    inside = limited(whole.select("seq_id", F.inline_outer("counts")).where("event IS NOT NULL"))
    across = limited(events_of(pieces, "seq_id").where("event IS NOT NULL")).groupBy("seq_id", "event").agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(across)


def occurrence_dense(seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(seq_id, label, counts)``: counts in vocabulary order, the padding column (always 0) first.

    Sequences without any known event keep a row of zeros.
    """
    counted = (
        seqs.select("seq_id", "label", F.explode_outer("events").alias("event"))
        .groupBy("seq_id", "label", "event")
        .agg(F.count("event").cast("int").alias("n"))
        .join(broadcast_if_small(vocab, BROADCAST_VOCABULARY), "event", "left")
    )
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "n"))  # NULL entries are not collected
    maps = counted.groupBy("seq_id", "label").agg(F.map_from_entries(F.collect_list(entry)).alias("_n"))
    size = vocab.agg(F.max("idx")).scalar()
    dense = F.transform(F.sequence(F.lit(0), F.col("_size")), lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0)))
    return maps.withColumn("_size", size).select("seq_id", "label", dense.alias("counts"))


def occurrence_wide(seqs: DataFrame, events: Sequence[str]) -> DataFrame:
    """One column per listed event, then the label; the list is explicit, so no extra job collects it."""
    counted = (
        seqs.select("seq_id", "label", F.explode_outer("events").alias("event"))
        .groupBy("seq_id", "label")
        .pivot("event", list(events))
        .agg(F.count("event"))
    )
    return counted.select("seq_id", *[F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(e) for e in events], "label")


def unpivoted(wide: DataFrame, key: str, events: Sequence[str]) -> DataFrame:
    """A wide occurrence matrix in long form, zeros left out."""
    return wide.unpivot([key], list(events), "event", "n").where(F.col("n") > 0)


def statistics(seqs: DataFrame) -> DataFrame:
    """Length, distinct events, entropy, top count, repetition rate and diversity of each sequence.

    Events are counted within the row where it holds the whole sequence. Pieces of cut sequences are counted per (sequence, event),
    which combines before the shuffle, so a long sequence costs no task more than its number of distinct events.
    """
    whole, pieces = _whole(seqs)
    share = lambda n: n / F.col("length")
    part = lambda n: -share(n) * F.log2(share(n) + F.lit(1e-10))
    columns = ["seq_id", "label", "length"]
    inside = whole.select(
        *columns, F.size("counts").cast("long").alias("unique_events"),
        F.aggregate("counts", F.lit(0.0), lambda total, c: total + part(c["n"])).alias("entropy"),
        F.coalesce(F.array_max(F.transform("counts", lambda c: c["n"])), F.lit(0).cast("long")).alias("max_event_freq"),
    )
    counts = pieces.select(*columns, F.explode("events").alias("event")).where("event IS NOT NULL").groupBy(*columns, "event").agg(F.count("event").alias("n"))
    across = counts.groupBy(*columns).agg(
        F.count("event").alias("unique_events"), F.sum(part(F.col("n"))).alias("entropy"), F.max("n").alias("max_event_freq")
    )
    stats = inside.unionByName(across)
    length = F.col("length")
    return stats.select(
        "seq_id",
        "label",
        length.cast("int").alias("seq_length"),
        F.col("unique_events").cast("int").alias("unique_events"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        "max_event_freq",
        F.coalesce(F.try_divide(F.col("max_event_freq"), length), F.lit(0.0)).alias("repetition_rate"),
        F.coalesce(F.try_divide(F.col("unique_events"), length), F.lit(0.0)).alias("diversity"),
    )


def dataset_info(padded_seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts that describe a padded table: sequences, width, vocabulary, classes."""
    size = vocab.agg(F.count(F.lit(1))).scalar()
    return padded_seqs.agg(
        F.count(F.lit(1)).alias("num_sequences"),
        F.max(F.size("ids")).alias("max_length"),
        F.first(size).alias("vocab_size"),
        F.count_if(F.col("label") == 0).alias("normal_count"),
        F.count_if(F.col("label") == 1).alias("anomaly_count"),
    )
