"""Group log lines into event sequences.

A sequence is one row unless it has more than MAX_PIECE events; a longer one (a block id that a third of
the log mentions, say) is several rows, its pieces, so that no task ever holds it whole. Pieces are cut by
line id, which bounds them whatever the skew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text, timestamps
from tracemill.operators import order as ordering

MAX_PIECE = 1_000_000
WINDOW_CHUNK = 8_192
MICROS = 1_000_000

STRATEGIES = ("block_id", "session", "sliding_window", "time_window")
_META = ("block_id", "session_id", "window_start", "window_end", "time_span_seconds")
_META_TYPES = {"block_id": "string", "time_span_seconds": "double"}


def _shape(df: DataFrame, strategy: str) -> DataFrame:
    """The common column layout; metadata that a strategy does not have is NULL."""
    meta = [
        (F.col(m) if m in df.columns else F.lit(None)).cast(_META_TYPES.get(m, "bigint")).alias(m) for m in _META
    ]
    return df.select(
        F.col("seq_id").cast("string"),
        F.col("piece").cast("bigint"),
        F.col("start").cast("bigint"),
        "events",
        F.col("label").cast("int"),
        F.col("length").cast("bigint"),
        F.lit(strategy).alias("strategy"),
        *meta,
    )


def _ordered_events(*order: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col("event").alias("e"))))
    return F.transform(rows, lambda r: r["e"])


def positions(tokens: DataFrame, keys: Sequence[str], time: str | None = None) -> DataFrame:
    """Add ``position``: the 0-based place of a row in its sequence, by ``line_id`` or ``(time, line_id)``.

    For sequences of any length. Rows are numbered inside cells of at most BUCKET_ROWS line ids (of one
    time value, if given) and cells are offset by running totals of their counts.
    """
    cell = [*keys, *([time] if time else []), "_cell"]
    celled = tokens.withColumn("_cell", F.floor(F.col("line_id") / F.lit(ordering.BUCKET_ROWS)))
    cells = celled.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    if time is None:
        offsets = ordering.carry_totals(cells, "_cell", ["n"], keys).withColumnRenamed("before_n", "_offset").drop("n")
    else:
        times = cells.groupBy(*keys, time).agg(F.sum("n").alias("n"))
        times = ordering.carry_totals(times, time, ["n"], keys).drop("n")
        inside = Window.partitionBy(*keys, time).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            cells.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(times, [*keys, time])
            .select(*cell, (F.col("before_n") + F.col("_inside")).alias("_offset"))
        )
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("line_id"))
    return (
        celled.withColumn("_local", local)
        .join(offsets, cell)
        .withColumn("position", F.col("_offset") + F.col("_local") - 1)
        .drop("_cell", "_local", "_offset")
    )


def assemble(
    tokens: DataFrame,
    keys: Sequence[str],
    time: str | None = None,
    max_piece: int = MAX_PIECE,
    extra: Mapping[str, Column] | None = None,
    sep: str | None = None,
) -> DataFrame:
    """Group ``(keys, line_id, event, label)`` rows into pieces of ``max_piece`` events.

    Sequence sizes come from a count that combines before its shuffle. At most ``rows / max_piece``
    sequences can exceed the limit, so that list is safe to broadcast. The others are grouped by key in one
    shuffle; rows of long ones get their position first and are grouped by ``(key, position div max_piece)``.
    AQE drops the second branch when no sequence is long. ``extra`` are aggregates over the whole sequence.

    With ``sep``, ``events`` is one text and every sequence is one row: the texts of the pieces are put together, so that a task
    holds the text of a long sequence but never its rows.
    """
    keys = list(keys)
    order = [*([time] if time else []), "line_id"]
    whole = [F.count(F.lit(1)).alias("length"), F.max("label").alias("label")]
    whole += [aggregate.alias(name) for name, aggregate in (extra or {}).items()]
    long_ones = tokens.groupBy(*keys).agg(*whole).where(F.col("length") > max_piece)

    short = (
        tokens.join(F.broadcast(long_ones.select(*keys)), keys, "left_anti")
        .groupBy(*keys)
        .agg(_ordered_events(*order).alias("events"), *whole)
        .withColumn("piece", F.lit(0).cast("long"))
    )
    placed = positions(tokens.join(F.broadcast(long_ones.select(*keys)), keys, "left_semi"), keys, time)
    pieces = (
        placed.withColumn("piece", F.floor(F.col("position") / F.lit(max_piece)))
        .groupBy(*keys, "piece")
        .agg(_ordered_events("position").alias("events"))
        .join(F.broadcast(long_ones), keys)
    )
    if sep is not None:
        short = short.withColumn("events", F.array_join("events", sep))
        # Events that are NULL have no place in a text, and a piece of them alone has none either.
        text_of = F.when(F.exists("events", lambda e: e.isNotNull()), F.array_join("events", sep))
        texts = pieces.groupBy(*keys, *[c for c in short.columns if c not in (*keys, "events", "piece")]).agg(
            F.sort_array(F.collect_list(F.struct("piece", text_of.alias("t")))).alias("_texts")
        )
        pieces = texts.withColumn("events", F.array_join("_texts.t", sep)).withColumn("piece", F.lit(0).cast("long"))
    both = short.unionByName(pieces.select(*short.columns))
    return both.withColumn("start", F.col("piece") * F.lit(max_piece))


def _tokens(df: DataFrame, event: str, label: str | None, line: str, *more: Column) -> DataFrame:
    flag = text.label_value(F.col(label)) if label is not None and label in df.columns else F.lit(0)
    return df.select(F.col(line).alias("line_id"), F.col(event).alias("event"), flag.alias("label"), *more)


def by_block(
    df: DataFrame,
    event: str = "event_id",
    label: str | None = "label",
    content: str = "content",
    line: str = "line_id",
    block_id_regex: str = text.DEFAULT_BLOCK_ID,
    max_piece: int = MAX_PIECE,
    sep: str | None = None,
) -> DataFrame:
    """One sequence per block id; lines without one are left out. A ``block_id`` column is used if there."""
    block = F.col("block_id") if "block_id" in df.columns else text.block_id(F.col(content), block_id_regex)
    tokens = _tokens(df, event, label, line, block.cast("string").alias("block_id")).where("block_id IS NOT NULL")
    return _shape(assemble(tokens, ["block_id"], max_piece=max_piece, sep=sep).withColumn("seq_id", F.col("block_id")), "block_id")


def by_session(
    df: DataFrame,
    event: str = "event_id",
    label: str | None = "label",
    line: str = "line_id",
    session: str = "session_id",
    window_size: int = 20,
    max_piece: int = MAX_PIECE,
    sep: str | None = None,
) -> DataFrame:
    """One sequence per session id; without that column, chunks of ``window_size`` lines, the last one partial."""
    if session in df.columns:
        tokens = _tokens(df, event, label, line, F.col(session).alias("_session"))
        out = assemble(tokens.where("_session IS NOT NULL"), ["_session"], max_piece=max_piece, sep=sep)
        numeric = df.schema[session].dataType.typeName() in ("byte", "short", "integer", "long")
        session_id = F.col("_session") if numeric else F.expr("try_cast(_session AS BIGINT)")
        return _shape(out.withColumn("seq_id", F.col("_session")).withColumn("session_id", session_id), "session")
    rows = indexed(df, line)
    chunk = F.floor(F.col("row_idx") / F.lit(window_size)).alias("session_id")
    tokens = _tokens(rows, event, label, line, chunk)
    out = (
        tokens.groupBy("session_id")
        .agg(_ordered_events("line_id").alias("events"), F.max("label").alias("label"))
        .withColumn("seq_id", F.col("session_id"))
        .withColumn("piece", F.lit(0))
        .withColumn("start", F.lit(0))
        .withColumn("length", F.size("events"))
    )
    if sep is not None:
        out = out.withColumn("events", F.array_join("events", sep))
    return _shape(out, "session")


def indexed(df: DataFrame, line: str = "line_id") -> DataFrame:
    """``df`` with a dense ``row_idx``; numbered files bring one, other inputs get it from ``line``."""
    return df if "row_idx" in df.columns else ordering.dense_index(df, line)


def by_sliding_window(
    df: DataFrame,
    event: str = "event_id",
    label: str | None = "label",
    line: str = "line_id",
    window_size: int = 20,
    stride: int = 1,
    chunk: int = WINDOW_CHUNK,
) -> DataFrame:
    """Windows of ``window_size`` lines starting at rows 0, stride, 2·stride, …; a partial tail is dropped.

    Rows are shuffled once, into chunks of consecutive rows that also hold the ``window_size - 1`` rows
    after them; windows are slices of a chunk. The shuffle carries ``1 + window_size/chunk`` copies of a
    row, where grouping rows by window would carry ``window_size/stride``.
    """
    if window_size < 1 or stride < 1:
        raise ValueError("window_size and stride must be at least 1")
    chunk = max(chunk, window_size)
    rows = indexed(df, line)
    tokens = _tokens(rows, event, label, "row_idx").withColumnRenamed("line_id", "i")
    home = F.floor(F.col("i") / F.lit(chunk))
    also_before = (F.col("i") % F.lit(chunk) < window_size - 1) & (home > 0)
    copies = tokens.withColumn("_chunk", F.explode(F.when(also_before, F.array(home, home - 1)).otherwise(F.array(home))))
    chunks = copies.groupBy("_chunk").agg(
        F.sort_array(F.collect_list(F.struct("i", "event", "label"))).alias("_rows"),
    )
    base = F.col("_chunk") * F.lit(chunk)
    dense = F.element_at("_rows", -1)["i"] - base + 1 == F.size("_rows")
    checked = chunks.select(
        base.alias("_base"),
        F.when(dense, F.col("_rows")).otherwise(F.raise_error(F.lit("row_idx has gaps"))).alias("_rows"),
    ).select(
        "_base",
        F.transform("_rows", lambda r: r["event"]).alias("_events"),
        F.transform("_rows", lambda r: r["label"]).alias("_labels"),
    )
    # First multiple of the stride in the chunk, then every stride while the window fits.
    first = F.ceil(F.col("_base") / F.lit(stride)) * F.lit(stride) - F.col("_base")
    last = F.least(F.lit(chunk - 1).cast("long"), F.size("_events").cast("long") - F.lit(window_size))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    windows = checked.withColumn("_at", F.explode(starts))
    at = (F.col("_at") + 1).cast("int")
    out = windows.select(
        (F.col("_base") + F.col("_at")).alias("window_start"),
        (F.col("_base") + F.col("_at") + window_size).alias("window_end"),
        F.slice("_events", at, F.lit(window_size)).alias("events"),
        F.array_max(F.slice("_labels", at, F.lit(window_size))).alias("label"),
    )
    out = (
        out.withColumn("seq_id", F.col("window_start"))
        .withColumn("piece", F.lit(0))
        .withColumn("start", F.lit(0))
        .withColumn("length", F.lit(window_size))
    )
    return _shape(out, "sliding_window")


def with_gap_session(df: DataFrame, time_column: str, gap_seconds: float, key: str | None = None) -> DataFrame:
    """Add ``session_id``: a new session starts where the time since the previous line exceeds the gap.

    Two lines whose times fall into the same gap-wide bin are never further apart than the gap, and
    lines two bins apart always are. So sessions follow from one (min, max) row per bin: bin b opens a
    session unless bin b-1 is occupied and ends within the gap. Lines are only aggregated and joined by
    bin, never sorted globally. Lines without a readable time are left out.
    """
    by = [key] if key else []
    gap = int(round(gap_seconds * MICROS))
    width = max(gap, 1)
    timed = df.withColumn("_us", timestamps.micros(df, time_column)).where(F.col("_us").isNotNull())
    timed = timed.withColumn("_bin", F.floor(F.col("_us") / F.lit(width)))
    bins = timed.groupBy(*by, "_bin").agg(F.min("_us").alias("low"), F.max("_us").alias("high"))
    here = bins.select(*by, "_bin", "low", F.lit(None).cast("long").alias("before"))
    after = bins.select(*by, (F.col("_bin") + 1).alias("_bin"), F.lit(None).cast("long").alias("low"), F.col("high").alias("before"))
    paired = here.unionByName(after).groupBy(*by, "_bin").agg(F.max("low").alias("low"), F.max("before").alias("before"))
    opens = F.when(F.col("before").isNull() | (F.col("low") - F.col("before") > gap), 1).otherwise(0)
    flagged = paired.where(F.col("low").isNotNull()).select(*by, "_bin", opens.cast("long").alias("opens"))
    totals = ordering.carry_totals(flagged, "_bin", ["opens"], by)
    numbered = totals.select(*by, "_bin", (F.col("before_opens") + F.col("opens") - 1).alias("session_id"))
    return timed.join(numbered, [*by, "_bin"]).drop("_bin")


def by_time_gap(
    df: DataFrame,
    time_column: str,
    event: str = "event_id",
    label: str | None = "label",
    line: str = "line_id",
    time_window_seconds: float = 3600,
    key: str | None = None,
    max_piece: int = MAX_PIECE,
    sep: str | None = None,
) -> DataFrame:
    """One sequence per gap session, in time order (ties by line); with its span in seconds.

    With ``key``, sessions are found for each key on its own.
    """
    sessions = with_gap_session(df, time_column, time_window_seconds, key)
    keys = ["_key", "session_id"] if key else ["session_id"]
    more = [F.col("session_id"), F.col("_us")] + ([F.col(key).cast("string").alias("_key")] if key else [])
    tokens = _tokens(sessions, event, label, line, *more)
    bounds = {"_from": F.min("_us"), "_to": F.max("_us")}
    out = assemble(tokens, keys, "_us", max_piece, bounds, sep)
    return _shape(
        out.withColumn("seq_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).withColumn(
            "time_span_seconds", timestamps.seconds_between(F.col("_from"), F.col("_to"))
        ),
        "time_window",
    )


def build(
    df: DataFrame,
    strategy: str = "block_id",
    *,
    event: str = "event_id",
    label: str | None = "label",
    content: str = "content",
    line: str = "line_id",
    time_column: str | None = None,
    window_size: int = 20,
    stride: int = 1,
    time_window_seconds: float = 3600,
    block_id_regex: str = text.DEFAULT_BLOCK_ID,
    session: str = "session_id",
) -> DataFrame:
    """Build sequences with one of STRATEGIES."""
    if strategy == "block_id":
        return by_block(df, event, label, content, line, block_id_regex)
    if strategy == "session":
        return by_session(df, event, label, line, session, window_size)
    if strategy == "sliding_window":
        return by_sliding_window(df, event, label, line, window_size, stride)
    if strategy == "time_window":
        if time_column is None:
            raise ValueError("time_column required for time_window strategy")
        return by_time_gap(df, time_column, event, label, line, time_window_seconds)
    raise ValueError(f"Unknown grouping strategy: {strategy}")


def class_counts(seqs: DataFrame) -> DataFrame:
    """Sequences per label."""
    return seqs.where(F.col("start") == 0).groupBy("label").agg(F.count(F.lit(1)).alias("sequences"))
