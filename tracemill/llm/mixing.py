"""Mixing of sources to target weights by systematic sampling, in DataFrame functions alone.

Each document of a source is expected ``target / source size`` times. Documents of a source stand in the order of their
size and, within a size, of the md5 of their id; their expected copies are summed along it, one random offset per source is added, and a
document is emitted once for each integer that its interval crosses. Every run of documents so gets its share to within
one copy, large and small ones alike.

The prefix sum never has a source in one task: a document's place is the number of documents of smaller size (one row
for each size), plus that of its size in earlier hash cells (at most 16**CELL_DIGITS), plus its place in its cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CELL_DIGITS = 2


def size_of(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with weight and target, one row for each source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all sizes in proportion.
    No target exceeds ``most`` times its source's size; what is above is shared again. That is a common level times the
    weight for all sources below their limit, and the level is the largest that any set of limited sources asks for.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    every = Window.partitionBy()
    before = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    asked = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = weighed.withColumn("_asked", asked).withColumn("_level", F.max("_asked").over(every))
    return levels.select("source", "source_size", "weight", F.least(limit, F.col("_level") * F.col("weight")).alias("target"))


def _name(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _fraction(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def planned(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, cell_digits: int = CELL_DIGITS
) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with size, source_size, target, copies and taken (copies * size).

    Null texts have size 0. A null source is a source of its own, last in order; a null doc_id counts as an empty one.
    Rows that repeat an id and size stand next to each other and are counted one by one. Documents of size 0 are
    copied like the others and take nothing; a source of no words has target 0 and no copies. Columns with the names
    made here are replaced. The plan depends on rows and ``seed`` alone. An empty table gives no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken", "_source", "_hash", "_cell")
    rows = docs.drop(*made)
    rows = rows.withColumns({"size": size_of(), "_source": _name(), "_hash": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    rows = rows.withColumn("_cell", F.substring("_hash", 1, cell_digits))
    cells = rows.groupBy("source", "_source", "size", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by_size = cells.groupBy("source", "_source", "size").agg(F.sum("_n").alias("_n"))
    sources = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, share, most)
    sources = sources.select(_name().alias("_source"), "source_size", "target")
    lower = Window.partitionBy("_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before_size = by_size.select("_source", "size", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"))
    earlier = Window.partitionBy("_source", "size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before_cell = cells.select("_source", "size", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    starts = before_cell.join(before_size, ["_source", "size"]).join(sources, "_source")
    starts = starts.withColumn("_start", F.col("_lower") + F.col("_earlier"))
    place = F.row_number().over(Window.partitionBy("_source", "size", "_cell").orderBy("_hash")) - 1
    placed = rows.withColumn("_place", place).join(starts, ["_source", "size", "_cell"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _fraction(F.concat(F.lit(f"mix/{seed}/"), F.col("_source")))
    rank = F.col("_start") + F.col("_place")
    copies = F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)
    return placed.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long")).select(
        *[F.col(c) for c in docs.columns if c not in made], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, with the columns of ``docs``."""
    plan = planned(docs, weights, share, most, seed).where("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
