"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32. Two fingerprints that differ in at most ``most`` bits differ, in
some segment, in no more bits than that segment's radius (the pigeonhole bound: 1 and 0 for two bits). Every distinct
fingerprint stands in the table of each segment under its segment value; it also enumerates the Hamming ball of the radius
around that value and fetches what the table holds there. Whole distances are verified on all that is fetched. Of two
fingerprints one bit apart in a segment, only the one with the smaller value asks.

A table entry that more than ``DENSE`` fingerprints share (a large group of near copies) is not read pair by pair. The
fingerprints that stand there or ask there are compared with one segment of all 64 bits and balls around both sides: two
of them are linked exactly if their balls of half the distance meet, and no point lies in more than a ball's number of
fingerprints, so each costs a fixed number of rows however large the group is.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import words
from tracemill.llm.graph import components, large_partitions
from tracemill.session import stored

SEED = 42
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
# Up to so many fingerprints under one table entry are fetched as candidates.
DENSE = 64
# Hashes whose bits are counted at once.
BITS_AT_ONCE = 1 << 14


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every ``size``-word shingle of a text, repeats included; of the whole sequence if it has fewer words."""
    found = text.lower().split()  # bytes: folds A-Z and splits at 0x20 and 0x09-0x0D only
    joined = b" ".join(found)
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if found else []
    ends = list(accumulate(map(len, found), lambda end, n: end + n + 1))
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BITS_AT_ONCE):
        part = np.array(hashes[k : k + BITS_AT_ONCE], "<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in words.slices(batch.column(1)):
                raw = data.tobytes()
                found = [majority(shingle_hashes(raw[offsets[k] : offsets[k + 1]], size)) for k in range(end - first)]
                prints = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), prints], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def _ball(width: int, radius: int) -> list[int]:
    """Masks that change at most ``radius`` of ``width`` bits, as signed 64-bit values."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _radii(most: int) -> list[int]:
    """How far each segment is searched, -1 for not at all: a pair within ``most`` bits is within one of them."""
    whole, rest = divmod(most, SEGMENTS)
    return [whole if k <= rest else whole - 1 for k in range(SEGMENTS)]


def _segment(k: int) -> Column:
    return F.shiftrightunsigned("fingerprint", k * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _fetched(prints: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, fingerprint) of the segment tables and (key, asking, moved) of the searches in them."""
    radii = _radii(most)
    used = [k for k in range(SEGMENTS) if radii[k] >= 0]
    key = lambda k, value: F.shiftleft(F.lit(k).cast("long"), WIDTH).bitwiseOR(value)
    table = prints.select(F.explode(F.array(*[key(k, _segment(k)) for k in used])).alias("key"), "fingerprint")

    def asked(k: int) -> Column:
        own = _segment(k)
        around = F.transform(_masks(_ball(WIDTH, radii[k])), lambda m: own.bitwiseXOR(m))
        return F.transform(F.filter(around, lambda v: v >= own), lambda v: F.struct(key(k, v).alias("key"), (v != own).alias("moved")))

    searches = prints.select(F.explode(F.concat(*[asked(k) for k in used])).alias("at"), F.col("fingerprint").alias("asking"))
    return table, searches.select("at.key", "asking", "at.moved")


def _meeting(prints: DataFrame, most: int) -> DataFrame:
    """Links (src, dst) that connect all of ``prints`` within ``most`` bits: balls around both that share a point."""
    inner, outer = most // 2, most - most // 2
    points = prints.select(
        "fingerprint", F.explode(_masks(_ball(64, outer))).alias("mask")
    ).select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("point"), "fingerprint", (F.bit_count("mask") <= inner).alias("near"))
    # At most a ball's number of fingerprints for each point.
    held = points.groupBy("point").agg(F.collect_set("fingerprint").alias("held"), F.min(F.when(F.col("near"), F.col("fingerprint"))).alias("dst"))
    ties = held.where(F.size("held") > 1).where("dst IS NOT NULL").select(F.explode("held").alias("src"), "dst")
    return ties.where(F.col("src") != F.col("dst")).where(_distance("src", "dst") <= most)


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Links (src, dst) between the distinct ``fingerprint`` values of stored ``prints``: enough to connect all pairs that
    differ in at most ``most`` bits (0 to 4)."""
    if not 0 <= most <= 4:
        raise ValueError("a distance of 0 to 4 bits can be searched")
    table, searches = _fetched(prints, most)
    dense = stored(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select("key"))
    crowded = not dense.isEmpty()
    if crowded:
        own = searches.select("key", F.col("asking").alias("fingerprint")).union(table)
        heavy = stored(own.join(dense, "key", "left_semi").select("fingerprint").distinct())
        table, searches = stored(table.join(dense, "key", "left_anti")), searches.join(dense, "key", "left_anti")
    found = (
        searches.join(table, "key")
        .where((F.col("moved") | (F.col("asking") < F.col("fingerprint"))) & (_distance("asking", "fingerprint") <= most))
        .select(F.col("asking").alias("src"), F.col("fingerprint").alias("dst"))
    )
    return found.union(_meeting(heavy, most)) if crowded else found


def classes(docs: DataFrame, size: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Fingerprints link when they differ in at most ``most`` bits; ``component_id`` is the smallest doc_id of all rows
    whose fingerprints links reach, the row's own included. Null, empty and blank texts have fingerprint 0 and are linked
    like any other. Rows with a null doc_id come back with their fingerprint and the component they fall into, null if no
    row of it has an id; repeated rows come back as often as they came, and rows that share an id but not a text each have
    the component of their own text. An empty table gives none.
    """
    with large_partitions(docs.sparkSession):
        signed = stored(fingerprints(docs, size))
        prints = stored(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
        reached = components(links(prints, most)).select(F.col("node").alias("fingerprint"), "component")
        linked = stored(reached.join(prints, "fingerprint"))
        least = stored(linked.groupBy("component").agg(F.min("first").alias("least")))
        named = linked.join(least, "component").select("fingerprint", "least")
        labels = stored(prints.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id")))
        return signed.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")
