"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of ``LEAST`` words. For each document and item that meet, running
Karp-Rabin matching marks the longest common run of unmarked words again and again, so passages are found in any order.
An item whose words are covered by tiles to ``COVERAGE`` or more is leaked.

The benchmark comes in blocks of at most ``BLOCK_ITEMS`` items, each sent to all tasks; documents are scanned in place
and never shuffled, whatever their size and however often a passage repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import words

LEAST = 5
COVERAGE = 0.8
BLOCK_ITEMS = 20_000

SCHEMA = (
    "doc_id long, item_id long, item_words long, tiled_words long, n_tiles long, coverage double, "
    "tiles array<struct<item_at:int,doc_at:int,length:int>>"
)
# ASCII characters other than letters and digits part words, in place of white space alone.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Runs:
    """Hashes of runs of any length over a word sequence, and which words are still unmarked."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.free = np.ones(len(hashes), bool)
        words._grow(len(hashes) + 2)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * words._powers[: len(hashes)], out=self.sums[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``size`` unmarked words."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[size:] == taken[:n])
        return at, (self.sums[at + size] - self.sums[at]) * words._inverses[at]


def _matches(item: _Runs, text: _Runs, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``size`` unmarked words as (-length, item start, text start)."""
    at, seen = item.windows(size)
    where, hashes = text.windows(size)
    order = np.argsort(seen, kind="stable")
    at, seen = at[order], seen[order]
    first, last = np.searchsorted(seen, hashes, "left"), np.searchsorted(seen, hashes, "right")
    found = []
    for k in np.flatnonzero(last > first):
        j = int(where[k])
        for i in at[first[k] : last[k]].tolist():
            if i and j and item.free[i - 1] and text.free[j - 1] and item.hashes[i - 1] == text.hashes[j - 1]:
                continue  # the run that began a word earlier holds this one
            end = size
            most = min(len(item.hashes) - i, len(text.hashes) - j)
            while end < most and item.free[i + end] and text.free[j + end] and item.hashes[i + end] == text.hashes[j + end]:
                end += 1
            if bool((item.hashes[i : i + size] == text.hashes[j : j + size]).all()):
                found.append((-end, i, j))
    return sorted(found)


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length) of two word-hash sequences; ties go to the earliest."""
    one, two = _Runs(item), _Runs(text)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while True:
        while found := _matches(one, two, size):
            for minus, i, j in found:
                if one.free[i : i - minus].all() and two.free[j : j - minus].all():
                    one.free[i : i - minus] = two.free[j : j - minus] = False
                    out.append((i, j, -minus))
        if size <= least:
            return out
        size = max(least, size // 2)


def _words(column: pa.Array) -> Iterator[tuple[int, words.Words]]:
    for first, _, data, offsets in words.slices(pc.utf8_lower(pc.fill_null(column, ""))):
        yield first, words.Words(np.where(_PARTS[data], np.uint8(0x20), data), offsets)


class _Block:
    """Benchmark items and where their runs of LEAST words are."""

    def __init__(self, ids: list[int], sequences: list[np.ndarray], least: int) -> None:
        self.ids, self.sequences, self.least = ids, sequences, least
        runs = [words.grams(s, least) for s in sequences]
        seeds = np.concatenate([np.zeros(0, np.uint64), *runs])
        owners = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        places = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(r)) for r in runs]])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners, self.places = seeds[order], owners[order], places[order]

    def meets(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, first, last): positions in a word sequence whose run is a seed, and which seeds these are."""
        found = words.grams(hashes, self.least)
        first = np.searchsorted(self.seeds, found, "left")
        hit = np.flatnonzero(self.seeds[np.minimum(first, len(self.seeds) - 1)] == found) if len(self.seeds) else []
        for p in hit:
            yield int(p), int(first[p]), int(np.searchsorted(self.seeds, found[p], "right"))

    def leaks(self, found: words.Words, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of the texts of a slice that cover an item."""
        near: dict[tuple[int, int], tuple[set[int], list[int]]] = {}
        for p, first, last in self.meets(found.hashes):
            k = int(np.searchsorted(found.bounds, p, "right")) - 1
            if p + self.least > found.bounds[k + 1]:
                continue
            for s in range(first, last):
                seen, at = near.setdefault((k, int(self.owners[s])), (set(), []))
                place = int(self.places[s])
                seen.update(range(place, place + self.least))
                at.append(p - int(found.bounds[k]))
        for (k, owner), (seen, at) in near.items():
            item = self.sequences[owner]
            if len(seen) < coverage * len(item):
                continue  # the words of its seeds bound what tiles can cover
            text, n = found.of(k), len(item)
            wide = np.zeros(len(text) + 1, np.int64)
            spots = np.unique(at)
            np.add.at(wide, np.maximum(spots - n, 0), 1)
            np.add.at(wide, np.minimum(spots + self.least + n, len(text)), -1)
            # Runs begin and end near seeds: the rest of a long text has none. A mark that equals no word parts the areas.
            keep = np.flatnonzero(np.cumsum(wide[:-1]) > 0)
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            parted = np.insert(text[keep], gap, np.uint64(0) - np.arange(1, len(gap) + 1, dtype=np.uint64))
            places = np.insert(keep, gap, -1)
            made = [(i, int(places[j]), length) for i, j, length in tiles(item, parted, self.least)]
            if sum(x[2] for x in made) >= coverage * n:
                yield k, owner, made


def _blocks(benchmark: DataFrame, least: int, size: int) -> Iterator[_Block]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = -(-items.count() // size)
    for b in range(n):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect())
        with np.errstate(over="ignore"):
            sequences = [found.of(k) for _, found in _words(pa.array([r.text for r in rows], pa.string())) for k in range(len(found))]
            yield _Block([r.item_id for r in rows], sequences, least)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row (see SCHEMA) for each document and item of which tiles cover ``coverage`` of the words or more.

    Words are runs of letters, digits and non-ASCII characters, in lower case. Items with fewer than ``least`` words,
    null ids or null texts match nothing; null and empty documents hold nothing. Rows with a null doc_id are searched
    and come back with a null id; repeated rows come back as often as they came, repeated items once. Only doc_id,
    item_id and text are read. Documents that hold no item give no row, and empty tables none.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def of(shared):
        def run(batches):
            for batch in batches:
                block, rows = shared.value, []
                with np.errstate(over="ignore"):
                    for at, found in _words(batch.column(1)):
                        for k, owner, made in block.leaks(found, coverage):
                            n, tiled = len(block.sequences[owner]), sum(x[2] for x in made)
                            parts = [{"item_at": i, "doc_at": j, "length": length} for i, j, length in sorted(made)]
                            rows.append((batch.column(0)[at + k].as_py(), block.ids[owner], n, tiled, len(made), tiled / n, parts))
                kind = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
                kinds = [pa.int64()] * 5 + [pa.float64(), kind]
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "item_words", "tiled_words", "n_tiles", "coverage", "tiles"])

        return run

    found = [docs.mapInArrow(of(context.broadcast(block)), SCHEMA) for block in _blocks(benchmark, least, block_items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whole and with all their columns."""
    at, context = docs.columns.index("text"), docs.sparkSession.sparkContext

    def of(shared):
        def run(batches):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                with np.errstate(over="ignore"):
                    for first, found in _words(batch.column(at)):
                        for k, _, _ in shared.value.leaks(found, coverage):
                            good[first + k] = False
                yield batch.filter(pa.array(good))

        return run

    schema = docs.schema
    for block in _blocks(benchmark, least, block_items):
        docs = docs.mapInArrow(of(context.broadcast(block)), schema)
    return docs
