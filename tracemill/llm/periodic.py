"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q and at least ``times`` * q words that no neighbouring word extends. Runs
are found scale by scale, for t = 1, 2, 4, ...:

* Position i is in the synchronising set of scale t if, of the hashes of the t-word pieces that begin at i to i + t, the
  smallest stands at i or at i + t. Pieces within a highly periodic region (period at most t / 3) have no hash; those regions
  are runs of smaller scales, so they are known by then. Whether i is chosen depends on the 2t words from i alone.
* A run of period 3t to 6t - 1 is not highly periodic throughout, so one of its first positions is chosen, and with it the
  position one period later: both have equal contexts of 2t words. Positions with equal contexts at such a distance propose
  that distance as a period. Equal contexts stand more than t / 3 apart, so a position has at most 18 partners.
* A proposal is extended word by word in both directions as far as it holds. What has a smaller period was found at a smaller
  scale, with the same ends.

Periods 1 and 2, below the smallest scale, are read off by comparing neighbours. The texts of a slice are worked on in one
array, parted by marks that occur once, so that no run crosses a mark. Words are compared as numbers that stand for them.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import words

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return words.mixed(left * np.uint64(0xD6E8FEB86659FD93) + right, 30)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _same(w: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` of positions x with w[x] == w[x + d]."""
    last, step, end = len(w) - d, 64, at
    while end < last:
        other = w[end : min(end + step, last)] != w[end + d : min(end + step, last) + d]
        if other.any():
            end += int(other.argmax())
            break
        end, step = min(end + step, last), 2 * step
    step, start = 64, at
    while start > 0:
        low = max(0, start - step)
        other = (w[low:start] != w[low + d : start + d])[::-1]
        if other.any():
            start -= int(other.argmax())
            break
        start, step = low, 2 * step
    return start, end


def _chosen(v: np.ndarray, t: int) -> np.ndarray:
    """The synchronising set: positions where the smallest of v[i : i + t + 1] stands first or last."""
    least, width = v, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(v) - t], v[t:])
    return np.flatnonzero((least != _NONE) & ((v[: len(least)] == least) | (v[t:] == least)))


def _proposed(positions: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts, 3t to 6t - 1 words apart."""
    order = np.argsort(contexts, kind="stable")
    p, c = positions[order], contexts[order]
    at, k, found = np.arange(len(p)), 0, []
    while len(at):
        k += 1
        at = at[at + k < len(p)]
        gap = p[at + k] - p[at]
        near = (c[at + k] == c[at]) & (gap < 6 * t)
        at, gap = at[near], gap[near]
        found.append((p[at[gap >= 3 * t]], gap[gap >= 3 * t]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(w: np.ndarray, longest: int, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``times`` periods in the numbers ``w``; none is longer than ``longest``."""
    found: dict[tuple[int, int], int] = {}
    for d in (1, 2):
        for a, b in zip(*(x.tolist() for x in _stretches(w[d:] == w[:-d]))):
            if b - a >= (times - 1) * d:
                found.setdefault((a, b + d), d)
    t, h = 1, words.mixed(w.astype(np.int64).view(np.uint64), 31)
    while 3 * t * times <= longest and len(w) >= 2 * t:
        v = h.copy()
        known = np.array([(a, b, q) for (a, b), q in found.items() if 3 * q <= t <= b - a], np.int64).reshape(-1, 3)
        if len(known):
            inside = np.zeros(len(v) + 1, np.int64)
            np.add.at(inside, known[:, 0], 1)
            np.add.at(inside, known[:, 1] - t + 1, -1)
            v[np.cumsum(inside[:-1]) > 0] = _NONE
        doubled = _joined(h[: len(h) - t], h[t:])
        positions = _chosen(v, t)
        i, d = _proposed(positions, doubled[positions], t)
        # The words that repeat reach at least d - t beyond the context on one of its sides.
        left, right = i - d + t, i + 2 * d
        ahead = (right < len(h)) & (h[np.minimum(i + d, len(h) - 1)] == h[np.minimum(right, len(h) - 1)])
        behind = (left >= 0) & (h[np.maximum(left, 0)] == h[i + t])
        take = ahead | behind
        i, d = i[take], d[take]
        order = np.lexsort((i, d))
        period = end = -1
        for at, gap in zip(i[order].tolist(), d[order].tolist()):
            if gap == period and at < end:
                continue
            start, end = _same(w, at, gap)
            period = gap
            if end - start >= (times - 1) * gap:
                found.setdefault((start, end + gap), gap)
        t, h = 2 * t, doubled
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _marked(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their numbers in one array with a mark after each text, and where each text begins."""
    found = [x.split() for x in texts]  # bytes: splits at 0x20 and 0x09-0x0D only
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(x, len(numbers)) for x in chain.from_iterable(found)), np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes)
    starts = ends - sizes + np.arange(len(found))
    w = np.insert(flat, ends, -1 - np.arange(len(found)))
    return found, w, starts


def runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text; other columns are not read).

    ``runs`` holds (start, length, period), in words from 0, of every run of at least ``least`` words and ``times`` (3 or
    more) periods, by start and then period. ``collapsed`` has the words that no run holds behind its first period, joined by
    one space. Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows and rows without
    a doc_id each have their own result; an empty table gives none. A text is worked on whole, however long it is.
    """
    if times < 3:
        raise ValueError("runs of less than three periods are not found")

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in words.slices(batch.column(1)):
                raw = data.tobytes()
                found, w, starts = _marked([raw[offsets[k] : offsets[k + 1]] for k in range(end - first)])
                kept = np.ones(len(w), bool)
                spans = []
                with np.errstate(over="ignore"):
                    for start, length, period in runs_of(w, max(map(len, found)), times):
                        if length >= max(least, times * period):
                            kept[start + period : start + length] = False
                            k = int(np.searchsorted(starts, start, "right")) - 1
                            spans.append((k, start - starts[k], length, period))
                spans = np.array(spans, np.int64).reshape(-1, 4)
                spans = spans[np.lexsort((spans[:, 3], spans[:, 1], spans[:, 0]))]
                texts = []
                for at, own in zip(starts.tolist(), found):
                    mask = kept[at : at + len(own)]
                    texts.append(b" ".join(own if mask.all() else [x for x, k in zip(own, mask.tolist()) if k]))
                lists = pa.StructArray.from_arrays([pa.array(spans[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
                bounds = np.searchsorted(spans[:, 0], np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lists),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
