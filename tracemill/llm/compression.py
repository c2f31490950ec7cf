"""Quality rules on word counts and on zstandard compression, whole and by chunk, with limits by length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tracemill.llm import words

LEVEL = 3
CHUNK_BYTES = 4096


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``bytes`` bytes: the whole ratio lies from ``low`` to ``high``."""

    bytes: int
    low: float
    high: float


# Frames cost some bytes and short texts have little to refer back to, so limits move with length. Texts shorter than
# the first band have no verdict of their own.
BANDS = (Band(256, 0.20, 0.90), Band(1024, 0.18, 0.75), Band(4096, 0.15, 0.66), Band(32768, 0.10, 0.62))
# A chunk outside these is repetitive or incompressible; a text fails if more than so large a part of its chunks is.
CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 0.12, 0.72, 0.5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, ratio double, n_chunks long, low_chunks long, high_chunks long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    found = words.grams(hashes, 3)
    order = np.argsort(found, kind="stable")
    same = np.flatnonzero(found[order[1:]] == found[order[:-1]])
    if not len(same):
        return 0
    at = np.concatenate((order[same], order[same + 1]))
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[at + j] = True
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


class _Scales:
    def __init__(self) -> None:
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def ratios(self, text: memoryview) -> tuple[float, int, int, int]:
        """Compressed by original size of the whole; chunks, and those below and above the chunk limits.

        The last chunk takes what is left, up to one and a half chunks, so no chunk is short unless the text is.
        """
        n = len(text)
        whole = len(self.press.compress(text)) / n if n else 1.0
        chunks = max(1, (n + CHUNK_BYTES // 2) // CHUNK_BYTES) if n else 0
        low = high = 0
        if chunks > 1:
            for c in range(chunks):
                part = text[c * CHUNK_BYTES : n if c == chunks - 1 else (c + 1) * CHUNK_BYTES]
                ratio = len(self.press.compress(part)) / len(part)
                low += ratio < CHUNK_LOW
                high += ratio > CHUNK_HIGH
        return whole, chunks, low, high


def passes(n: int, whole: float, chunks: int, low: int, high: int, bands: tuple[Band, ...]) -> bool:
    """Whether the ratios of a text of ``n`` bytes lie within its limits."""
    band = next((b for b in reversed(bands) if n >= b.bytes), None)
    if band is None:
        return True
    return band.low <= whole <= band.high and low + high <= CHUNK_SHARE * chunks


def _measured(column: pa.Array, bands: tuple[Band, ...]):
    """The columns of SCHEMA after doc_id, a slice of texts at a time."""
    scales = _Scales()
    for _, _, data, offsets in words.slices(column):
        with np.errstate(over="ignore"):
            found = words.Words(data, offsets)
            repeats = [repeated_words(found.of(k)) for k in range(len(found))]
        n_words = np.diff(found.bounds)
        chars = _per_text(((data & 0xC0) != 0x80) & ~words.BLANK[data], offsets)
        symbols = _per_text(_SYMBOL[data], offsets)
        raw = memoryview(np.ascontiguousarray(data))
        for k in range(len(found)):
            text = raw[offsets[k] : offsets[k + 1]]
            n, rep = int(n_words[k]), repeats[k]
            failed = n < 50 or 100 * rep > 50 * n
            whole, chunks, low, high = scales.ratios(text)
            kept = not failed and passes(len(text), whole, chunks, low, high, bands)
            yield n, int(chars[k]), int(symbols[k]), repeated_lines(bytes(text)), rep, failed, kept, len(text), whole, chunks, low, high


def measures(docs: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read), see SCHEMA.

    ``base_failed``: under 50 words, or more than half of them in repeated 3-word windows. ``kept`` is false for these
    and for texts whose ratios leave the limits of their length. Null and empty texts have 0 everywhere, ratio 1 and
    fail; a null doc_id stays null; repeated rows are measured each; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            rows = list(_measured(batch.column(1), bands))
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            verdicts = [row[6] for row in _measured(batch.column(at), bands)]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
