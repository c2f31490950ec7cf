"""Language identification of texts that may mix languages.

Every word (run of letters, lower-cased) has a likelihood under each language, from hashed letter trigrams with the word
edges as letters. For each text, expectation-maximisation over its words estimates the proportions of the languages;
sets of one, two and more languages, each the largest proportions of all, compete by likelihood less a penalty for each
further language, and the prediction is the largest proportion of the winning set.

The model is trigram counts of all labelled rows, formed in tasks and summed: one table of fixed size per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import tables, words

BITS = 16
SMOOTHING = 0.5
# Languages that a text may mix, rounds of expectation-maximisation, and the cost of one more language in nats for each
# factor e of words.
MOST_LANGUAGES = 4
ROUNDS = 8
PENALTY = 2.0
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


class _Letters:
    """The letters of a slice of texts: the trigram cell of each, and the first letter and the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        bounds = heads[offsets]
        inside = _is_letter(codes)
        edge = np.zeros(len(codes) + 1, bool)
        edge[bounds] = True
        before, after = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
        shown = np.where(inside, codes, 0).astype(np.uint64)
        before[1:], after[:-1] = shown[:-1], shown[1:]
        before[edge[:-1]] = 0
        after[edge[1:]] = 0
        at = np.flatnonzero(inside)
        keys = (before[at] << np.uint64(42)) | (shown[at] << np.uint64(21)) | after[at]
        self.cells = (words.mixed(keys, 30) >> np.uint64(64 - BITS)).astype(np.int64)
        self.first = np.flatnonzero(before[at] == 0)  # in self.cells
        self.texts = np.searchsorted(bounds, at[self.first], "right") - 1
        self.letter_texts = np.searchsorted(bounds, at, "right") - 1


def _slices(column: pa.Array, limit: int = words.SLICE_BYTES) -> Iterator[tuple[int, int, _Letters]]:
    for first, end, data, offsets in words.slices(pc.utf8_lower(pc.fill_null(column, "")), limit):
        yield first, end, _Letters(data, offsets)


@dataclass(frozen=True)
class Model:
    """``languages`` in code point order and the log probability of each trigram cell under each, cell by language."""

    languages: tuple[str, ...]
    logs: np.ndarray


def fit(rows: DataFrame) -> Model:
    """Counts over all ``rows`` (text, lang); rows without language, text or letters teach nothing."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            known = sorted(set(names))
            number = np.array([known.index(x) for x in names], np.int64)
            for first, _, letters in _slices(batch.column(0)):
                keys = number[letters.letter_texts + first] << BITS | letters.cells
                found = np.bincount(keys, minlength=len(known) << BITS).reshape(-1, 1 << BITS)
                for k in np.flatnonzero(found.any(axis=1)):
                    counts.setdefault(known[k], np.zeros(1 << BITS, np.int64))[:] += found[k]
        blobs = [tables.packed(c) for c in counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(blobs, pa.binary())], ["lang", "counts"])

    counted = rows.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, counts binary")
    # One table of 2**BITS counters for each language.
    found = sorted(tables.summed(counted, "lang", "string", 1 << BITS).collect())
    logs = np.zeros((1 << BITS, len(found)))
    for k, row in enumerate(found):
        counts = tables.unpacked(row.counts, 1 << BITS) + SMOOTHING
        logs[:, k] = np.log(counts / counts.sum())
    return Model(tuple(row.lang for row in found), logs.astype(np.float32))


def _mixtures(likely: np.ndarray, texts: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the ``allowed`` languages and log likelihood of ``n`` texts, from words' likelihoods (largest 1)."""
    first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
    sizes = np.diff(np.append(first, len(texts)))
    own = texts[first]
    share = allowed[own] / allowed[own].sum(axis=1, keepdims=True)
    row = np.repeat(np.arange(len(own)), sizes)
    for _ in range(ROUNDS):
        joint = likely * share[row]
        total = joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint / np.maximum(total, 1e-30), first, axis=0) / sizes[:, None]
    fit_ = np.add.reduceat(np.log(np.maximum((likely * share[row]).sum(axis=1), 1e-30)), first)
    shares, fits = np.zeros((n, likely.shape[1])), np.zeros(n)
    shares[own], fits[own] = share, fit_
    return shares, fits


def _predicted(model: Model, letters: _Letters, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its proportion and the number of languages of each of ``n`` texts."""
    many = len(model.languages)
    names, scores, kinds = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
    if not len(letters.first) or not many:
        return names, scores, kinds
    logs = np.add.reduceat(model.logs[letters.cells], letters.first, axis=0).astype(np.float64)
    likely = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0))
    n_words = np.bincount(letters.texts, minlength=n)
    shares, _ = _mixtures(likely, letters.texts, n, np.ones((n, many), bool))
    ranks = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
    best, value = shares, np.full(n, -np.inf)
    for size in range(1, min(MOST_LANGUAGES, many) + 1):
        tried, fits = _mixtures(likely, letters.texts, n, ranks < size)
        scored = fits - PENALTY * (size - 1) * np.log(np.maximum(n_words, 2))
        better = scored > value
        best = np.where(better[:, None], tried, best)
        kinds = np.where(better, size, kinds)
        value = np.where(better, scored, value)
    top = best.argmax(axis=1)
    for k in np.flatnonzero(n_words):
        names[k] = model.languages[top[k]]
    has = n_words > 0
    return names, np.where(has, np.clip(best.max(axis=1), 0, 1), 0.0), np.where(has, kinds, 0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred string, score double (the proportion of that language) and n_languages long.

    Texts that are null or have no letter are ``und`` with score 0, as is every text if the model learned no language.
    Ties go to the first language in code point order. Columns of these names that ``docs`` brings are replaced; a
    column ``lang`` is passed on and never read.
    """
    made = ("lang_pred", "score", "n_languages")
    docs = docs.drop(*made)
    at, names = docs.columns.index("text"), [*docs.columns, *made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, words.SLICE_BYTES * 4 // max(4, len(model.languages)))

    def run(batches):
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            with np.errstate(over="ignore"):
                for first, end, letters in _slices(batch.column(at), limit):
                    for out, part in zip(found, _predicted(shared.value, letters, end - first)):
                        out.extend(part)
            more = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, n_languages long")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
