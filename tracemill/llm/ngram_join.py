"""N-gram Jaccard self-join of documents by prefix filters under several global token orders.

Two shingle sets with Jaccard similarity of at least t share a token among the first ``n - ceil(t n) + 1`` tokens of
both, whatever total order the tokens are sorted by. Two orders are used, both putting rare tokens first (frequencies
are counted over the whole corpus into a table of fixed size; a collision moves a token, it never loses a pair) and
breaking ties by unrelated hashes. A pair is verified on whole sets when its sizes allow the threshold and it shares a
prefix token under both orders.

Rows with equal sets form a class, named by a hash of its set, so rows that share a doc_id but not a text are told apart. One
shuffle brings the prefix tokens of the first order together and names the pairs of classes that share one; those that
also share one under the second order are candidates, and candidates fall into families. A token that more than
``MAX_POSTINGS`` classes share becomes a node that all of them are tied to, instead of naming their pairs; tokens whose counter
shows thousands of hits do so at once and do not travel by their key. A family's texts travel once; there all of its pairs
pass both filters before they are verified, in pairs of blocks of bounded size. A family of several blocks is first
verified within blocks; after that, members of its largest class need no test among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import words
from tracemill.llm.graph import components, forest, large_partitions
from tracemill.session import broadcast_if_small, shuffles_removed, stored

# Up to so many classes with one prefix token, their pairs are named; beyond that they are tied to the token.
MAX_POSTINGS = 32
# A token whose counters have so many hits is tied to its classes without a shuffle by token.
HOT_HITS = 1 << 14
# A block holds about so many documents and so many shingles.
BLOCK_DOCS = 128
BLOCK_SHINGLES = 100_000
# Between the blocks of a family, up to so many blocks are taken together, so that a family has so many wide blocks, more
# only if these would be wider than that. A text travels once for each wide block of the other side.
WIDE = 16
# Family members up to this number are sent to the texts, more of them meet the texts in a shuffle.
BROADCAST_ROWS = 200_000
# The frequency table has one counter for so many tokens, between 2**12 and 2**24 counters, in parts of 2**15.
TOKENS_PER_COUNTER = 128
PART_BITS = 15


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in words.slices(column):
        found = words.Words(data, offsets, fold=True)
        for k in range(len(found)):
            yield words.shingle_set(found.of(k), size)


def _class(s: np.ndarray) -> np.ndarray:
    """The name of a set."""
    return words.mixed(words.mixed(s, 3).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)), 4).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, class) of each row; rows with equal sets have one class."""

    def run(batches):
        for batch in batches:
            n, names = [], []
            with np.errstate(over="ignore"):
                for s in _sets(batch.column(2), size):
                    n.append(len(s))
                    names.append(_class(s))
            names = np.concatenate(names) if names else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names)], ["doc_id", "text_key", "n_shingles", "class"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, class long")


def _packed(counts: np.ndarray) -> bytes:
    """Counters as bytes: one byte each and the places and values of those of 255 or more, compressed.

    A task meets few tokens for each counter of a large corpus, so its table comes to about a bit for each counter, or less.
    """
    high = np.flatnonzero(counts >= 255)
    low = pa.compress(np.minimum(counts, 255).astype(np.uint8), "zstd", asbytes=True)
    return len(high).to_bytes(8, "little") + high.astype(np.int64).tobytes() + counts[high].astype(np.uint64).tobytes() + low


def _add_packed(out: np.ndarray, blob: bytes) -> None:
    """Add packed counters to ``out`` (unsigned, 64 bits)."""
    n = int.from_bytes(blob[:8], "little")
    out += np.frombuffer(pa.decompress(blob[8 + 16 * n :], len(out), "zstd", asbytes=True), np.uint8)
    high, counts = np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.uint64, n, 8 + 8 * n)
    out[high] += counts - np.uint64(255)


def _frequencies(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """2 x 2**bits frequency grades: how often a token's counters were hit, on a logarithmic scale from 0 to 255."""
    parts = 1 << (bits - PART_BITS) if bits > PART_BITS else 1
    width = (1 << bits) // parts

    def count(batches):
        counts = np.zeros((2, 1 << bits), np.uint32)
        held, waiting = [], 0

        def flush():
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for row in (0, 1):
                np.add.at(counts[row], _cell(tokens, row, bits), np.uint32(1))
            held.clear()

        for batch in batches:
            for s in _sets(batch.column(0), size):
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 21:
                    flush()
                    waiting = 0
        flush()
        for row in (0, 1):
            blobs = [_packed(counts[row, p * width : (p + 1) * width]) for p in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([row * parts + p for p in range(parts)], pa.int64()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def summed(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros(width, np.uint64)
        for blob in frame["counts"]:
            _add_packed(out, blob)
        return out

    def total(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "counts": [_packed(summed(frame))]})

    def graded(key, frame: pd.DataFrame) -> pd.DataFrame:
        grade = np.minimum(255, np.floor(8 * np.log2(1 + summed(frame).astype(float)))).astype(np.uint8)
        return pd.DataFrame({"part": [key[0]], "grades": [grade.tobytes()]})

    counted = docs.mapInArrow(count, "part long, counts binary")
    # Two levels, so that no group has more than a few hundred tables, however many tasks there were.
    counted = counted.withColumn("salt", F.floor(F.spark_partition_id() / F.lit(256)))
    once = counted.groupBy("part", "salt").applyInPandas(total, "part long, counts binary")
    rows = once.groupBy("part").applyInPandas(graded, "part long, grades binary").collect()
    grades = np.zeros((2 * parts, width), np.uint8)
    for row in rows:
        grades[row.part] = np.frombuffer(row.grades, np.uint8)
    return grades.reshape(2, 1 << bits)


def _cell(tokens: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (words.mixed(tokens, 20 + row) >> np.uint64(64 - bits)).astype(np.int64)


def _prefixes(s: np.ndarray, percent: int, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix tokens of a set under the first order, their grades, and those under the second order."""
    keep = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
    bits = int(grade.shape[1]).bit_length() - 1
    rare = np.minimum(grade[0][_cell(s, 0, bits)], grade[1][_cell(s, 1, bits)])
    first = np.lexsort((s, rare))[:keep]
    other = words.mixed(s, 5)
    # The second order has coarser grades, so that its hash decides more often.
    return s[first], rare[first], other[np.lexsort((other, rare >> np.uint8(3)))[:keep]]


def _postings(docs: DataFrame, size: int, percent: int, grades) -> DataFrame:
    """(key, token, class, n): a row for each prefix token of the first order, with the size of its set.

    ``key`` deals the rows out: it is the token, but a value of its own in each row of a token with very many hits, whose rows
    carry the size with a minus sign.
    """
    hot = int(8 * np.log2(1 + HOT_HITS))

    def run(batches):
        grade = grades.value
        for batch in batches:
            parts: list[tuple] = []
            with np.errstate(over="ignore"):
                for s in _sets(batch.column(0), size):
                    if not len(s):
                        continue
                    first, rare, _ = _prefixes(s, percent, grade)
                    name = _class(s)
                    often = rare >= hot
                    key = np.where(often, words.mixed(first, 6) + name.view(np.uint64), first)
                    n = np.where(often, -len(s), len(s))
                    parts.append((key, first, np.repeat(name, len(first)), n))
            if parts:
                columns = [pa.array(c.view(np.int64)) for c in map(np.concatenate, zip(*parts))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "token", "class", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, token long, class long, n long")


def _ties(postings: DataFrame, percent: int) -> DataFrame:
    """(src, dst, of_many): pairs of classes that share a token under the first order, or a class and a token of many."""
    columns = ["key", "token", "class", "n"]

    def tied(c: dict) -> pa.RecordBatch:
        """From whole groups of rows, sorted by key and class."""
        new = np.ones(len(c["key"]), bool)
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["class"][1:] != c["class"][:-1])
        c = {k: v[new] for k, v in c.items()}
        group = np.cumsum(np.concatenate(([0], c["key"][1:] != c["key"][:-1]))) if len(c["key"]) else np.zeros(0, np.int64)
        members = np.bincount(group)[group] if len(group) else group
        many = (members > MAX_POSTINGS) | (c["n"] < 0)
        src, dst = [c["class"][many]], [words.mixed(c["token"][many].view(np.uint64), 9).view(np.int64)]
        for d in range(1, min(MAX_POSTINGS, len(group))):
            i = np.flatnonzero((group[d:] == group[:-d]) & ~many[d:])
            if not len(i):
                break
            n, m = c["n"][i], c["n"][i + d]
            i = i[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            src.append(c["class"][i])
            dst.append(c["class"][i + d])
        ties = np.unique(np.column_stack((np.concatenate(src), np.concatenate(dst), np.arange(sum(map(len, src))) < len(src[0]))), axis=0)
        return pa.RecordBatch.from_arrays([*(pa.array(ties[:, k]) for k in (0, 1)), pa.array(ties[:, 2] == 1)], ["src", "dst", "of_many"])

    def run(batches):
        held = None
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = {c: batch.column(k).to_numpy() for k, c in enumerate(columns)}
                if held is not None:
                    now = {c: np.concatenate((held[c], now[c])) for c in columns}
                last = int(np.searchsorted(now["key"], now["key"][-1]))
                if len(now["key"]) - last > MAX_POSTINGS and len(np.unique(now["class"][last:])) > MAX_POSTINGS:
                    # A group of many is known as such: its rows need not wait, but for as many as mark it.
                    yield tied(now)
                    distinct = np.unique(now["class"][last:], return_index=True)[1][: MAX_POSTINGS + 1] + last
                    held = {c: v[distinct] for c, v in now.items()}
                    continue
                if last:
                    yield tied({c: v[:last] for c, v in now.items()})
                held = {c: v[last:] for c, v in now.items()}
            if held is not None:
                yield tied(held)

    return postings.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "src long, dst long, of_many boolean")


def _second(docs: DataFrame, size: int, percent: int, grades) -> DataFrame:
    """(class, second array<long>) of each text: its prefix tokens under the second order."""

    def run(batches):
        for batch in batches:
            names, tokens = [np.zeros(0, np.int64)], []
            with np.errstate(over="ignore"):
                for s in _sets(batch.column(0), size):
                    if len(s):
                        names.append(_class(s))
                        tokens.append(_prefixes(s, percent, grades.value)[2].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), lists], ["class", "second"])

    return docs.select("text").mapInArrow(run, "class long, second array<long>")


def _candidates(ties: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, grades) -> DataFrame:
    """(src, dst) of stored ``ties``: pairs that share a prefix token under the second order too, and ties to a token of many."""
    pairs = stored(ties.where("NOT of_many").select("src", "dst").distinct())
    asked = pairs.select(F.explode(F.array("src", "dst")).alias("class")).distinct().join(classes, "class").select(F.col("rep").alias("doc_id")).distinct()
    # A class has one of its rows here, and maybe another by a namesake.
    second = stored(_second(docs.join(broadcast_if_small(stored(asked), BROADCAST_ROWS), "doc_id"), size, percent, grades).dropDuplicates(["class"]))
    both = (
        pairs.join(second.withColumnsRenamed({"class": "src", "second": "x"}), "src")
        .join(second.withColumnsRenamed({"class": "dst", "second": "y"}), "dst")
        .where(F.arrays_overlap("x", "y"))
    )
    return both.select("src", "dst").union(ties.where("of_many").select("src", "dst"))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right."""
    sizes = np.array([len(s) for s in left + right], np.int64)
    n, at = len(left), np.repeat(np.arange(len(sizes)), sizes)
    tokens = np.concatenate([*left, *right])
    order = np.argsort(tokens, kind="stable")
    tokens, at = tokens[order], at[order]
    out = np.zeros((n, len(right)), np.float32)
    if not len(tokens):
        return out.astype(np.int64)
    column = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1])))
    # Only tokens of two or more sets count for an intersection.
    often = np.bincount(column)[column] > 1
    column, at = column[often], at[often]
    if not len(column):
        return out.astype(np.int64)
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    width = 4096
    for c in range(0, int(column[-1]) + 1, width):
        here = slice(*np.searchsorted(column, (c, c + width)))
        dense = np.zeros((len(sizes), width), np.float32)
        dense[at[here], column[here] - c] = 1
        out += dense[:n] @ dense[n:].T
    return out.astype(np.int64)


def _pieces(sets: list[np.ndarray]) -> Iterator[slice]:
    """Runs of sets that have up to twice the documents and shingles of a block, or of one set."""
    first = n = 0
    for k, s in enumerate(sets):
        if k > first and (k - first >= 2 * BLOCK_DOCS or n + len(s) > 2 * BLOCK_SHINGLES):
            yield slice(first, k)
            first, n = k, 0
        n += len(s)
    if len(sets) > first:
        yield slice(first, len(sets))


def _links_of(left: list[np.ndarray], right: list[np.ndarray], percent: int, grade: np.ndarray) -> list[tuple[int, int]]:
    """Links (places in left, in right) between two lists of sets, of the pairs that pass the filters under both orders."""
    prefixes = [[_prefixes(s, percent, grade) for s in side] for side in ((left,) if left is right else (left, right))]
    out = []
    for a in _pieces(left):
        for b in _pieces(right):
            found = _links_of_piece(left[a], right[b], [prefixes[0][a], prefixes[-1][b]], percent)
            out += [(a.start + i, b.start + j) for i, j in found]
    return out


def _links_of_piece(left: list[np.ndarray], right: list[np.ndarray], prefixes: list[list[tuple]], percent: int) -> list[tuple[int, int]]:
    n, m = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    pairs = 100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)
    for order in (0, 2):
        if pairs.any():
            pairs &= _common([p[order] for p in prefixes[0]], [p[order] for p in prefixes[1]]) > 0
    rows, columns = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
    if not len(rows):
        return []
    common = _common([left[k] for k in rows], [right[k] for k in columns])
    linked = pairs[np.ix_(rows, columns)] & (100 * common >= percent * (n[rows][:, None] + m[columns] - common))
    return [(int(rows[a]), int(columns[b])) for a, b in zip(*np.nonzero(linked))]


def _verified(tasks: DataFrame, size: int, percent: int, grades) -> DataFrame:
    """Links (src, dst) within tasks (family, i, j, text, side): all of side 0 against all of side 1, of side 2 among
    themselves; as many as connect the same classes."""

    def run(table: pa.Table) -> pa.Table:
        column = table.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        sides: tuple[dict, dict] = ({}, {})
        with np.errstate(over="ignore"):
            for side, s in zip(table.column("side").to_pylist(), _sets(column, size)):
                for to in (0, 1) if side == 2 else (side,):
                    if len(s):
                        sides[to].setdefault(int(_class(s)[0]), s)
            names = [list(side) for side in sides]
            left, right = (list(side.values()) for side in sides)
            found = _links_of(left, left if names[0] == names[1] else right, percent, grades.value) if all(names) else []
        ends = [(names[0][a], names[1][b]) for a, b in found if names[0][a] != names[1][b]]
        nodes, roots = forest(*(np.array([e[k] for e in ends], np.int64) for k in (0, 1)))
        return pa.table({"src": pa.array(nodes[nodes != roots]), "dst": pa.array(roots[nodes != roots])})

    return tasks.groupBy("family", "i", "j").applyInArrow(run, "src long, dst long")


def links(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, classes, links): signed (doc_id, text_key, n_shingles, class) for each row of ``docs`` (doc_id long, text string);
    classes (class, n_shingles, rep) of those with shingles, rep their smallest doc_id; links (src, dst) between classes, enough
    of them to connect all that similar pairs connect.

    Rows with a null doc_id are left out; null or empty texts have no shingles and no class in ``classes``.
    """
    with large_partitions(docs.sparkSession), shuffles_removed(docs.sparkSession):
        return _links(docs, size, percent)


def _links(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = stored(signatures(docs, size))
    classes = stored(signed.where("n_shingles > 0").groupBy("class", "n_shingles").agg(F.min("doc_id").alias("rep")))
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(24, max(12, int(total // TOKENS_PER_COUNTER).bit_length()))
    grades = docs.sparkSession.sparkContext.broadcast(_frequencies(docs.select("text"), size, bits))
    ties = stored(_ties(_postings(docs, size, percent, grades), percent))
    families = components(_candidates(ties, docs, classes, size, percent, grades))

    members = stored(families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(classes, "class"))
    shape = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("n")).where("m > 1")
    shape = shape.select("family", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(stored(shape), "family").select("family", "class", F.col("rep").alias("doc_id"), "n_shingles", "blocks", F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block"))
    members = stored(members)
    # One row's text for each class; rows of other classes that share its doc_id come along and only have links of their own.
    rows = docs.join(broadcast_if_small(members.select("doc_id", "family", "block").distinct(), BROADCAST_ROWS), "doc_id")
    within = rows.select("family", F.col("block").alias("i"), F.col("block").alias("j"), "text", F.lit(2).alias("side"))
    found = stored(_verified(within, size, percent, grades))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        found = found.union(_between_blocks(large, docs, found, size, percent, grades))
    return signed, classes, found


def _between_blocks(large: DataFrame, docs: DataFrame, found: DataFrame, size: int, percent: int, grades) -> DataFrame:
    """Links between blocks of families of several blocks, but for pairs of a family's largest class so far.

    A family of m documents sends each of them to at most about ``WIDE`` tasks a side, as long as m is under ``BLOCK_DOCS * WIDE**2``.
    """
    so_far = components(found).withColumnRenamed("node", "class")
    labelled = large.join(so_far, "class", "left").withColumn("component", F.coalesce("component", "class"))
    counts = labelled.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("family").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    # The open documents in blocks of their own, each against every block of the family; on both sides in wide blocks.
    wide = lambda n: F.least(n, F.greatest(F.lit(WIDE), F.ceil(n / WIDE))).cast("int")
    block, blocks = F.floor(F.col("block") * wide(F.col("blocks")) / F.col("blocks")).cast("int"), wide(F.col("blocks"))
    opened = labelled.join(main, "family").select("family", "doc_id", "n_shingles", block.alias("block"), blocks.alias("blocks"), (F.col("component") != F.col("main")).alias("open"))
    shape = opened.where("open").groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("n"))
    groups = shape.select("family", F.greatest(wide(F.ceil(F.col("m") / BLOCK_DOCS)), F.ceil(F.col("n") / (WIDE * BLOCK_SHINGLES))).cast("int").alias("groups"))
    placed = stored(opened.join(groups, "family").groupBy("family", "doc_id", "block").agg(F.max("blocks").alias("blocks"), F.max("groups").alias("groups"), F.max("open").alias("open")))
    rows = docs.join(broadcast_if_small(placed, BROADCAST_ROWS), "doc_id")
    group = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), "groups").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("family", upto("groups").alias("i"), F.col("block").alias("j"), "text", F.lit(1).alias("side"))
    left = rows.where("open").select("family", group.alias("i"), upto("blocks").alias("j"), "text", F.lit(0).alias("side"))
    return _verified(left.union(right), size, percent, grades)


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) for each row with a doc_id; ``component`` is null without shingles."""
    signed, classes, found = links(docs, size, percent)
    reached = components(found).withColumnRenamed("node", "class")
    linked = stored(classes.join(reached, "class"))
    least = stored(linked.groupBy("component").agg(F.min("rep").alias("least")))
    named = linked.join(least, "component").select("class", "component", "least")
    labels = classes.join(named, "class", "left").select("class", F.coalesce("component", "class").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    full = signed.where("n_shingles > 0").join(stored(labels), "class").select("doc_id", "text_key", "n_shingles", "component", "component_id")
    bare = signed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return full.union(bare)


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of distinct ``size``-word
    shingles (A-Z folded; with fewer words the whole sequence). ``component_id`` is the smallest doc_id that links
    reach. Null, empty and blank texts have 0 shingles and no link. Rows with a null doc_id come back with their
    0 shingles and a null component; repeated rows come back as often as they came, and rows that share a doc_id but not a
    text each have the component of their own text. An empty table gives none.
    """
    with shuffles_removed(docs.sparkSession):
        out = _components(docs, size, percent).select("doc_id", "n_shingles", "component_id")
    nameless = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return out.union(nameless)


def one_of_each(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id (of several texts under that id, of one of them).

    Rows without a doc_id and rows without words stay; of equal rows (doc_id and text) one stays.
    """
    with shuffles_removed(docs.sparkSession):
        found = stored(_components(docs.select("doc_id", "text"), size, percent))
        pair = F.struct("doc_id", "text_key")
        first = stored(found.where("component IS NOT NULL").groupBy("component").agg(F.min(pair).alias("first")))
        apart = found.join(first, "component").where(pair != F.col("first"))
        # Only the rows that go are looked up, so that texts need no shuffle unless these are many.
        gone = stored(apart.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
        again = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().where("count > 1")
        again = stored(again.select("_id", "_key").join(gone, ["_id", "_key"], "left_anti"))
    own = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    kept = docs.join(broadcast_if_small(gone, BROADCAST_ROWS), own, "left_anti")
    if again.isEmpty():
        return kept
    repeated = broadcast_if_small(again, BROADCAST_ROWS)
    return kept.join(repeated, own, "left_anti").union(kept.join(repeated, own, "left_semi").dropDuplicates(["doc_id", "text"]))
