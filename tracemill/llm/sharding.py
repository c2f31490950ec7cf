"""Extendible hashing of documents into shards of limited size, in DataFrame functions alone.

A document's key is the first 60 bits of an md5. The directory starts with one bucket of all keys; a bucket whose
documents have more bytes than the limit splits on the next bit, the others stay, so shards differ in depth. The
directory is found from byte counts of fine hash cells (one pass over the documents), each summed into the buckets of
all depths above it. Cells that are too large even so are counted again, they alone, down to the last bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import broadcast_if_small, stored

LIMIT_BYTES = 16 << 20
KEY_BITS = 60
# Cells are so many bits finer than shards of the limit would be on average.
SPARE_BITS = 8
BROADCAST_ROWS = 200_000


def _key() -> Column:
    """60 bits of md5 of id and text, so that rows which share an id part as well."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _prefix(key: Column, bits: int | Column, depth: int | Column) -> Column:
    """The first ``depth`` of ``bits`` bits."""
    return F.call_function("shiftrightunsigned", key, (F.lit(bits) - F.lit(depth)).cast("int"))


def _split(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(cell, depth, bucket, shard_bytes, shard_docs, fits): the bucket of each cell of ``last`` bits.

    The bucket is the shallowest one, from depth ``first`` on, that fits; a single document fits anywhere. Cells that
    fit at no depth are given at depth ``last`` with ``fits`` false.
    """
    deep = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("bucket", _prefix(F.col("cell"), last, F.col("depth")))
    sums = deep.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    sums = sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = deep.select("cell", "depth", "bucket").join(sums.where(F.col("fits") | (F.col("depth") == last)), ["depth", "bucket"])
    picked = found.groupBy("cell").agg(F.min_by(F.struct("depth", "bucket", "shard_bytes", "shard_docs", "fits"), "depth").alias("s"))
    return picked.select("cell", "s.*")


def sharded(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_bytes, shard, shard_depth, shard_bytes and shard_docs.

    ``shard`` is the bucket's bits as a string ('' for all), with ``+k`` after the 60 bits for the k-th further shard of rows that
    agree in all of them. Every shard has at most ``limit`` text bytes, but for one that a single longer document fills.
    Null texts have 0 bytes; a null doc_id counts as an empty one; repeated rows share a bucket until that overflows.
    Columns with the names made here are replaced. An empty table gives no rows.
    """
    made = ("n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept).withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "_key": _key()})
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(KEY_BITS, max(1, -(-total // limit)).bit_length() + SPARE_BITS)
    counted = rows.groupBy(_prefix(F.col("_key"), KEY_BITS, bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    directory = stored(_split(stored(counted), 0, bits, limit))
    rows = rows.withColumn("_cell", _prefix(F.col("_key"), KEY_BITS, bits))
    placed = rows.join(broadcast_if_small(directory.withColumnRenamed("cell", "_cell"), BROADCAST_ROWS), "_cell")
    parts = [placed.where("fits").withColumn("_part", F.lit(0).cast("long"))]
    if bits < KEY_BITS and directory.where("NOT fits").limit(1).count():
        over = placed.where("NOT fits").drop("depth", "bucket", "shard_bytes", "shard_docs", "fits", "_cell")
        cells = over.groupBy(F.col("_key").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        deeper = stored(_split(cells, bits + 1, KEY_BITS, limit))
        placed = over.join(deeper.withColumnRenamed("cell", "_key"), "_key").withColumn("_cell", F.lit(None).cast("long"))
        parts.append(placed.where("fits").withColumn("_part", F.lit(0).cast("long")).select(*parts[0].columns))
    if directory.where("NOT fits").limit(1).count():
        # Rows alike in all 60 bits: alike in id and text. So many of them as fit go to one shard.
        alike = placed.where("NOT fits")
        room = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
        number = F.row_number().over(Window.partitionBy("_key").orderBy("n_bytes")) - 1
        alike = alike.withColumn("_part", F.floor(number / room))
        own = Window.partitionBy("_key", "_part")
        alike = alike.withColumns({"shard_bytes": F.sum("n_bytes").over(own), "shard_docs": F.count(F.lit(1)).over(own)})
        parts.append(alike.select(*parts[0].columns))
    label = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("bucket"), F.col("depth").cast("int"), F.lit("0")))
    shard = F.concat(label, F.when(F.col("_part") > 0, F.concat(F.lit("+"), F.col("_part").cast("string"))).otherwise(F.lit("")))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*kept, "n_bytes", shard.alias("shard"), F.col("depth").cast("int").alias("shard_depth"), "shard_bytes", "shard_docs")
