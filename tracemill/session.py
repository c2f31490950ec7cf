"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = 8, app: str = "tracemill", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="tracemill-checkpoint-")
    context.setCheckpointDir(configured)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """While this holds, the session has these settings; after it, those of before."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """While this holds, the shuffle files of a job go when it ends, not when the driver happens to collect its garbage.

    For steps that store what is read again: otherwise the shuffles of all steps lie on the disks together. A table that is
    read twice without being stored is computed twice.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


_scopes: list[list[str]] = []


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new path under the checkpoint folder, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names; one that is not there is fine."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch folders made within are deleted when it ends well; after an error they stay, for a look at them."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
    for path in scope:
        delete_folder(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Used for fitted artefacts (vocabularies, template tables, model tables) and between rounds of
    iterative jobs: later uses read files that outlive a lost executor.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the checkpoint folder and return the table.

    For line-level tables that several passes read: columns are pruned and repeated strings are stored once
    per file, which a row checkpoint does not do.
    """
    path = scratch_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Values that are sent to all tasks have at most so many bytes, whatever the number of rows.
BROADCAST_BYTES = 256 << 20


def _bytes(column: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reads at most ``max_rows + 1`` rows."""
    size = sum((_bytes(f"`{f.name}`", f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    # A limit brings the rows of all tasks together: sizes alone, no values.
    sizes = df.select(size.alias("bytes")).limit(max_rows + 1)
    seen = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return seen.n <= max_rows and seen.bytes <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after seeing that ``df`` has at most ``max_rows`` rows, and ``BROADCAST_BYTES`` bytes.

    Call it on stored or materialised tables. Beyond the limits the hint is left off and the join becomes a shuffle join,
    whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application.

    Functions that run in tasks are pickled by reference, so workers must be able to import the package. Where it is
    installed on every machine (or passed with --py-files) the copy sent here is the same code.
    """
    context = spark.sparkContext
    if getattr(context, "_tracemill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tracemill-package-")
    archive = shutil.make_archive(os.path.join(folder, "tracemill"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._tracemill_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer tasks than the cluster has cores, before costly work per row.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
