"""Finished stages of a run, so that one that broke off goes on where it was."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import delete_folder
from tracemill.sources import tables


def fingerprint(spark: SparkSession, config: Mapping[str, Any], inputs: Sequence[str]) -> str:
    """A digest of a configuration and of the paths, sizes and times of the files it reads; their contents are not read."""
    seen = []
    for path in inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(38,0)")).alias("h"), F.sum("length").alias("bytes")).first()
        seen.append([path, row.n, str(row.h), row.bytes])
    text = json.dumps([config, seen], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class Stages:
    """Tables of finished stages in ``folder``, each with a manifest that is written after it.

    A table counts as finished if its manifest names the run's fingerprint, so a table that was cut off, or that belongs to
    another configuration or other input files, is made again.
    """

    def __init__(self, spark: SparkSession, folder: str, mark: str) -> None:
        self.spark, self.folder, self.mark = spark, folder, mark
        self.reused: list[str] = []

    def _finished(self, name: str) -> bool:
        try:
            row = self.spark.read.schema("fingerprint string").json(f"{self.folder}/{name}.manifest").first()
        except Exception as missing:  # noqa: BLE001 - only an absent manifest is acceptable
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return False
        return row is not None and row.fingerprint == self.mark

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table ``name``; ``make`` is called only if it is not finished yet."""
        path = f"{self.folder}/{name}"
        if self._finished(name):
            self.reused.append(name)
            return self.spark.read.parquet(path)
        delete_folder(self.spark, f"{path}.manifest")
        made = tables.write_table(make(), path)
        self.spark.createDataFrame([(self.mark,)], "fingerprint string").write.json(f"{path}.manifest")
        return made

    def clear(self) -> None:
        delete_folder(self.spark, self.folder)
