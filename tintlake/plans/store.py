"""Snapshots of tables: each change writes a new version, and an entry in the log makes it the current one.

A version is written whole before its entry, so readers never see half of it, and nothing that is being read is
overwritten. Entries are files named by version that are created only if they aren't there, so of two writers that
start from one version the second is told instead of undoing the first. All goes through Spark's readers and Hadoop's
file systems, so the folder can be in any store that creates files exclusively.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalogue import conform

_LOG = "version BIGINT, path STRING, source STRING, batch BIGINT"


class Conflict(RuntimeError):
    """Another writer has published a version since the one that a change was made from."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.folder}/{table}/log")
        except Exception as e:  # noqa: BLE001  a table without a version
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def current(self, table: str) -> tuple[int, str | None]:
        row = self._log(table).agg(F.max(F.struct("version", "path")).alias("m")).first().m
        return (row.version, row.path) if row else (0, None)

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The current version; columns that it was written without are null."""
        return self._at(self.current(table)[1], schema)

    def _at(self, path: str | None, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema) if path is None else conform(self.spark.read.parquet(path), schema)

    def write(self, table: str, df: DataFrame, after: int | None = None, source: str | None = None, batch: int | None = None) -> int:
        """Publishes ``df`` as the version that follows ``after`` (the current one); Conflict if that exists already.
        source and batch: what stream's batch is in it, see ``last_batch``."""
        version = (self.current(table)[0] if after is None else after) + 1
        path = f"{self.folder}/{table}/v{version}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        entry = json.dumps({"version": version, "path": path, "source": source, "batch": batch})
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/log/{version:012d}.json")
        try:
            out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} of {table} is another writer's") from e
            raise
        out.write(bytearray(entry + "\n", "utf-8"))
        out.close()
        return version

    def change(self, table: str, schema: T.StructType, f: Callable[[DataFrame], DataFrame], source: str | None = None, batch: int | None = None) -> int:
        """Publishes ``f`` of the current version as the next one."""
        version, path = self.current(table)
        return self.write(table, f(self._at(path, schema)), version, source, batch)

    def last_batch(self, table: str, source: str) -> int:
        """The last batch of a stream that is in the table; -1 if none is. It is published with the rows, so a batch
        that is run again after a failure is known."""
        row = self._log(table).where(F.col("source") == source).agg(F.max("batch").alias("b")).first()
        return -1 if row.b is None else row.b

    def compact(self, table: str, files: int = 1) -> int:
        """The current version in fewer files."""
        version, path = self.current(table)
        if path is None:
            return 0
        return self.write(table, self.spark.read.parquet(path).coalesce(files), version)
