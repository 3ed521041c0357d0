"""The catalogue as it is served: in directories of ids, so that a read opens, and a change rewrites, those it needs.

A directory holds one kind's ids of a span, sorted, with a Bloom filter on the id. Reads by key and by page name their
directories, so Spark prunes all others before it lists a file. A change reads the directories that its rows fall into
and puts them back by dynamic overwrite; files elsewhere stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search
from ..schemas import TITLES
from .cut import materialise, scratch, shuffles_deleted


class Served:
    def __init__(self, spark: SparkSession, folder: str, span: int = 50_000, schema: T.StructType = TITLES):
        self.spark, self.folder, self.span, self.schema = spark, folder, span, schema

    def _shard(self, tmdb_id: Column) -> Column:
        return F.floor(tmdb_id / self.span).cast("long")

    def _write(self, rows: DataFrame) -> None:
        x = rows.withColumn("shard", self._shard(F.col("tmdb_id"))).repartition("media_type", "shard").sortWithinPartitions("media_type", "shard", "tmdb_id")
        out = x.write.mode("overwrite").partitionBy("media_type", "shard").option("partitionOverwriteMode", "dynamic")
        # a filter for the ids that a directory can have; without their number it takes a megabyte of each file
        out = out.option("parquet.bloom.filter.enabled#tmdb_id", "true").option("parquet.bloom.filter.expected.ndv#tmdb_id", str(self.span))
        with shuffles_deleted(self.spark):
            out.parquet(self.folder)

    def read(self) -> DataFrame:
        """All rows, with their shard."""
        schema = T.StructType([*[f for f in self.schema.fields if f.name != "media_type"], self.schema["media_type"], T.StructField("shard", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def publish(self, titles: DataFrame) -> None:
        """Writes all titles anew; directories that have none any more are left, so use a new folder for another table."""
        self._write(titles.select(*self.schema.names))

    def get(self, media_type: str, tmdb_id: int) -> DataFrame:
        rows = self.read().where(F.col("shard") == tmdb_id // self.span)
        return search.get(rows, media_type, tmdb_id).select(*self.schema.names)

    def page(self, media_type: str, after: int = 0, limit: int = 100, since: str | None = None) -> DataFrame:
        """As ``search.page``; directories that end before ``after`` aren't read."""
        rows = self.read().where(F.col("shard") >= (after + 1) // self.span)
        return search.page(rows, media_type, after, limit, since).select(*self.schema.names)

    def change(self, incoming: DataFrame, f: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the titles of the directories that ``incoming`` (media_type, tmdb_id, ...) falls into by ``f`` of them
        and incoming; how many directories that were. ``f`` may add keys of incoming only."""
        with scratch():
            incoming = materialise(incoming, "served-incoming", tidy=True)
            # a row per directory: the number of ids over the span
            touched: dict[str, list[int]] = {}
            for r in incoming.select("media_type", self._shard(F.col("tmdb_id")).alias("shard")).distinct().collect():
                touched.setdefault(r.media_type, []).append(r.shard)
            if not touched:
                return 0
            here = F.lit(False)
            for media_type, shards in touched.items():
                here = here | ((F.col("media_type") == media_type) & F.col("shard").isin(shards))
            old = self.read().where(here).select(*self.schema.names)
            self._write(materialise(f(old, incoming).select(*self.schema.names), "served-changed", tidy=True))
        return sum(map(len, touched.values()))
