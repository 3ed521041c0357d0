"""Incremental forms of the refresh as Structured Streaming jobs that take what is new and stop.

Each takes a ``Budget``: how much a micro-batch may hold, and when to stop. A stream stops between micro-batches; the
next run with the same checkpoint goes on from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from .. import schemas
from ..operators import catalogue
from ..plans import listed
from ..plans.store import Store
from ..sources import feeds
from ..sources.listings import changed_ids, export_rows, export_schema


@dataclass(frozen=True)
class Budget:
    """0 is no limit. ``max_files`` and ``max_bytes`` bound a micro-batch of files (one file at least), ``max_batches``
    and ``max_minutes`` a run: it takes no new micro-batch after so many, or once the time is over."""

    max_files: int = 0
    max_bytes: int = 0
    max_batches: int = 0
    max_minutes: float = 0

    def bound(self, reader: DataStreamReader) -> DataStreamReader:
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        return reader.option("maxBytesPerTrigger", self.max_bytes) if self.max_bytes else reader


ALL = Budget()


class _Spent(RuntimeError):
    """The run's budget; the micro-batch that meets it was not begun."""


def _drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, budget: Budget = ALL) -> int:
    """Micro-batches of what is there, each given to ``each``; the number of them that ran."""
    until, ran = time.monotonic() + budget.max_minutes * 60, []

    def within(batch: DataFrame, number: int) -> None:
        if (budget.max_batches and len(ran) >= budget.max_batches) or (budget.max_minutes and ran and time.monotonic() >= until):
            raise _Spent(f"stopped before micro-batch {number}")
        each(batch, number)
        ran.append(number)

    query = stream.writeStream.foreachBatch(within).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _Spent.__name__ not in str(e):
            raise
    return len(ran)


def follow_changes(store: Store, folder: str, media_type: str, checkpoint: str, budget: Budget = ALL) -> int:
    """Change files that weren't seen yet requeue their titles. Requeueing twice is requeueing once, so a batch that
    is run again after a failure does no harm."""
    pages = budget.bound(store.spark.readStream.schema(schemas.CHANGES).option("multiLine", True)).json(folder)

    def each(batch: DataFrame, _: int) -> None:
        store.change("titles", schemas.TITLES, lambda t: catalogue.requeue(t, changed_ids(batch, media_type)))

    return _drain(pages, each, checkpoint, budget)


def follow_change_feed(store: Store, folder: str, since: str, checkpoint: str) -> int:
    """Windows of changes of both kinds that came since the checkpoint's days requeue their titles; see
    ``feeds.ChangeFeed``. A run without new windows changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        store.change("titles", schemas.TITLES, lambda t: catalogue.requeue(t, batch.select("media_type", "tmdb_id")))

    return _drain(feeds.change_stream(store.spark, folder, since), each, checkpoint)


def follow_exports(store: Store, folder: str, media_type: str, checkpoint: str, budget: Budget = ALL) -> int:
    """Export files that weren't seen yet are seeded; a malformed line or a missing id fails. Seeding twice is seeding
    once."""
    lines = budget.bound(store.spark.readStream.schema(export_schema(media_type)).option("mode", "FAILFAST")).json(folder)

    def each(batch: DataFrame, _: int) -> None:
        store.change("titles", schemas.TITLES, lambda t: catalogue.seed(t, export_rows(batch, media_type)))

    return _drain(lines, each, checkpoint, budget)


def follow_results(store: Store, folder: str, checkpoint: str, budget: Budget = ALL) -> int:
    """Result files that weren't seen yet are saved, one write a batch; of several for a title the last by time counts.

    An error adds an attempt, so a batch must not be saved twice: its number is published with its rows, and a batch
    that is run again after a failure is left out.
    """
    schema = schemas.TITLES
    results = budget.bound(store.spark.readStream.schema(schema)).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        if number > store.last_batch("titles", checkpoint):
            store.change("titles", schema, lambda t: catalogue.save(t, batch.withColumn("ordinal", F.col("updated_at"))), checkpoint, number)

    return _drain(results, each, checkpoint, budget)


def follow_colours(store: Store, folder: str, checkpoint: str, send: listed.Send, most: int = 80_000, budget: Budget = ALL) -> list[listed.Sent]:
    """Result files of the second pipeline that weren't seen yet are saved, and what the target lacks is sent after each
    batch, at least once; what it refuses stays for the next."""
    schema, out = schemas.TVDB_TITLES, []
    results = budget.bound(store.spark.readStream.schema(schema)).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        if number > store.last_batch(listed.TABLE, checkpoint):
            store.change(listed.TABLE, schema, lambda t: catalogue.save_b(t, batch.withColumn("ordinal", F.col("updated_at"))), checkpoint, number)
        out.append(listed.export(store, send, most))

    _drain(results, each, checkpoint, budget)
    return out


def first_requests(requests: DataFrame, delay: str, at: str = "at") -> DataFrame:
    """Of a stream's requests to colour a pair (pair, ``at``, ...) the first of each, for all those that repeat it within
    ``delay``: the palette of a pair that is asked for by many titles at once is computed once.

    The state holds a pair until the watermark, ``delay`` behind the latest request, is past its first request and the
    delay; so it is bounded by what comes in two delays, and a pair that is asked for again later is computed again.
    Requests behind the watermark are left out.
    """
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(["pair"])


def follow_requests(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str, budget: Budget = ALL) -> None:
    """``first_requests`` of request files (pair, at) that weren't seen yet, as Parquet files below ``out``, each once."""
    requests = budget.bound(spark.readStream.schema("pair string, at timestamp")).parquet(folder)
    query = first_requests(requests, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow_payloads(spark: SparkSession, files: str, checkpoint: str, acknowledge: str, sender: str = "tintlake.sources.feeds:folder_target", budget: Budget = ALL, **options: str) -> DataFrame:
    """Payload files (batch, items) that weren't seen yet go to a target from the tasks that read them; the batches that
    arrived so far. See ``feeds.ExportTarget``."""
    spark.dataSource.register(feeds.ExportTarget)
    payloads = budget.bound(spark.readStream.schema("batch long, items string")).parquet(files)
    writer = payloads.writeStream.format("export_target").options(sender=sender, acknowledge=acknowledge, job="stream", **options)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return feeds.acknowledged(spark, acknowledge)
