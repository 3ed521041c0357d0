"""The second pipeline: complete listings, colours of what they list, and export of what the target lacks."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pair_key
from ..operators import catalogue, ranking, search
from ..schemas import KINDS, ROLES, TVDB_TITLES
from ..sources import feeds
from .counters import counted
from .cut import materialise, new_folder, scratch
from .refresh import Colours, with_error
from .store import Store

TABLE = "tvdb_titles"
Send = feeds.Send


@dataclass
class Sent:
    sent: int
    remaining: int
    refused: str | None = None


def seed(store: Store, listing: DataFrame) -> dict[str, dict[str, int]]:
    """A complete listing (kind, tvdb_id, title, score, image[, ordinal]) of one kind or both: what it has is upserted,
    what it lacks of its kinds is not_found; of a title that is listed again the last row counts. Counts by kind: titles
    listed, and titles that are gone."""
    with scratch():
        return _seed(store, listing)


def _seed(store: Store, listing: DataFrame) -> dict[str, dict[str, int]]:
    version, _ = store.current(TABLE)
    before = store.read(TABLE, TVDB_TITLES)
    generation = catalogue.next_generation(before, KINDS).select("kind", F.col("generation").alias("seen"))
    # read once: counts, upsert and sweep speak of the same rows
    listing = materialise(catalogue.last_of_each(listing, catalogue.KEY_B).drop("ordinal").join(generation, "kind"), "listing")
    counts = {r.kind: {"listed": r.n, "gone": 0} for r in listing.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    seeded = catalogue.seed_b(before, listing)
    missing = lambda t: {r.kind: r["count"] for r in t.where("status = 'not_found'").groupBy("kind").count().collect()}
    still = missing(seeded)
    store.write(TABLE, catalogue.sweep(seeded, listing), version)
    for kind, n in missing(store.read(TABLE, TVDB_TITLES)).items():
        if kind in counts:
            counts[kind]["gone"] = n - still.get(kind, 0)
    return {k: counts.get(k, {"listed": 0, "gone": 0}) for k in KINDS}


def outcomes(queue: DataFrame, logos: DataFrame, colours: Colours) -> DataFrame:
    """Results of a queue (kind, tvdb_id, image): a title without an image, or whose image's file is gone, has no
    poster. Each pair of poster and logo is coloured once; one that can't be is an error of its titles, which are tried
    again and not sent. logos: (kind, tvdb_id, logo)."""
    x = queue.select("kind", "tvdb_id", F.nullif("image", F.lit("")).alias("image")).join(logos.select("kind", "tvdb_id", "logo"), ["kind", "tvdb_id"], "left")
    x = x.withColumn("pair", pair_key(F.col("image"), F.col("logo")))
    found = colours(x.where("pair IS NOT NULL").select("pair", F.col("image").alias("poster_path"), F.col("logo").alias("logo_path")).distinct())
    x = x.join(with_error(found), "pair", "left")
    done, failed = F.col("base").isNotNull(), F.col("error").isNotNull()
    return x.select("kind", "tvdb_id", F.when(done, F.col("logo")).alias("logo"), F.when(failed, "error").when(done, "done").otherwise("no_poster").alias("status"), "error", *ROLES)


def process(store: Store, logos: DataFrame, colours: Colours, limit: int = 0, max_minutes: float = 0, step: int = 10_000) -> dict[str, int]:
    """Colours of the queue, at most ``limit`` titles (0: all); counts by status. With ``max_minutes`` it works by
    ``step`` titles and stops after the step in which the time runs out; the next run goes on from there."""
    counts: dict[str, int] = {}
    until, left = time.monotonic() + max_minutes * 60, limit
    while True:
        most = min(x for x in (left or step, step) if x) if max_minutes else left
        version, _ = store.current(TABLE)
        queue = ranking.work_queue_b(store.read(TABLE, TVDB_TITLES), most)
        found, counts_of = counted(outcomes(queue, logos, colours))
        store.write("tvdb_results", found)  # once: the counts come with the write, the table from what was written
        now = counts_of()
        store.write(TABLE, catalogue.save_b(store.read(TABLE, TVDB_TITLES), store.spark.read.parquet(store.current("tvdb_results")[1])), version)
        for k, n in now.items():
            counts[k] = counts.get(k, 0) + n
        left -= sum(now.values()) if limit else 0
        if not max_minutes or not sum(now.values()) or (limit and left <= 0) or time.monotonic() >= until:
            return counts


def export(store: Store, send: Send, most: int = 80_000, size: int = 500) -> Sent:
    """What the target lacks, best first, batch by batch. What was accepted is acknowledged even if a later batch is
    refused; then it stops there. A batch may arrive twice if the driver is lost before the acknowledgement."""
    version, _ = store.current(TABLE)
    table = store.read(TABLE, TVDB_TITLES)
    with scratch():
        batches = materialise(catalogue.export_batches(table, most, size), "export")
        accepted, refused = 0, None
        # at most most / size rows, each of ``size`` titles
        for r in catalogue.payloads(batches).orderBy("batch").toLocalIterator():
            try:
                send(f"{version}-{r.batch:06d}", r["items"])
            except Exception as e:  # noqa: BLE001  whatever the target says
                refused = str(e)[:500]
                break
            accepted += 1
        return _acknowledged(store, table, version, batches.where(F.col("batch") < accepted), refused)


def _acknowledged(store: Store, table: DataFrame, version: int, sent: DataFrame, refused: str | None) -> Sent:
    """Publishes what arrived, if anything did."""
    n = sent.count()
    if n:
        store.write(TABLE, catalogue.acknowledge(table, sent), version)
    return Sent(n, store.read(TABLE, TVDB_TITLES).where("dirty = 1").count(), refused)


def export_from_tasks(store: Store, most: int = 80_000, size: int = 500, tasks: int = 16, **how: str) -> Sent:
    """As ``export``, but batches go to the target from up to ``tasks`` tasks at once and never through the driver, which
    hears only which of them arrived. A refusal stops the task that met it, not the others; what arrived is
    acknowledged, the rest stays dirty. ``how``: options of ``feeds.ExportTarget``, with the sender."""
    version, _ = store.current(TABLE)
    table = store.read(TABLE, TVDB_TITLES)
    with scratch():
        batches = materialise(catalogue.export_batches(table, most, size), "export")
        rows = catalogue.payloads(batches).repartitionByRange(tasks, "batch").sortWithinPartitions("batch")
        arrived = feeds.send_batches(rows, new_folder(store.spark, "export-acknowledged"), job=f"{version}", **how).select("batch")
        sent = batches.join(F.broadcast(arrived), "batch", "left_semi")  # at most most / size numbers
        left = batches.select("batch").distinct().count() - arrived.count()
        return _acknowledged(store, table, version, sent, f"{left} batches did not arrive" if left else None)


def to_folder(folder: str) -> Send:
    """Each batch as a file named by the version that it comes from, so one that is sent twice is there once."""
    return feeds.folder_target({"folder": folder})


def run(store: Store, listing: DataFrame, logos: DataFrame, colours: Colours, send: Send, limit: int = 0, max_minutes: float = 0, most: int = 80_000) -> dict:
    out: dict = {"seed": seed(store, listing), "process": process(store, logos, colours, limit, max_minutes)}
    out["export"] = vars(export(store, send, most))
    return out | {"stats": stats(store)}


def stats(store: Store) -> dict:
    x = store.read(TABLE, TVDB_TITLES)
    counts = {r.kind: r.counts for r in search.stats(x, "kind", KINDS).collect()}
    return counts | {"unsent": x.where("dirty = 1").count()}
