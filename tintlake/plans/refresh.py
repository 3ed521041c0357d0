"""The batch refresh: prune, seed, sync and process, each reading and writing snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pair_key
from ..operators import catalogue, ranking, search
from ..schemas import MEDIA, ROLES, STATE, TITLES
from ..sources import listings
from .counters import counted
from .store import Store

#: (pair, poster_path, logo_path) -> (pair, six roles[, error]); pairs without a poster file are left out, those whose
#: file can't be used have an error.
Colours = Callable[[DataFrame], DataFrame]


def seed(store: Store, folder: str, today: date, size: int = 0, include_adult: bool = False) -> dict[str, int]:
    """Exports that aren't loaded yet into the catalogue; of the first ``size`` ranks, if given."""
    spark, state, loaded = store.spark, store.read("state", STATE), []
    for media in MEDIA:
        if catalogue.get_state(state, f"seed:{media}") == today.isoformat():
            continue
        loaded.append((media, listings.read_export(spark, listings.locate_export(spark, folder, media, today), media)))
    if not loaded:
        return {}
    rows = loaded[0][1]
    for _, more in loaded[1:]:
        rows = rows.unionByName(more)
    if size:
        rows = catalogue.keep_top(rows, size, include_adult)
    counts = {r.media_type: r.n for r in rows.groupBy("media_type").agg(F.count("*").alias("n")).collect()}
    store.change("titles", TITLES, lambda t: catalogue.seed(t, rows))
    for media, _ in loaded:
        state = catalogue.set_state(state, f"seed:{media}", today.isoformat())
    store.write("state", state)
    return counts


def sync(store: Store, folder: str, today: date) -> dict[str, int]:
    """Change files (changes_{media}_{start}_{end}*.json) since the cursor requeue their titles; counts of ids."""
    spark, state, counts = store.spark, store.read("state", STATE), {}
    for media in MEDIA:
        start = catalogue.get_state(state, f"changes:{media}") or (today - timedelta(days=1)).isoformat()
        ids = None
        for a, b in listings.change_windows(start, today):
            page = listings.read_changes(spark, f"{folder}/changes_{media}_{a}_{b}*.json", media)
            ids = page if ids is None else ids.unionByName(page)
        counts[media] = 0
        if ids is not None:
            ids = ids.distinct()
            counts[media] = ids.count()
            store.change("titles", TITLES, lambda t: catalogue.requeue(t, ids))
        state = catalogue.set_state(state, f"changes:{media}", today.isoformat())
    store.write("state", state)
    return counts


def with_error(found: DataFrame) -> DataFrame:
    """What ``Colours`` gave, with an error column in any case; who has an error has no colours."""
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    return found.select("pair", error.alias("error"), *[F.when(error.isNull(), F.col(r)).alias(r) for r in ROLES])


def outcomes(queue: DataFrame, details: DataFrame, colours: Colours, cache: DataFrame) -> DataFrame:
    """Results of a queue: each distinct pair of poster and logo is coloured once, and those in the cache not at all.
    A pair that can't be coloured is an error of its titles, which are tried again."""
    found = details.withColumn("_found", F.lit(True))
    x = queue.select("media_type", "tmdb_id").join(found, ["media_type", "tmdb_id"], "left").withColumn("pair", pair_key(F.col("poster_path"), F.col("logo_path")))
    todo = x.where("pair IS NOT NULL").select("pair", "poster_path", "logo_path").distinct().join(cache, "pair", "left_anti")
    new = with_error(colours(todo))
    known = new.select("pair", "error", *[F.col(r).alias(f"{r}_hex") for r in ROLES]).unionByName(cache.withColumn("error", F.lit(None).cast("string")))
    x = x.join(known, "pair", "left")
    failed = F.col("_found").isNotNull() & F.col("error").isNotNull()
    status = F.when(F.col("_found").isNull(), "not_found").when(failed, "error").when(F.col("pair").isNull() | F.col("base_hex").isNull(), "no_poster").otherwise("done")
    triple = {"primary": ("identity1_hex", 0.275), "secondary": ("base_hex", 0.45), "tertiary": ("accent_hex", 0.055)}
    swatches = [c for s, (h, w) in triple.items() for c in (F.col(h).alias(f"{s}_hex"), F.when(F.col(h).isNotNull(), F.lit(w)).alias(f"{s}_ratio"))]
    details_of = [F.when(~failed, F.col(c)).alias(c) for c in ("title", "adult", "poster_path", "logo_path")]  # an error tells nothing else
    return x.select("media_type", "tmdb_id", *details_of, status.alias("status"), F.when(failed, F.col("error")).alias("error"), *[f"{r}_hex" for r in ROLES], *swatches)


def process(store: Store, details: DataFrame, colours: Colours, top: int = 0, limit: int = 0, include_adult: bool = False, include_errors: bool = True, max_minutes: float = 0, step: int = 10_000) -> dict[str, int]:
    """Colours of the queue; counts by status. With ``max_minutes`` it works by ``step`` titles and stops after the step
    in which the time runs out; the next run goes on from there."""
    counts: dict[str, int] = {}
    until, left = time.monotonic() + max_minutes * 60, limit
    while True:
        most = min(x for x in (left or step, step) if x) if max_minutes else left
        version, _ = store.current("titles")
        titles = store.read("titles", TITLES)
        queue = ranking.work_queue(titles, top, most, include_errors, include_adult)
        found, counts_of = counted(outcomes(queue, details, colours, catalogue.palette_cache(titles)))
        store.write("results", found)  # once: the counts come with the write, the table from what was written
        now = counts_of()
        store.write("titles", catalogue.save(titles, store.spark.read.parquet(store.current("results")[1])), version)
        for k, n in now.items():
            counts[k] = counts.get(k, 0) + n
        left -= sum(now.values()) if limit else 0
        if not max_minutes or not sum(now.values()) or (limit and left <= 0) or time.monotonic() >= until:
            return counts


def prune(store: Store, size: int, include_adult: bool = False) -> int:
    """Deletes what is beyond ``size`` ranks and not done; the number of rows."""
    before = store.read("titles", TITLES).count()
    store.change("titles", TITLES, lambda t: catalogue.prune(t, size, include_adult))
    gone = before - store.read("titles", TITLES).count()
    if before and gone > before / 5:
        store.compact("titles", max(1, store.read("titles", TITLES).rdd.getNumPartitions() // 2))
    return gone


def run(store: Store, folder: str, details: DataFrame, colours: Colours, today: date, size: int = 0, top: int = 0, include_adult: bool = False, **how) -> dict:
    out: dict = {}
    if size:
        out["pruned"] = prune(store, size, include_adult)
    out["seeded"] = seed(store, folder, today, size, include_adult)
    out["changed"] = sync(store, folder, today)
    out["processed"] = process(store, details, colours, top, include_adult=include_adult, **how)
    out["stats"] = {r.media_type: r.counts for r in search.stats(store.read("titles", TITLES)).collect()}
    return out
