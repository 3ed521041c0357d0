"""Command line of both pipelines: python -m tintlake.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import thumbnail_url
from .operators import clusters, pixels, roles, search
from .plans import listed, refresh, report
from .plans.cut import materialise
from .plans.store import Store
from .schemas import KINDS, ROLES, TITLES
from .sources import feeds, listings


def _sampled(spark: SparkSession, paths: DataFrame, **size) -> DataFrame:
    """(file, ok, y, x, r, g, b[, alpha]) of images at (path, file): decoded and sampled in one task each, so no image is
    shuffled. An image that can't be decoded has one row that isn't ok."""
    out = None
    for images in listings.images_named(spark, paths):
        own = images.withColumn("poster", F.xxhash64("file"))
        names = own.select("poster", "file", (F.col("image.width") > 0).alias("ok"))
        # the samples, a few thousand rows each, meet the names of their files
        part = materialise(names.join(pixels.from_images(own.select("poster", "image"), **size), "poster", "left").drop("poster"), "samples")
        out = part if out is None else out.unionAll(part)
    return out


def colours_from(spark: SparkSession, folder: str) -> refresh.Colours:
    """Colours of pairs from a folder of poster and logo files, named as the last part of their paths; of a poster's
    two sizes the small one, with _t before its ending, comes first, and the other if it can't be decoded. A poster whose
    files can't be decoded is an error; a missing logo doesn't matter.

    Files are looked up by name, and those that are wanted are decoded once.
    """

    def colours(pairs: DataFrame) -> DataFrame:
        name = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
        files = materialise(listings.image_paths(spark, folder).groupBy("file").agg(F.min("path").alias("path")), "image-names")
        wanted = pairs.select("pair", F.xxhash64("pair").alias("poster"), name("poster_path").alias("full"), name("logo_path").alias("mark"))
        sizes = F.array(F.struct(F.lit(0).alias("nth"), thumbnail_url(F.col("full")).alias("file")), F.struct(F.lit(1).alias("nth"), F.col("full").alias("file")))
        there = materialise(wanted.select("pair", "poster", "mark", F.explode(sizes).alias("s")).select("pair", "poster", "mark", "s.*").join(files, "file"), "images-there")
        art, left = None, there
        for _ in range(2):  # the sizes of a poster
            now = left.groupBy("pair", "poster").agg(F.min(F.struct("nth", "file", "path")).alias("f")).select("pair", "poster", "f.file", "f.path")
            sample = _sampled(spark, now.select("file", "path"), width=80, height=120)
            if sample is None:
                break
            part = now.select("poster", "file").join(sample.where("ok"), "file").select("poster", "y", "x", "r", "g", "b")
            art = part if art is None else art.unionAll(part)
            bad = sample.where("NOT ok").select("file")
            left = left.join(now.join(bad, "file", "left_semi").select("pair"), "pair", "left_semi").join(bad, "file", "left_anti")
        if art is None:
            return there.select("pair", *[F.lit(None).cast("string").alias(c) for c in (*ROLES, "error")])
        marks = _sampled(spark, files.join(there.select(F.col("mark").alias("file")).distinct(), "file", "left_semi"), width=300, height=300, clear=True)
        logos = None
        if marks is not None:
            own = there.select("mark", "poster").distinct().join(marks.where("ok"), F.col("mark") == F.col("file"))
            logos = roles.logo_colours(clusters.cluster(roles.solid(own.select("poster", "y", "x", "r", "g", "b", "alpha")), clusters.LOGO), art)
        six = roles.palette_v3(clusters.cluster(art, clusters.V3), logos)
        failed = F.when(F.col("base").isNull(), "the poster can't be decoded").alias("error")
        return there.select("pair", "poster").distinct().join(six, "poster", "left").select("pair", *ROLES, failed)

    return colours


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tintlake")
    p.add_argument("store")
    p.add_argument("command", choices=["seed", "sync", "process", "run", "prune", "stats", "report", "tvdb"])
    p.add_argument("action", nargs="?", choices=["seed", "process", "export", "run", "stats"], help="of tvdb")
    p.add_argument("--exports", default="exports")
    p.add_argument("--details", default="details")
    p.add_argument("--posters", default="posters")
    p.add_argument("--listings", default="listings", help="of tvdb: pages below series/ and movie/, artworks below artworks/, artwork-types.json")
    p.add_argument("--base", default="", help="of tvdb: where relative image paths lie")
    p.add_argument("--out", default="colours", help="of tvdb: the folder that batches are sent to")
    p.add_argument("--size", type=int, default=0, help="catalogue size; 0 is no limit")
    p.add_argument("--top", type=int, default=0, help="process the first ranks only; the catalogue stays whole")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--max-minutes", type=float, default=0, help="stop after the step in which the time runs out")
    p.add_argument("--max-writes", type=int, default=80_000, help="of tvdb: titles to send")
    p.add_argument("--include-adult", action="store_true")
    p.add_argument("--no-errors", action="store_true", help="leave failed titles out of the queue")
    p.add_argument("--today", type=date.fromisoformat, default=date.today())
    a = p.parse_args(argv)
    if (a.command == "tvdb") != (a.action is not None):
        p.error("tvdb needs an action, and only tvdb has one")
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.store)
    details = lambda: listings.read_details(spark, f"{a.details}/movie", "movie").unionByName(listings.read_details(spark, f"{a.details}/tv", "tv"))
    how = {"include_adult": a.include_adult, "include_errors": not a.no_errors, "limit": a.limit, "max_minutes": a.max_minutes}
    if a.command == "seed":
        out = refresh.seed(store, a.exports, a.today, a.size, a.include_adult)
    elif a.command == "sync":
        out = refresh.sync(store, a.exports, a.today)
    elif a.command == "process":
        out = refresh.process(store, details(), colours_from(spark, a.posters), a.top, **how)
    elif a.command == "run":
        out = refresh.run(store, a.exports, details(), colours_from(spark, a.posters), a.today, a.size, a.top, **how)
    elif a.command == "prune":
        out = {"deleted": refresh.prune(store, a.size, a.include_adult)}
    elif a.command == "stats":
        out = {r.media_type: r.counts for r in search.stats(store.read("titles", TITLES)).collect()}
    elif a.command == "report":
        rows, candidates, out = report.report(spark, a.posters)
        rows.write.parquet(f"{a.store}/report")
        candidates.write.parquet(f"{a.store}/report-candidates")
    else:
        out = _tvdb(spark, store, a)
    print(json.dumps(out, sort_keys=True))
    return 1 if a.action in ("export", "run") and out.get("export", out).get("refused") else 0


def _tvdb(spark: SparkSession, store: Store, a: argparse.Namespace) -> dict:
    listing = lambda: feeds.read_pages(spark, f"{a.listings}/series", "series", a.base).unionByName(feeds.read_pages(spark, f"{a.listings}/movie", "movie", a.base))

    def logos() -> DataFrame:
        arts, types = listings.read_artworks(spark, f"{a.listings}/artworks/series", f"{a.listings}/artworks/movie"), listings.read_artwork_types(spark, f"{a.listings}/artwork-types.json")
        own = [listings.logos_of(arts.where(F.col("kind") == k), types, k, a.base).select(F.lit(k).alias("kind"), F.col("id").alias("tvdb_id"), "logo") for k in KINDS]
        return own[0].unionByName(own[1]).where("logo IS NOT NULL")

    if a.action == "seed":
        return listed.seed(store, listing())
    if a.action == "process":
        return listed.process(store, logos(), colours_from(spark, a.posters), a.limit, a.max_minutes)
    if a.action == "export":
        return vars(listed.export(store, listed.to_folder(a.out), a.max_writes))
    if a.action == "run":
        return listed.run(store, listing(), logos(), colours_from(spark, a.posters), listed.to_folder(a.out), a.limit, a.max_minutes, a.max_writes)
    return listed.stats(store)


if __name__ == "__main__":
    raise SystemExit(main())
