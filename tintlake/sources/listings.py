"""JSON sources: daily exports, change feeds, details, paged listings and artwork."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import absolute_url, title_or_name
from ..operators.logos import best_artwork, best_logo, logo_types

EXPORT_NAMES = {"movie": "movie_ids", "tv": "tv_series_ids"}


def locate_export(spark: SparkSession, folder: str, media_type: str, today: date) -> str:
    """The newest export of today and the three days before, by name MM_DD_YYYY: a file, or a folder of parts."""
    try:
        listing = spark.read.format("binaryFile").load(f"{folder}/{EXPORT_NAMES[media_type]}_*.json.gz")
        paths = [r.path for r in listing.select("path").collect()]  # names of a folder of daily files
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        paths = []
    there = {m[2]: m[1] for p in paths if (m := re.match(rf"(.*/({EXPORT_NAMES[media_type]}_[0-9_]+\.json\.gz))(/|$)", p))}
    for back in range(4):
        name = f"{EXPORT_NAMES[media_type]}_{today - timedelta(days=back):%m_%d_%Y}.json.gz"
        if name in there:
            return there[name]
    raise RuntimeError(f"no {media_type} export in the four days up to {today}")


def export_schema(media_type: str):
    return schemas.MOVIE_EXPORT if media_type == "movie" else schemas.TV_EXPORT


def export_rows(lines: DataFrame, media_type: str) -> DataFrame:
    """(media_type, tmdb_id, title, adult, popularity, ordinal) of the lines of an export; a missing id fails."""
    title = F.col("original_title" if media_type == "movie" else "original_name")
    x = lines.withColumn("ordinal", F.monotonically_increasing_id())
    key = F.coalesce("id", F.raise_error(F.lit("an export line has no id")).cast("long"))
    return x.select(F.lit(media_type).alias("media_type"), key.alias("tmdb_id"), title.alias("title"), F.coalesce("adult", F.lit(False)).cast("int").alias("adult"), "popularity", "ordinal")


def read_export(spark: SparkSession, path: str, media_type: str) -> DataFrame:
    """``export_rows`` of a gzip JSON-lines export; a malformed line fails. gzip can't be split, so rows are dealt out
    after reading."""
    return export_rows(spark.read.schema(export_schema(media_type)).option("mode", "FAILFAST").json(path), media_type).repartition("tmdb_id")


def change_windows(start: str | date, today: date) -> list[tuple[date, date]]:
    """Windows of at most 14 days that share their boundary days; none if ``start`` isn't before today."""
    at = date.fromisoformat(start) if isinstance(start, str) else start
    out = []
    while at < today:
        end = min(at + timedelta(days=14), today)
        out.append((at, end))
        at = end
    return out


def windows_of(start: Column, today: Column) -> Column:
    """The same as an array column of (start, end)."""
    starts = F.sequence(start, F.date_sub(today, 1), F.expr("interval 14 days"))
    return F.when(start < today, F.transform(starts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, 14), today).alias("end"))))


def changed_ids(pages: DataFrame, media_type: str) -> DataFrame:
    """(media_type, tmdb_id) of pages of changes, each once; null and 0 are no ids."""
    ids = pages.select(F.explode("results.id").alias("tmdb_id")).where(F.col("tmdb_id") != 0).distinct()
    return ids.select(F.lit(media_type).alias("media_type"), "tmdb_id")


def read_changes(spark: SparkSession, path: str, media_type: str) -> DataFrame:
    return changed_ids(spark.read.schema(schemas.CHANGES).option("multiLine", True).json(path), media_type)


def read_details(spark: SparkSession, path: str, media_type: str, lines: bool = False) -> DataFrame:
    """(media_type, tmdb_id, title, adult, poster_path, logo_path) of title documents, a file each, or a line."""
    x = spark.read.schema(schemas.DETAILS).option("multiLine", not lines).json(path)
    title = title_or_name(F.col("title"), F.col("name"))
    return x.select(F.lit(media_type).alias("media_type"), F.col("id").alias("tmdb_id"), title.alias("title"), F.col("adult").cast("int").alias("adult"), "poster_path", best_logo(F.col("images.logos")).alias("logo_path"))


def read_listing(spark: SparkSession, path: str, kind: str, base: str, lines: bool = False) -> DataFrame:
    """(kind, tvdb_id, title, score, image) of the pages of a listing; rows without an id are left out. A listing whose
    last page isn't there, by its links, is an error, as what it lacks would be taken for gone."""
    pages = spark.read.schema(schemas.LISTING).option("multiLine", not lines).json(path)
    if pages.where(F.col("links.next").isNull() | (F.coalesce(F.size("data"), F.lit(0)) <= 0)).isEmpty():
        raise ValueError(f"the listing {path} goes on beyond its pages")
    x = pages.select(F.explode("data").alias("d"))
    return x.where(F.col("d.id").isNotNull() & (F.col("d.id") != 0)).select(F.lit(kind).alias("kind"), F.col("d.id").alias("tvdb_id"), F.col("d.name").alias("title"), F.col("d.score").alias("score"), absolute_url(F.col("d.image"), base).alias("image"))


def read_artworks(spark: SparkSession, series: str, movies: str, lines: bool = False) -> DataFrame:
    """(kind, id, artworks) of the artworks of series, one document each that holds the English and language-free ones
    only, and of the extended records of movies, which carry theirs among other things."""
    out = []
    for kind, path in (("series", series), ("movie", movies)):
        x = spark.read.schema(schemas.ARTWORK_DOCUMENT).option("multiLine", not lines).json(path).select("data.*")
        arts = F.col("artworks") if kind == "movie" else F.filter("artworks", lambda a: a.language.isNull() | a.language.isin("", "eng"))
        out.append(x.select(F.lit(kind).alias("kind"), "id", arts.alias("artworks")))
    return out[0].unionByName(out[1])


def read_artwork_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ARTWORK_TYPE_DOCUMENT).option("multiLine", True).json(path).select(F.explode("data").alias("t")).select("t.*")


def logos_of(artworks: DataFrame, types: DataFrame, kind: str, base: str) -> DataFrame:
    """(id, logo) of titles with artworks, by the types that are logos for their kind."""
    row = logo_types(types).where(F.lower("recordType") == kind).select(F.flatten(F.collect_list("types")).alias("t")).first()  # a few ids
    own = F.array(*[F.lit(t) for t in row.t]) if row and row.t else F.array().cast("array<int>")
    return artworks.select("id", absolute_url(best_artwork(F.col("artworks"), own), base).alias("logo"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image) of a folder's JPEG and PNG files, posters or logos; what the reader can't decode has width -1 and
    stays visible."""
    x = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(folder)
    return x.select(F.col("image.origin").alias("path"), "image")


def image_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file) of a folder's images by name; nothing of their content is read."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(folder).select("path")
    return x.select("path", F.element_at(F.split("path", "/"), -1).alias("file"))


def images_named(spark: SparkSession, paths: DataFrame, most: int = 20_000) -> Iterator[DataFrame]:
    """(file, image) of the images at (path, file) and no others, in parts of about ``most``: the names of a part are all
    that comes to the driver. What can't be decoded has width -1. Files with one name are one, the first by path."""
    paths = paths.groupBy("file").agg(F.min("path").alias("path"))
    parts = -(-paths.count() // most)
    for part in range(parts):
        own = [r.path for r in paths.where(F.pmod(F.xxhash64("file"), F.lit(parts)) == part).select("path").collect()]
        if own:
            x = spark.read.format("image").option("dropInvalid", False).load(own)
            yield x.select(F.element_at(F.split("image.origin", "/"), -1).alias("file"), "image")


def thumbnail_or_full(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, content): the thumbnail's bytes, else the full image's. keys: (key, url, thumbnail); files: (path, content)."""
    t = files.select(F.col("path").alias("thumbnail"), F.col("content").alias("small"))
    f = files.select(F.col("path").alias("url"), F.col("content").alias("full"))
    return keys.join(t, "thumbnail", "left").join(f, "url", "left").select("key", F.coalesce("small", "full").alias("content"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path).select(F.explode("titles").alias("t")).select("t.*")
