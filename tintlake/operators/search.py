"""The query surface: search, lookup, pages, models and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_pattern
from ..schemas import MEDIA, ROLES, SLOTS

# Bounds of arguments.
LIMITS = {"top": 200, "search": 100, "page": 1000, "offset": 10_000, "lookup": 500, "query": 200}


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def search(titles: DataFrame, q: str = "", limit: int = 20, offset: int = 0, media_type: str | None = None, status: str | None = None) -> DataFrame:
    """Titles that contain a text, whatever its case, or have it as their id: equal ones first, then those that start
    with it, then by popularity and id. An empty query browses."""
    bounded(limit, 1, LIMITS["search"], "limit")
    bounded(offset, 0, LIMITS["offset"], "offset")
    q, x = q.strip(), titles
    order = [F.col("popularity").desc_nulls_last(), F.col("tmdb_id"), F.col("media_type")]
    if q:
        hit = F.col("title").ilike(literal_pattern(q))
        if re.fullmatch("[0-9]+", q):
            hit = hit | (F.col("tmdb_id") == int(q))
        folded, own = F.lower("title"), F.lower(F.lit(q))
        x, order = x.where(hit), [(folded == own).desc_nulls_last(), F.startswith(folded, own).desc_nulls_last(), *order]
    if media_type:
        x = x.where(F.col("media_type") == media_type)
    if status:
        x = x.where(F.col("status") == status)
    return x.orderBy(*order).offset(offset).limit(limit)


def lookup(titles: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested titles (pos, media_type, tmdb_id) in order, each once: columns of titles, pos and found."""
    first = keys.groupBy("media_type", "tmdb_id").agg(F.min("pos").alias("pos"))
    own = titles.withColumn("found", F.lit(True))
    return first.join(own, ["media_type", "tmdb_id"], "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def missing(titles: DataFrame, keys: DataFrame) -> DataFrame:
    first = keys.groupBy("media_type", "tmdb_id").agg(F.min("pos").alias("pos"))
    return first.join(titles, ["media_type", "tmdb_id"], "left_anti")


def get(titles: DataFrame, media_type: str, tmdb_id: int) -> DataFrame:
    return titles.where((F.col("media_type") == media_type) & (F.col("tmdb_id") == tmdb_id))


def page(titles: DataFrame, media_type: str, after: int = 0, limit: int = 100, since: str | None = None) -> DataFrame:
    """Done titles of a kind by id, after an id; since: ISO text that updated_at is compared with as text."""
    bounded(limit, 1, LIMITS["page"], "limit")
    x = titles.where((F.col("media_type") == media_type) & (F.col("status") == "done") & (F.col("tmdb_id") > after))
    if since:
        x = x.where(F.col("updated_at") >= since)
    return x.orderBy("tmdb_id").limit(limit)


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def model(titles: DataFrame) -> DataFrame:
    """Rows as the interface gives them: colours (three swatches) and palette (six roles) only where they are whole."""
    done = F.col("status") == "done"
    swatches, roles = done, done
    for s in SLOTS:
        swatches = swatches & _given(f"{s}_hex") & F.col(f"{s}_ratio").isNotNull()
    for r in ROLES:
        roles = roles & _given(f"{r}_hex")
    swatch = lambda s: F.struct(F.col(f"{s}_hex").alias("hex"), F.col(f"{s}_ratio").alias("ratio")).alias(s)
    return titles.select(
        "media_type", "tmdb_id", "title", "popularity", "status", "updated_at", F.when(swatches, F.struct(*map(swatch, SLOTS))).alias("colors"),
        F.when(roles, F.struct(*[F.col(f"{r}_hex").alias(r) for r in ROLES])).alias("palette"),
    )


def stats(titles: DataFrame, kind: str = "media_type", kinds: tuple[str, ...] = MEDIA) -> DataFrame:
    """(kind, counts): a map of status to count, for every kind; statuses without titles are left out."""
    n = titles.groupBy(kind, "status").agg(F.count("*").alias("n"))
    maps = n.groupBy(kind).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))  # a handful of statuses
    every = titles.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    return every.join(maps, kind, "left").select(kind, F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"))


def first_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_rn = 1").drop("_rn")
