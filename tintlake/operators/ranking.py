"""Ranks: two kinds of titles alternating, each by score. No task sorts a whole kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KINDS, MAX_ATTEMPTS, MEDIA, PALETTE_VERSION


def _positions(df: DataFrame, kind: str, score: str, key: str, bins: int) -> DataFrame:
    """Adds ``rn``, the row's place within its kind by score (nulls last), then key.

    Rows are dealt into ranges of score, by approximate quantiles that only need to be the same for all rows, and a
    score that many rows share (null is one) into ranges of key. Each range is numbered by itself and starts where
    the ones before it end; those sums are over one row per range.
    """
    cuts = [i / bins for i in range(1, bins)]
    q = df.agg(F.percentile_approx(score, cuts, 10_000).alias("s"), F.percentile_approx(key, cuts, 10_000).alias("k")).first()
    bounds, keys = sorted(set(q.s or [])), sorted(set(q.k or []))
    heavy = sorted({x for x in q.s or [] if q.s.count(x) > 1})
    above = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda b: b > F.col(score))) if bounds else F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(x) for x in keys]), lambda b: b < F.col(key))) if keys else F.lit(0)
    shared = F.col(score).isNull() | F.col(score).isin(heavy) if heavy else F.col(score).isNull()
    x = df.withColumns({
        "_range": F.when(F.col(score).isNull(), 2 * len(bounds) + 2).when(shared, 2 * above + 1).otherwise(2 * above),
        "_part": F.when(shared, below).otherwise(0),
    })
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    sizes = x.groupBy(kind, "_range", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(kind).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(kind, "_range", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(kind, "_range", "_part").orderBy(*order))
    return x.withColumn("rn", own).join(starts, [kind, "_range", "_part"]).withColumn("rn", F.col("rn") + F.col("_start")).drop("_range", "_part", "_start")


def interleaved_rank(df: DataFrame, kind: str = "media_type", score: str = "popularity", key: str = "tmdb_id", kinds: tuple[str, str] = MEDIA, bins: int = 64) -> DataFrame:
    """Adds ``rank``: the best of the first kind, the best of the second, and so on; then the rest of the longer one.

    In closed form: the n-th of the first kind follows n-1 of the second, or all it has; the n-th of the second
    follows n of the first.
    """
    first, second = kinds
    x = _positions(df.where(F.col(kind).isin(first, second)), kind, score, key, bins)
    other = F.when(F.col(kind) == first, second).otherwise(first)
    sizes = df.groupBy(kind).agg(F.count("*").alias("_others")).select(other.alias(kind), "_others")
    x = x.join(F.broadcast(sizes), kind, "left")  # a row for each kind
    others = F.coalesce("_others", F.lit(0))
    rank = F.when(F.col(kind) == first, F.col("rn") + F.least(F.col("rn") - 1, others)).otherwise(F.col("rn") + F.least(F.col("rn"), others))
    return x.withColumn("rank", rank.cast("long")).drop("_others", "rn")


def outdated(version: Column, target: int = PALETTE_VERSION) -> Column:
    """Whether a palette is older than the target; null and 0 count as version 1."""
    return F.coalesce(F.nullif(version, F.lit(0)), F.lit(1)) < target


def listed(titles: DataFrame, include_adult: bool = False) -> DataFrame:
    return titles if include_adult else titles.where(F.coalesce("adult", F.lit(0)) == 0)


def work_queue(titles: DataFrame, top: int = 0, limit: int = 0, include_errors: bool = True, include_adult: bool = False) -> DataFrame:
    """Titles to process, in rank order: open ones and done ones of an older version, of the ``top`` ranks; 0 is no limit."""
    ranked = interleaved_rank(listed(titles, include_adult))
    if top:
        ranked = ranked.where(F.col("rank") <= top)
    open_ = F.col("status").isin("pending", *(["error"] if include_errors else [])) & (F.col("attempts") < MAX_ATTEMPTS)
    found = ranked.where(open_ | ((F.col("status") == "done") & outdated(F.col("palette_version"))))
    return found.orderBy("rank").limit(limit) if limit else found


def work_queue_b(titles: DataFrame, limit: int = 0) -> DataFrame:
    """The second pipeline's queue: eligible titles first, then ranked among themselves, series first."""
    open_ = F.col("status").isin("pending", "error") & (F.col("attempts") < MAX_ATTEMPTS)
    old = (F.col("status") == "done") & (F.col("palette_version").isNull() | (F.col("palette_version") < PALETTE_VERSION))
    ranked = interleaved_rank(titles.where(open_ | old), "kind", "score", "tvdb_id", KINDS)
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def top_ranked(titles: DataFrame, limit: int = 50, offset: int = 0, media_type: str | None = None) -> DataFrame:
    """Done titles by rank, adult ones included; ranks count from the first, whatever the offset."""
    done = titles.where(F.col("status") == "done")
    if media_type:
        # one kind: Spark keeps the first rows of each partition only
        rn = F.row_number().over(Window.partitionBy("media_type").orderBy(F.col("popularity").desc_nulls_last(), "tmdb_id"))
        ranked = done.where(F.col("media_type") == media_type).withColumn("rank", rn.cast("long"))
    else:
        # of each kind no more than offset + limit can be in the page
        rn = F.row_number().over(Window.partitionBy("media_type").orderBy(F.col("popularity").desc_nulls_last(), "tmdb_id"))
        ranked = interleaved_rank(done.withColumn("_rn", rn).where(F.col("_rn") <= offset + limit).drop("_rn"), bins=2)
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
