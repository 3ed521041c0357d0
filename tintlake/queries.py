"""Registered queries of the catalogue engine, over the given tables, and their DuckDB SQL.

A catalogue is derived from the tables by SQL that both engines run: customers are movies, suppliers are series.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour, text
from .operators import catalogue, clusters, logos, palettes, pixels, ranking, roles, search, summaries
from .plans.cut import materialise, new_folder
from .plans import listed, refresh
from .plans.store import Store
from . import schemas
from .schemas import ROLES, SLOTS
from .schemas import TITLES as TITLE_SCHEMA
from .schemas import TVDB_TITLES as TVDB_SCHEMA
from .sources import listings
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AT = "2026-02-01T00:00:00+00:00"
_STATUS = "CASE {0} WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'no_poster' WHEN 3 THEN 'not_found' ELSE 'error' END"
_HEX = "'#' || upper(substr(md5(CAST(id * {0} + {1} AS STRING)), 1, 6))"


def _titles_sql() -> str:
    colours = ", ".join(
        [f"CASE WHEN id % {m} = 1 THEN NULL ELSE {_HEX.format(7, i)} END AS {s}_hex, CASE WHEN id % {m + 2} = 1 THEN NULL ELSE CAST(id % 97 AS DOUBLE) / 97 END AS {s}_ratio" for i, (s, m) in enumerate(zip(SLOTS, (13, 17, 19)))]
        + [f"CASE WHEN id % 23 = {i} THEN {'NULL' if i % 2 else chr(39) * 2} ELSE {_HEX.format(11, i)} END AS {r}_hex" for i, r in enumerate(ROLES)]
    )
    return f"""
SELECT media_type, id AS tmdb_id, title, CAST(CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS adult, popularity,
  CASE WHEN id % 6 = 0 THEN NULL ELSE '/p' || CAST(id % 19 AS STRING) || '.jpg' END AS poster_path,
  CASE WHEN id % 3 = 0 THEN NULL ELSE '/l' || CAST(id % 7 AS STRING) || '.png' END AS logo_path, {colours},
  {_STATUS.format('id % 5')} AS status, CAST(NULL AS STRING) AS error, CAST(id % 7 AS INT) AS attempts,
  CAST(CASE WHEN id % 4 = 0 THEN NULL ELSE id % 4 END AS INT) AS palette_version,
  '2026-01-' || lpad(CAST(id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00+00:00' AS updated_at
FROM (SELECT 'movie' AS media_type, c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS popularity FROM {{customer}}
      UNION ALL SELECT 'tv', s_suppkey, s_name, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_acctbal END FROM {{supplier}}) u
"""


TITLES = _titles_sql()
_ROLES_B = ", ".join(f"CASE WHEN id % 23 = {i} THEN NULL ELSE {_HEX.format(11, i)} END AS {r}" for i, r in enumerate(ROLES))
TVDB = f"""
SELECT kind, id AS tvdb_id, title, score, image, CAST(NULL AS STRING) AS logo, {_STATUS.format('id % 5')} AS status, CAST(NULL AS STRING) AS error,
  CAST(id % 7 AS INT) AS attempts, CAST(CASE WHEN id % 4 = 0 THEN NULL ELSE id % 4 END AS INT) AS palette_version, {_ROLES_B},
  CAST(CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END AS INT) AS dirty, CAST(CASE WHEN id % 9 = 0 THEN NULL ELSE id % 3 END AS INT) AS seen, '2026-01-01T00:00:00+00:00' AS updated_at
FROM (SELECT 'movie' AS kind, c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS score,
             CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'i' || CAST(c_custkey % 10 AS STRING) END AS image FROM {{customer}}
      UNION ALL SELECT 'series', s_suppkey, s_name, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_acctbal END, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'i' || CAST(s_suppkey % 10 AS STRING) END FROM {{supplier}}) u
"""
#: What an export lists: two thirds of the known titles, some with another score or adult flag, and new ones.
INCOMING = """
SELECT media_type, tmdb_id, title, CAST(CASE WHEN tmdb_id % 10 = 0 THEN 1 - adult ELSE adult END AS INT) AS adult, CASE WHEN tmdb_id % 2 = 0 THEN popularity + 1 ELSE popularity END AS popularity FROM ({titles}) t WHERE tmdb_id % 3 <> 0
UNION ALL SELECT media_type, tmdb_id + 10000000, title, adult, popularity FROM ({titles}) t WHERE tmdb_id % 3 = 0
"""
LISTING = """
SELECT kind, tvdb_id, title, score + 1 AS score, CASE WHEN tvdb_id % 4 = 0 THEN 'new' ELSE image END AS image, CAST(9 AS INT) AS seen FROM ({tvdb}) t WHERE tvdb_id % 3 <> 0
UNION ALL SELECT kind, tvdb_id + 10000000, title, score, image, CAST(9 AS INT) FROM ({tvdb}) t WHERE tvdb_id % 3 = 0
"""
#: Posters of 10 pixels a row from line items: a part is a poster.
PIXELS = """
SELECT poster, CAST(floor(nth / 10) AS INT) AS y, CAST(nth % 10 AS INT) AS x, r, g, b FROM (
  SELECT l_partkey AS poster, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS nth,
    CAST((l_quantity * 5) % 256 AS INT) AS r, CAST((l_discount * 2500) % 256 AS INT) AS g, CAST(floor(l_extendedprice) % 256 AS INT) AS b FROM {lineitem}) p
"""
_T = "WITH titles AS (" + TITLES.format(customer="customer", supplier="supplier") + "), tvdb AS (" + TVDB.format(customer="customer", supplier="supplier") + "), px AS (" + PIXELS.format(lineitem="lineitem") + "), "
_T += "incoming AS (" + INCOMING.format(titles="SELECT * FROM titles") + "), listing AS (" + LISTING.format(tvdb="SELECT * FROM tvdb") + ")"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(spark: SparkSession, d: str, q: str, *names: str) -> DataFrame:
    return spark.sql(q, **{n: table(spark, d, n) for n in names})


def titles(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, TITLES, "customer", "supplier")


def tvdb(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, TVDB, "customer", "supplier")


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, INCOMING.format(titles=TITLES), "customer", "supplier")


def listing(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, LISTING.format(tvdb=TVDB), "customer", "supplier")


def _by_part(spark: SparkSession, d: str, q: str) -> DataFrame:
    """A query of line items that numbers them by part, over rows that are by part already: Spark then knows that the
    result is by poster, so nothing that is grouped by poster afterwards is shuffled again."""
    return spark.sql(q, lineitem=table(spark, d, "lineitem").repartition("l_partkey"))


def pixel_table(spark: SparkSession, d: str) -> DataFrame:
    return _by_part(spark, d, PIXELS)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_RANKED = ", n AS (SELECT media_type, count(*) AS c FROM {0} GROUP BY 1), rn AS (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY popularity DESC NULLS LAST, tmdb_id) AS rn FROM {0}), ranked AS (SELECT *, row_number() OVER (ORDER BY rn, media_type) AS rank FROM rn)"


# ---------------------------------------------------------------- ranks and queues


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE adult = 0)") + " SELECT media_type, tmdb_id, rank FROM ranked")
def interleaved_rank(spark, d):
    return ranking.interleaved_rank(ranking.listed(titles(spark, d))).select("media_type", "tmdb_id", "rank")


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE status = 'done')") + " SELECT media_type, tmdb_id, rank FROM ranked WHERE rank > 5 AND rank <= 55")
def top_ranked_page(spark, d):
    return ranking.top_ranked(titles(spark, d), 50, 5).select("media_type", "tmdb_id", "rank")


@query(_T + " SELECT media_type, tmdb_id, row_number() OVER (ORDER BY popularity DESC NULLS LAST, tmdb_id) AS rank FROM titles WHERE status = 'done' AND media_type = 'movie' QUALIFY rank <= 50")
def top_single_kind(spark, d):
    return ranking.top_ranked(titles(spark, d), 50, 0, "movie").select("media_type", "tmdb_id", "rank")


_OPEN = "(status IN ('pending', 'error') AND attempts < 5 OR status = 'done' AND coalesce(nullif(palette_version, 0), 1) < 3)"


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE adult = 0)") + f" SELECT media_type, tmdb_id, rank FROM ranked WHERE rank <= 500 AND {_OPEN} ORDER BY rank LIMIT 100")
def queue_a(spark, d):
    return ranking.work_queue(titles(spark, d), top=500, limit=100).select("media_type", "tmdb_id", "rank")


@query(_T + f", e AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC NULLS LAST, tvdb_id) AS rn FROM tvdb WHERE {_OPEN}) SELECT kind, tvdb_id, row_number() OVER (ORDER BY rn, kind DESC) AS rank FROM e")
def queue_b(spark, d):
    return ranking.work_queue_b(tvdb(spark, d)).select("kind", "tvdb_id", "rank")


# ---------------------------------------------------------------- counts


@query(_T + " SELECT media_type, status, count(*) AS n FROM titles GROUP BY 1, 2")
def stats_by_kind_status(spark, d):
    return search.stats(titles(spark, d)).select("media_type", F.explode("counts").alias("status", "n"))


@query(_T + " SELECT kind, status, count(*) AS n, count(*) FILTER (dirty = 1) AS unsent FROM tvdb GROUP BY 1, 2")
def stats_unsent(spark, d):
    return tvdb(spark, d).groupBy("kind", "status").agg(F.count("*").alias("n"), F.count_if(F.col("dirty") == 1).alias("unsent"))


@query(_T + " SELECT kind, CAST(coalesce(max(seen), 0) + 1 AS INT) AS generation FROM tvdb GROUP BY 1")
def next_generation(spark, d):
    return catalogue.next_generation(tvdb(spark, d), ("series", "movie"))


@query(_T + " SELECT count(*) FILTER (status = 'done') AS done, count(*) AS total FROM titles")
def site_stats(spark, d):
    return titles(spark, d).agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))


# ---------------------------------------------------------------- search and lookup

_PARTS = "part_titles AS (SELECT 'movie' AS media_type, p_partkey AS tmdb_id, p_name AS title, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS popularity, CASE WHEN p_partkey % 2 = 0 THEN 'done' ELSE 'pending' END AS status FROM part)"


def part_titles(spark, d):
    x = table(spark, d, "part")
    popularity = F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice"))
    return x.select(F.lit("movie").alias("media_type"), F.col("p_partkey").alias("tmdb_id"), F.col("p_name").alias("title"), popularity.alias("popularity"), F.when(F.col("p_partkey") % 2 == 0, "done").otherwise("pending").alias("status"))


@query(f"WITH {_PARTS} SELECT tmdb_id, title FROM part_titles WHERE title ILIKE '%re%' ORDER BY lower(title) = 're' DESC, starts_with(lower(title), 're') DESC, popularity DESC NULLS LAST, tmdb_id LIMIT 20 OFFSET 3")
def search_substring(spark, d):
    return search.search(part_titles(spark, d), "RE", 20, 3).select("tmdb_id", "title")


@query(f"WITH {_PARTS}, odd AS (SELECT *, CASE WHEN tmdb_id % 3 = 0 THEN '100% ' ELSE '100 ' END || title || CASE WHEN tmdb_id % 5 = 0 THEN '_x' ELSE 'yx' END AS t FROM part_titles) SELECT tmdb_id, t AS title FROM odd WHERE contains(lower(t), '0%') AND status = 'done' ORDER BY popularity DESC NULLS LAST, tmdb_id LIMIT 50")
def search_wildcard_escape(spark, d):
    x = part_titles(spark, d)
    t = F.concat(F.when(F.col("tmdb_id") % 3 == 0, "100% ").otherwise("100 "), "title", F.when(F.col("tmdb_id") % 5 == 0, "_x").otherwise("yx"))
    return search.search(x.withColumn("title", t), "0%", 50, status="done").select("tmdb_id", "title")


@query(f"WITH {_PARTS} SELECT tmdb_id, title FROM part_titles WHERE title ILIKE '%42%' OR tmdb_id = 42 ORDER BY popularity DESC NULLS LAST, tmdb_id LIMIT 20")
def search_numeric_id(spark, d):
    return search.search(part_titles(spark, d), "42").select("tmdb_id", "title")


@query(f"WITH {_PARTS} SELECT tmdb_id, title, popularity FROM part_titles WHERE status = 'done' ORDER BY popularity DESC NULLS LAST, tmdb_id LIMIT 40 OFFSET 10")
def browse_by_popularity(spark, d):
    return search.search(part_titles(spark, d), "", 40, 10, status="done").select("tmdb_id", "title", "popularity")


def _requests(spark, d):
    """What orders ask for: a customer each, some unknown, many twice."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, "tv").otherwise("movie").alias("media_type"), F.col("o_custkey").alias("tmdb_id"))


_REQ = ", req AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'tv' ELSE 'movie' END AS media_type, o_custkey AS tmdb_id, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2)"


@query(_T + _REQ + " SELECT r.pos, r.media_type, r.tmdb_id, t.title, t.tmdb_id IS NOT NULL AS found FROM req r LEFT JOIN titles t USING (media_type, tmdb_id)")
def lookup_ordered(spark, d):
    return search.lookup(titles(spark, d), _requests(spark, d)).select("pos", "media_type", "tmdb_id", "title", "found")


@query(_T + _REQ + " SELECT r.pos, r.media_type, r.tmdb_id FROM req r ANTI JOIN titles t USING (media_type, tmdb_id)")
def lookup_missing(spark, d):
    return search.missing(titles(spark, d), _requests(spark, d)).select("pos", "media_type", "tmdb_id")


@query(_T + " SELECT tmdb_id, title, updated_at FROM titles WHERE media_type = 'movie' AND status = 'done' AND tmdb_id > 100 AND updated_at >= '2026-01-10' ORDER BY tmdb_id LIMIT 100")
def keyset_page(spark, d):
    return search.page(titles(spark, d), "movie", 100, 100, "2026-01-10").select("tmdb_id", "title", "updated_at")


_WHOLE = "status = 'done' AND " + " AND ".join(f"{s}_hex IS NOT NULL AND {s}_hex <> '' AND {s}_ratio IS NOT NULL" for s in SLOTS)
_WHOLE6 = "status = 'done' AND " + " AND ".join(f"{r}_hex IS NOT NULL AND {r}_hex <> ''" for r in ROLES)


@query(_T + f" SELECT media_type, tmdb_id, CASE WHEN {_WHOLE} THEN primary_hex END AS primary_hex, CASE WHEN {_WHOLE} THEN tertiary_ratio END AS tertiary_ratio, CASE WHEN {_WHOLE6} THEN base_hex END AS base, CASE WHEN {_WHOLE6} THEN accent_hex END AS accent FROM titles")
def row_model(spark, d):
    return search.model(titles(spark, d)).selectExpr("media_type", "tmdb_id", "colors.primary.hex AS primary_hex", "colors.tertiary.ratio AS tertiary_ratio", "palette.base AS base", "palette.accent AS accent")


# ---------------------------------------------------------------- changes

_OUT = ["media_type", "tmdb_id", "title", "adult", "popularity", "status", "attempts", "palette_version", "updated_at"]
_DIFF = "(o.popularity IS DISTINCT FROM n.popularity OR o.adult IS DISTINCT FROM n.adult OR o.title IS NULL)"


@query(_T + f""" SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id, coalesce(o.title, n.title) AS title,
  CASE WHEN o.tmdb_id IS NULL OR n.tmdb_id IS NOT NULL AND {_DIFF} THEN n.adult ELSE o.adult END AS adult,
  CASE WHEN o.tmdb_id IS NULL OR n.tmdb_id IS NOT NULL AND {_DIFF} THEN n.popularity ELSE o.popularity END AS popularity,
  coalesce(o.status, 'pending') AS status, coalesce(o.attempts, 0) AS attempts, o.palette_version, coalesce(o.updated_at, '{AT}') AS updated_at
  FROM titles o FULL JOIN incoming n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def seed_upsert_a(spark, d):
    return catalogue.seed(titles(spark, d), incoming(spark, d), F.lit(AT)).select(*_OUT)


@query(_T + _RANKED.format("(SELECT * FROM incoming WHERE adult = 0)") + " SELECT media_type, tmdb_id FROM ranked WHERE rank <= 300")
def seed_keep_top(spark, d):
    return catalogue.keep_top(incoming(spark, d), 300).select("media_type", "tmdb_id")


_CHG = ", chg AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type, user_id AS tmdb_id FROM events)"


def _changes(spark, d):
    return table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "movie").otherwise("tv").alias("media_type"), F.col("user_id").alias("tmdb_id"))


@query(_T + _CHG + """ SELECT t.media_type, t.tmdb_id, CASE WHEN c.tmdb_id IS NOT NULL AND status <> 'done' THEN 'pending' ELSE status END AS status,
  CASE WHEN c.tmdb_id IS NOT NULL THEN 0 ELSE attempts END AS attempts, CASE WHEN c.tmdb_id IS NOT NULL AND status = 'done' THEN NULL ELSE palette_version END AS palette_version
  FROM titles t LEFT JOIN chg c ON t.media_type = c.media_type AND t.tmdb_id = c.tmdb_id""")
def requeue(spark, d):
    return catalogue.requeue(titles(spark, d), _changes(spark, d)).select("media_type", "tmdb_id", "status", "attempts", "palette_version")


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE adult = 0)") + " SELECT t.media_type, t.tmdb_id, t.status FROM titles t WHERE t.status = 'done' OR EXISTS (SELECT 1 FROM ranked r WHERE r.media_type = t.media_type AND r.tmdb_id = t.tmdb_id AND r.rank <= 200)")
def prune(spark, d):
    return catalogue.prune(titles(spark, d), 200).select("media_type", "tmdb_id", "status")


#: Outcomes: every third known title, by id, is done, failed or without a poster, and some are unknown.
_RES = f"""SELECT media_type, tmdb_id + CASE WHEN tmdb_id % 30 = 0 THEN 20000000 ELSE 0 END AS tmdb_id, CASE tmdb_id % 9 WHEN 0 THEN 'done' WHEN 3 THEN 'error' ELSE 'no_poster' END AS status,
  CASE WHEN tmdb_id % 9 = 3 THEN repeat('e', 600) END AS error, CASE WHEN tmdb_id % 9 = 0 THEN base_hex END AS base_hex, CASE WHEN tmdb_id % 9 = 0 THEN poster_path END AS poster_path FROM ({{titles}}) t WHERE tmdb_id % 3 = 0"""


@query(_T + ", res AS (" + _RES.format(titles="SELECT * FROM titles") + f""") SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id, o.title,
  CASE WHEN n.tmdb_id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.tmdb_id IS NOT NULL THEN substr(n.error, 1, 500) ELSE o.error END AS error,
  CASE WHEN n.tmdb_id IS NULL THEN o.attempts WHEN n.status = 'error' THEN coalesce(o.attempts, 0) + 1 ELSE 0 END AS attempts,
  CASE WHEN n.tmdb_id IS NOT NULL THEN n.base_hex ELSE o.base_hex END AS base_hex, CASE WHEN n.tmdb_id IS NULL THEN o.palette_version WHEN n.base_hex IS NOT NULL THEN 3 END AS palette_version,
  CASE WHEN n.tmdb_id IS NOT NULL THEN '{AT}' ELSE o.updated_at END AS updated_at
  FROM titles o FULL JOIN res n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def save_results_a(spark, d):
    results = _sql(spark, d, _RES.format(titles=TITLES), "customer", "supplier")
    return catalogue.save(titles(spark, d), results, F.lit(AT)).select("media_type", "tmdb_id", "title", "status", "error", "attempts", "base_hex", "palette_version", "updated_at")


_MOVED = "(o.tvdb_id IS NOT NULL AND n.tvdb_id IS NOT NULL AND o.image IS DISTINCT FROM n.image)"


@query(_T + f""" SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.tvdb_id, n.tvdb_id) AS tvdb_id, CASE WHEN n.tvdb_id IS NOT NULL THEN n.score ELSE o.score END AS score,
  CASE WHEN n.tvdb_id IS NOT NULL THEN n.image ELSE o.image END AS image, CASE WHEN n.tvdb_id IS NOT NULL THEN n.seen ELSE o.seen END AS seen,
  CASE WHEN o.tvdb_id IS NULL OR {_MOVED} AND o.status <> 'done' OR n.tvdb_id IS NOT NULL AND o.status = 'not_found' THEN 'pending' ELSE o.status END AS status,
  CASE WHEN o.tvdb_id IS NULL OR {_MOVED} THEN 0 ELSE o.attempts END AS attempts, CASE WHEN {_MOVED} THEN NULL ELSE o.palette_version END AS palette_version, coalesce(o.dirty, 0) AS dirty
  FROM tvdb o FULL JOIN listing n ON o.kind = n.kind AND o.tvdb_id = n.tvdb_id""")
def seed_upsert_b(spark, d):
    return catalogue.seed_b(tvdb(spark, d), listing(spark, d), F.lit(AT)).select("kind", "tvdb_id", "score", "image", "seen", "status", "attempts", "palette_version", "dirty")


@query(_T + """ SELECT t.kind, t.tvdb_id, CASE WHEN g THEN 'not_found' ELSE status END AS status, CASE WHEN g AND status = 'done' THEN 1 ELSE dirty END AS dirty FROM (SELECT *,
  kind IN (SELECT kind FROM listing) AND status <> 'not_found' AND NOT EXISTS (SELECT 1 FROM listing n WHERE n.kind = tvdb.kind AND n.tvdb_id = tvdb.tvdb_id) AS g FROM tvdb) t""")
def generation_sweep(spark, d):
    return catalogue.sweep(tvdb(spark, d), listing(spark, d), F.lit(AT)).select("kind", "tvdb_id", "status", "dirty")


_RES_B = "SELECT kind, tvdb_id + CASE WHEN tvdb_id % 30 = 0 THEN 20000000 ELSE 0 END AS tvdb_id, CASE tvdb_id % 9 WHEN 0 THEN 'done' WHEN 3 THEN 'error' ELSE 'no_poster' END AS status, CASE WHEN tvdb_id % 9 = 0 THEN base END AS base FROM ({tvdb}) t WHERE tvdb_id % 3 = 0"


@query(_T + ", res AS (" + _RES_B.format(tvdb="SELECT * FROM tvdb") + """) SELECT o.kind, o.tvdb_id, coalesce(n.status, o.status) AS status, CASE WHEN n.tvdb_id IS NULL THEN o.attempts WHEN n.status = 'error' THEN o.attempts + 1 ELSE 0 END AS attempts,
  CASE WHEN n.tvdb_id IS NULL THEN o.palette_version WHEN n.status = 'done' THEN 3 END AS palette_version, CASE WHEN n.status IN ('done', 'no_poster', 'not_found') THEN 1 ELSE o.dirty END AS dirty,
  CASE WHEN n.tvdb_id IS NULL THEN o.base ELSE n.base END AS base FROM tvdb o LEFT JOIN res n ON o.kind = n.kind AND o.tvdb_id = n.tvdb_id""")
def save_results_b(spark, d):
    results = _sql(spark, d, _RES_B.format(tvdb=TVDB), "customer", "supplier")
    return catalogue.save_b(tvdb(spark, d), results, F.lit(AT)).select("kind", "tvdb_id", "status", "attempts", "palette_version", "dirty", "base")


_DIRTY = "d AS (SELECT kind, tvdb_id, score, status, row_number() OVER (ORDER BY score DESC NULLS LAST, kind, tvdb_id) AS rn FROM tvdb WHERE dirty = 1 QUALIFY rn <= 700)"


@query(_T + f", {_DIRTY} SELECT kind, tvdb_id, rn, CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, kind || ':' || CAST(tvdb_id AS STRING) AS key FROM d")
def export_batches(spark, d):
    return catalogue.export_batches(tvdb(spark, d), 700).select("kind", "tvdb_id", "rn", "batch", "key")


_JSON = " || ',' || ".join(f"""'"{r}":' || CASE WHEN t.{r} IS NULL THEN 'null' ELSE '"' || t.{r} || '"' END""" for r in ROLES)


@query(_T + f""", {_DIRTY}, j AS (SELECT d.rn, '{{"key":"' || d.kind || ':' || CAST(d.tvdb_id AS STRING) || '","colours":' || CASE WHEN t.status = 'done' THEN '{{' || {_JSON} || '}}' ELSE 'null' END || '}}' AS item
  FROM d JOIN tvdb t ON d.kind = t.kind AND d.tvdb_id = t.tvdb_id) SELECT CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, '{{"items":[' || string_agg(item, ',' ORDER BY rn) || ']}}' AS items FROM j GROUP BY 1""")
def export_payload(spark, d):
    return catalogue.payloads(catalogue.export_batches(tvdb(spark, d), 700))


@query(_T + f", {_DIRTY} SELECT t.kind, t.tvdb_id, CASE WHEN d.tvdb_id IS NOT NULL THEN 0 ELSE t.dirty END AS dirty FROM tvdb t LEFT JOIN d ON t.kind = d.kind AND t.tvdb_id = d.tvdb_id")
def export_acknowledged(spark, d):
    x = tvdb(spark, d)
    return catalogue.acknowledge(x, catalogue.export_batches(x, 700)).select("kind", "tvdb_id", "dirty")


@query(_T + " SELECT poster_path || '|' || coalesce(logo_path, '') AS pair, arg_min(coalesce(base_hex, '-'), media_type || lpad(CAST(tmdb_id AS STRING), 12, '0')) AS base FROM titles WHERE status = 'done' AND poster_path IS NOT NULL AND palette_version = 3 GROUP BY 1")
def palette_cache(spark, d):
    return catalogue.palette_cache(titles(spark, d)).select("pair", F.coalesce("base_hex", F.lit("-")).alias("base"))


# ---------------------------------------------------------------- streams: the tables as files that arrive


def _arriving(spark, pages: DataFrame) -> tuple[str, Store]:
    """A folder of JSON files, one a page, and an empty store beside it."""
    folder = new_folder(spark, "stream")
    pages.write.option("maxRecordsPerFile", 1).json(f"{folder}/in")
    return folder, Store(spark, f"{folder}/store")


@query(_T + """ SELECT t.media_type, t.tmdb_id, CASE WHEN c AND status <> 'done' THEN 'pending' ELSE status END AS status, CASE WHEN c THEN 0 ELSE attempts END AS attempts, CASE WHEN c AND status = 'done' THEN NULL ELSE palette_version END AS palette_version
  FROM (SELECT *, media_type = 'movie' AND tmdb_id IN (SELECT user_id FROM events WHERE user_id <> 0) AS c FROM titles) t""")
def streaming_requeue(spark, d):
    pages = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(F.struct(F.col("user_id").alias("id"))).alias("results"))
    folder, store = _arriving(spark, pages.select("results"))
    store.write("titles", titles(spark, d))
    jobs.follow_changes(store, f"{folder}/in", "movie", f"{folder}/checkpoint")
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "status", "attempts", "palette_version")


@query(_T + f""" SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id, coalesce(o.title, n.title) AS title,
  CASE WHEN o.tmdb_id IS NULL OR n.tmdb_id IS NOT NULL AND {_DIFF} THEN n.adult ELSE o.adult END AS adult,
  CASE WHEN o.tmdb_id IS NULL OR n.tmdb_id IS NOT NULL AND {_DIFF} THEN n.popularity ELSE o.popularity END AS popularity, coalesce(o.status, 'pending') AS status
  FROM titles o FULL JOIN (SELECT * FROM incoming WHERE media_type = 'movie') n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def streaming_seed(spark, d):
    x = incoming(spark, d).where("media_type = 'movie'")
    lines = x.select(F.col("tmdb_id").alias("id"), F.col("title").alias("original_title"), (F.col("adult") == 1).alias("adult"), "popularity")
    folder = new_folder(spark, "stream")
    lines.write.option("compression", "gzip").json(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    store.write("titles", titles(spark, d))
    jobs.follow_exports(store, f"{folder}/in", "movie", f"{folder}/checkpoint")
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "title", "adult", "popularity", "status")


@query(_T + ", res AS (" + _RES.format(titles="SELECT * FROM titles") + """) SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id, coalesce(n.status, o.status) AS status,
  CASE WHEN n.tmdb_id IS NULL THEN o.attempts WHEN n.status = 'error' THEN coalesce(o.attempts, 0) + 1 ELSE 0 END AS attempts FROM titles o FULL JOIN res n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def streaming_results(spark, d):
    """Results that arrive as files, followed by two runs of the stream."""
    folder = new_folder(spark, "stream")
    results = catalogue.conform(_sql(spark, d, _RES.format(titles=TITLES), "customer", "supplier"), TITLE_SCHEMA)
    results.write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    store.write("titles", titles(spark, d))
    for _ in range(2):
        jobs.follow_results(store, f"{folder}/in", f"{folder}/checkpoint")
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "status", "attempts")


# ---------------------------------------------------------------- whole runs

_OPEN_B = "(status IN ('pending', 'error') AND attempts < 5 OR status = 'done' AND (palette_version IS NULL OR palette_version < 3))"


@query(_T + f""", a AS (SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.tvdb_id, n.tvdb_id) AS tvdb_id, CASE WHEN n.tvdb_id IS NOT NULL THEN n.score ELSE o.score END AS score, CASE WHEN n.tvdb_id IS NOT NULL THEN n.image ELSE o.image END AS image,
    CASE WHEN o.tvdb_id IS NULL OR {_MOVED} AND o.status <> 'done' OR n.tvdb_id IS NOT NULL AND o.status = 'not_found' THEN 'pending' ELSE o.status END AS status,
    CASE WHEN o.tvdb_id IS NULL OR {_MOVED} THEN 0 ELSE o.attempts END AS attempts, CASE WHEN {_MOVED} THEN NULL ELSE o.palette_version END AS palette_version, coalesce(o.dirty, 0) AS dirty, o.base AS base, n.tvdb_id IS NULL AS unlisted
    FROM tvdb o FULL JOIN listing n ON o.kind = n.kind AND o.tvdb_id = n.tvdb_id),
  b AS (SELECT * REPLACE (CASE WHEN unlisted AND status = 'done' THEN 1 ELSE dirty END AS dirty, CASE WHEN unlisted THEN 'not_found' ELSE status END AS status) FROM a),
  c AS (SELECT *, {_OPEN_B} AS open, {_OPEN_B} AND image IS NOT NULL AND image NOT IN ('i5', 'i7') AS coloured, {_OPEN_B} AND image = 'i5' AS failed FROM b),
  e AS (SELECT kind, tvdb_id, score, CASE WHEN failed THEN 'error' WHEN open THEN CASE WHEN coloured THEN 'done' ELSE 'no_poster' END ELSE status END AS status, CASE WHEN failed THEN attempts + 1 WHEN open THEN 0 ELSE attempts END AS attempts, CASE WHEN open THEN CASE WHEN coloured THEN 3 END ELSE palette_version END AS palette_version,
    CASE WHEN open AND failed IS NOT TRUE THEN 1 ELSE dirty END AS dirty, CASE WHEN open THEN CASE WHEN coloured THEN '#' || upper(substr(md5(image), 1, 6)) END ELSE base END AS base FROM c)
  SELECT kind, tvdb_id, status, attempts, palette_version, CASE WHEN row_number() OVER (PARTITION BY dirty ORDER BY score DESC NULLS LAST, kind, tvdb_id) <= 300 THEN 0 ELSE dirty END AS dirty, base FROM e""")
def tvdb_refresh(spark, d):
    """A whole run of the second pipeline: listing, sweep, colours and a budgeted export. Image i7 is gone, i5 is broken."""
    folder = new_folder(spark, "run")
    store = Store(spark, f"{folder}/store")
    store.write(listed.TABLE, tvdb(spark, d))
    code = F.concat(F.lit("#"), F.upper(F.substring(F.md5("poster_path"), 1, 6)))
    none = listing(spark, d).select("kind", "tvdb_id", F.lit(None).cast("string").alias("logo")).where("false")
    failed = F.when(F.col("poster_path") == "i5", "it can't be decoded").alias("error")
    listed.run(store, listing(spark, d).drop("seen"), none, lambda p: p.where("poster_path <> 'i7'").select("pair", *[code.alias(r) for r in ROLES], failed), listed.to_folder(f"{folder}/out"), most=300)
    return store.read(listed.TABLE, TVDB_SCHEMA).select("kind", "tvdb_id", "status", "attempts", "palette_version", "dirty", "base")


_CODE = "'#' || upper(substr(md5(poster_path || '|' || coalesce(logo_path, '')), 1, 6))"


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE adult = 0)") + f""", cache AS (SELECT poster_path || '|' || coalesce(logo_path, '') AS pair, arg_min(coalesce(base_hex, '-'), media_type || lpad(CAST(tmdb_id AS STRING), 12, '0')) AS base FROM titles WHERE status = 'done' AND poster_path IS NOT NULL AND palette_version = 3 GROUP BY 1)
  SELECT r.media_type, r.tmdb_id, CASE WHEN r.tmdb_id % 10 = 3 THEN 'not_found' WHEN c.base IS NULL AND poster_path = '/p11.jpg' THEN 'error' WHEN poster_path IS NULL OR poster_path = '/p9.jpg' OR c.base = '-' THEN 'no_poster' ELSE 'done' END AS status,
  CASE WHEN r.tmdb_id % 10 <> 3 AND c.base IS NULL AND poster_path = '/p11.jpg' THEN 'broken' END AS error, r.tmdb_id % 10 <> 3 AND c.pair IS NOT NULL AS cached,
  CASE WHEN r.tmdb_id % 10 <> 3 AND poster_path <> '/p9.jpg' AND (c.base IS NOT NULL OR poster_path <> '/p11.jpg') THEN nullif(coalesce(c.base, {_CODE}), '-') END AS base_hex
  FROM ranked r LEFT JOIN cache c ON c.pair = poster_path || '|' || coalesce(logo_path, '') AND poster_path <> '/p9.jpg' WHERE rank <= 400 AND {_OPEN}""")
def refresh_outcomes(spark, d):
    """The queue's outcomes: titles without details aren't found, a poster that can't be decoded is an error; each pair of
    poster and logo is coloured once, and not at all if the cache has it."""
    t = titles(spark, d)
    details = t.where("tmdb_id % 10 <> 3").select("media_type", "tmdb_id", "title", "adult", "poster_path", "logo_path")
    code = F.concat(F.lit("#"), F.upper(F.substring(F.md5("pair"), 1, 6)))
    cache = catalogue.palette_cache(t.where("coalesce(poster_path, '') <> '/p9.jpg'"))
    failed = F.when(F.col("poster_path") == "/p11.jpg", "broken").alias("error")
    found = refresh.outcomes(ranking.work_queue(t, top=400), details, lambda p: p.where("poster_path <> '/p9.jpg'").select("pair", *[code.alias(r) for r in ROLES], failed), cache)
    known = cache.select("pair", F.lit(True).alias("cached"))
    pair = text.pair_key(F.col("d.poster_path"), F.col("d.logo_path"))
    marked = found.alias("f").join(details.alias("d"), ["media_type", "tmdb_id"], "left").join(known, pair == F.col("pair"), "left")
    return marked.select("media_type", "tmdb_id", "f.status", "f.error", F.coalesce("cached", F.lit(False)).alias("cached"), "f.base_hex")


@query(_T + " SELECT media_type, tmdb_id, title, CASE WHEN tmdb_id = 42 AND media_type = 'movie' THEN 1 ELSE 0 END AS found FROM titles WHERE media_type = 'movie' AND tmdb_id = 42")
def title_by_key(spark, d):
    return search.get(titles(spark, d), "movie", 42).select("media_type", "tmdb_id", "title", F.lit(1).alias("found"))


@query(_T + f", {_DIRTY} SELECT count(*) AS remaining FROM tvdb t WHERE dirty = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.kind = t.kind AND d.tvdb_id = t.tvdb_id)")
def export_remaining(spark, d):
    x = tvdb(spark, d)
    return catalogue.acknowledge(x, catalogue.export_batches(x, 700)).where("dirty = 1").agg(F.count("*").alias("remaining"))


@query(_T + " SELECT media_type, tmdb_id, title, CAST(NULL AS VARCHAR) AS accent_hex, status FROM titles")
def migrated_table(spark, d):
    """A table from before some columns were added."""
    store = Store(spark, new_folder(spark, "store"))
    store.write("titles", titles(spark, d).drop("accent_hex", "logo_path"))
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "title", "accent_hex", "status")


@query("SELECT c_mktsegment AS key, CAST(max(c_custkey) AS VARCHAR) AS value FROM customer GROUP BY 1")
def state_values(spark, d):
    """Each key is set twice; the last value stays."""
    x = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.min("c_custkey").cast("string").alias("lo"), F.max("c_custkey").cast("string").alias("hi"))
    state = x.select("key", F.col("lo").alias("value"))
    for r in x.orderBy("key").collect():  # five segments
        state = catalogue.set_state(state, r.key, r.hi)
    return state


# ---------------------------------------------------------------- sources


@query("""WITH u AS (SELECT user_id, min(CAST(ts AS DATE)) AS a FROM events GROUP BY 1), w AS (SELECT user_id, unnest(generate_series(a, DATE '2024-03-01' - INTERVAL 1 DAY, INTERVAL 14 DAY)) AS s FROM u)
  SELECT user_id, CAST(s AS DATE) AS window_start, least(CAST(s + INTERVAL 14 DAY AS DATE), DATE '2024-03-01') AS window_end FROM w""")
def change_windows(spark, d):
    first = table(spark, d, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("a"))
    x = first.select("user_id", F.explode(listings.windows_of(F.col("a"), F.to_date(F.lit("2024-03-01")))).alias("w"))
    return x.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query("SELECT DISTINCT 'movie' AS media_type, user_id AS tmdb_id FROM events WHERE user_id <> 0")
def change_ids(spark, d):
    pages = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(F.struct(F.col("user_id").alias("id"))).alias("results"))
    return listings.changed_ids(pages, "movie")


_LOGO_ROWS = "(SELECT o_custkey AS id, o_orderkey AS place, '/' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN '.SVG' ELSE '.PNG' END AS path, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'de' END AS lang, floor(o_totalprice / 50000) AS vote, CAST(o_orderkey % 5 AS INT) AS width FROM orders)"


@query(f"SELECT id, path AS logo FROM {_LOGO_ROWS} t WHERE lower(path) LIKE '%.png' QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END, vote DESC, width DESC, place) = 1")
def logo_pick_a(spark, d):
    x = spark.sql(_LOGO_ROWS.replace("FROM orders", "FROM {orders}")[1:-1], orders=table(spark, d, "orders"))
    best = F.min(logos.logo_order(F.col("path"), F.col("lang"), F.col("vote").cast("double"), F.col("width"), F.col("place")))
    return x.groupBy("id").agg(best.alias("b")).where("b IS NOT NULL").select("id", F.col("b.path").alias("logo"))


@query(f"SELECT id, path AS logo FROM {_LOGO_ROWS} t WHERE lower(path) LIKE '%.png' AND place // 16 = id QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END, vote DESC, width DESC, place) = 1".replace("id, path", "place // 16 AS id, path").replace("place // 16 = id", "true").replace("PARTITION BY id", "PARTITION BY place // 16"))
def logo_pick_array(spark, d):
    """The choice within one document's array of logos: 16 orders in a row are a document."""
    x = spark.sql(_LOGO_ROWS.replace("FROM orders", "FROM {orders}")[1:-1], orders=table(spark, d, "orders"))
    item = F.struct("place", F.col("path").alias("file_path"), F.col("lang").alias("iso_639_1"), F.col("vote").cast("double").alias("vote_average"), "width")
    docs = x.groupBy(F.floor(F.col("place") / 16).alias("id")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return docs.select("id", logos.best_logo(F.col("l")).alias("logo")).where("logo IS NOT NULL")


@query(f"SELECT id, path AS logo FROM {_LOGO_ROWS} t WHERE width IN (1, 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END, vote DESC, place) = 1")
def logo_pick_b(spark, d):
    x = spark.sql(_LOGO_ROWS.replace("FROM orders", "FROM {orders}")[1:-1], orders=table(spark, d, "orders"))
    language = F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang"))
    best = F.min(logos.artwork_order(F.col("path"), F.col("width"), F.array(F.lit(1), F.lit(3)), language, F.col("vote").cast("double"), F.col("place")))
    return x.groupBy("id").agg(best.alias("b")).where("b IS NOT NULL").select("id", F.col("b.image").alias("logo"))


@query("SELECT r_name AS \"recordType\", list(n_nationkey ORDER BY n_nationkey)::VARCHAR AS types FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1")
def logo_types(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Clear Logo "), "n_name")).otherwise(F.col("n_name"))
    types = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), name.alias("name"), F.lit("x").alias("slug"), F.col("r_name").alias("recordType"))
    return logos.logo_types(types).select("recordType", F.concat(F.lit("["), F.array_join(F.col("types").cast("array<string>"), ", "), F.lit("]")).alias("types"))


@query("SELECT 'movie' AS media_type, c_custkey AS tmdb_id, c_name AS title, CAST(c_custkey % 2 AS INT) AS adult, c_acctbal AS popularity FROM customer")
def export_parse(spark, d):
    """A daily export that is three days old, written, found by its name and read."""
    folder = new_folder(spark, "exports")
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("original_title"), F.when(F.col("c_custkey") % 2 == 1, True).alias("adult"), F.col("c_acctbal").alias("popularity"))
    x.write.option("compression", "gzip").json(f"{folder}/movie_ids_02_26_2024.json.gz")
    x.limit(1).write.option("compression", "gzip").json(f"{folder}/movie_ids_02_20_2024.json.gz")
    path = listings.locate_export(spark, folder, "movie", date(2024, 2, 29))
    return listings.read_export(spark, path, "movie").drop("ordinal")


@query("SELECT 'tv' AS media_type, s_suppkey AS tmdb_id, s_name AS title, CAST(s_suppkey % 2 AS INT) AS adult, '/p' AS poster_path, CASE WHEN s_suppkey % 3 = 0 THEN '/c.png' ELSE '/b.PNG' END AS logo_path FROM supplier")
def title_details(spark, d):
    folder = new_folder(spark, "details")
    logo = lambda path, lang, vote: F.struct(F.lit(path).alias("file_path"), F.lit(lang).cast("string").alias("iso_639_1"), F.lit(vote).alias("vote_average"), F.lit(100).alias("width"))
    some = F.when(F.col("s_suppkey") % 3 == 0, F.array(logo("/a.svg", "en", 9.0), logo("/b.PNG", None, 8.0), logo("/c.png", "en", 1.0))).otherwise(F.array(logo("/b.PNG", None, 8.0), logo("/d.png", "de", 9.0)))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("").alias("title"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 1).alias("adult"), F.lit("/p").alias("poster_path"), F.struct(some.alias("logos")).alias("images"))
    x.write.json(f"{folder}/tv")
    return listings.read_details(spark, f"{folder}/tv", "tv", lines=True)


@query("SELECT 'series' AS kind, s_suppkey AS tvdb_id, s_name AS title, s_acctbal AS score, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://a.test/i/' || CAST(s_suppkey AS VARCHAR) ELSE 'http://b/x.jpg' END AS image FROM supplier WHERE s_suppkey <> 0")
def paged_listing(spark, d):
    """Pages of 50 titles, some without an id; the last has no next one."""
    folder = new_folder(spark, "listing")
    x = table(spark, d, "supplier").withColumn("page", F.floor(F.col("s_suppkey") / 50))
    image = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("i/"), F.col("s_suppkey").cast("string"))).when(F.col("s_suppkey") % 3 == 2, "http://b/x.jpg")
    item = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), image.alias("image"))
    last = F.lit(x.agg(F.max("page")).first()[0])
    pages = x.groupBy("page").agg(F.collect_list(item).alias("data"))
    pages = pages.select(F.concat("data", F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit("?").alias("name"), F.lit(0.0).alias("score"), F.lit("x").alias("image")))).alias("data"), F.struct(F.when(F.col("page") < last, "more").alias("next")).alias("links"))
    pages.write.json(f"{folder}/series")
    return listings.read_listing(spark, f"{folder}/series", "series", "https://a.test", lines=True)


@query("""SELECT id, 'https://a.test/' || CAST(place AS VARCHAR) AS logo FROM (SELECT l_orderkey AS id, l_linenumber AS place, l_quantity AS score FROM lineitem WHERE l_linenumber % 2 = 1) t QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, place) = 1""")
def artworks_logo(spark, d):
    """Both shapes of artwork documents, here those of series; artworks in another language aren't offered for them."""
    folder = new_folder(spark, "artworks")
    x = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 1, 23).otherwise(2)
    art = F.struct(F.col("l_linenumber").alias("place"), kind.alias("type"), F.lit("eng").alias("language"), F.col("l_quantity").alias("score"), F.col("l_linenumber").cast("string").alias("image"))
    other = F.struct(F.lit(99).alias("place"), F.lit(23).alias("type"), F.lit("spa").alias("language"), F.lit(999.0).alias("score"), F.lit("spa").alias("image"))
    docs = x.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(art)).alias("a"))  # an order has a few lines
    docs = docs.select(F.struct("id", F.transform(F.concat("a", F.array(other)), lambda z: F.struct(z["type"].alias("type"), z.language.alias("language"), z.score.alias("score"), z.image.alias("image"))).alias("artworks")).alias("data"))
    docs.write.json(f"{folder}/series")
    docs.limit(1).write.json(f"{folder}/movie")
    types = spark.createDataFrame([(2, "Poster", None, "series"), (23, "Clear Logo", None, "series"), (25, "ClearLogo", None, "movie")], schemas.ARTWORK_TYPES)
    arts = listings.read_artworks(spark, f"{folder}/series", f"{folder}/movie", lines=True).where("kind = 'series'")
    return listings.logos_of(arts, types, "series", "https://a.test").where("logo IS NOT NULL")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 's' || CAST(page_id AS VARCHAR) ELSE 'f' || CAST(page_id AS VARCHAR) END AS content FROM pages WHERE page_id % 6 <> 5""")
def thumbnail_first(spark, d):
    """Even pages have a small file, all but some a full one."""
    x = table(spark, d, "pages").select("page_id")
    keys = x.select(F.col("page_id").alias("key"), F.concat(F.lit("/x/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("url"))
    keys = keys.withColumn("thumbnail", text.thumbnail_url(F.col("url")))
    name = lambda mark, end: F.struct(F.concat(F.lit("/x/"), F.col("page_id").cast("string"), F.lit(end)).alias("path"), F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("content"))
    files = x.select(F.explode(F.filter(F.array(F.when(F.col("page_id") % 2 == 0, name("s", "_t.jpg")), F.when(F.col("page_id") % 3 != 2, name("f", ".jpg"))), lambda z: z.isNotNull())).alias("f")).select("f.*")
    found = listings.thumbnail_or_full(keys, files).where("content IS NOT NULL")
    return found.select(F.col("key").alias("page_id"), "content")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 't' END AS title, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE page_id % 4 = 2 END AS flag, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS parts FROM pages""")
def text_rules(spark, d):
    p = F.col("page_id")
    title = text.title_or_name(F.when(p % 3 == 0, F.when(p % 2 == 0, "")).otherwise("t"), F.col("url"))
    flag = text.is_true(F.when(p % 4 == 0, " On ").when(p % 4 == 1, "no").when(p % 8 == 2, ""), True)
    flag = F.when(p % 4 == 3, text.is_true(F.lit(None).cast("string"), False)).otherwise(flag)
    return table(spark, d, "pages").select("page_id", title.alias("title"), flag.alias("flag"), F.array_join(text.csv_set(F.when(p % 2 == 0, " a,, b,a ").otherwise(" ,")), "|").alias("parts"))


_PATH = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN url WHEN 3 THEN '/b/' || CAST(page_id AS STRING) || '.jpg' ELSE 'b/' || CAST(page_id AS STRING) END"


@query(f"SELECT page_id, CASE WHEN p IS NULL OR p = '' THEN NULL WHEN p LIKE 'http%' THEN p WHEN p LIKE '/%' THEN 'https://a.test' || p ELSE 'https://a.test/' || p END AS absolute FROM (SELECT page_id, {_PATH} AS p FROM pages) x")
def url_absolute(spark, d):
    return table(spark, d, "pages").select("page_id", text.absolute_url(F.expr(_PATH), "https://a.test").alias("absolute"))


@query(r"SELECT page_id, regexp_replace(url, '^(.*)\.([^./]*)$', '\1_t.\2') AS thumbnail FROM pages")
def url_thumbnail(spark, d):
    return table(spark, d, "pages").select("page_id", text.thumbnail_url(F.col("url")).alias("thumbnail"))


# ---------------------------------------------------------------- colour functions

_RGB = "rgb AS (SELECT l_orderkey, l_linenumber, CAST((l_quantity * 5) % 256 AS INT) AS r, CAST((l_discount * 2500) % 256 AS INT) AS g, CAST(floor(l_extendedprice) % 256 AS INT) AS b FROM lineitem)"
_LIN = ", lin AS (SELECT *, " + ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS {c}l" for c in "rgb") + " FROM rgb)"
_LMS = ", lms AS (SELECT *, " + ", ".join(f"cbrt({m[0]}::DOUBLE * rl + {m[1]}::DOUBLE * gl + {m[2]}::DOUBLE * bl) AS {k}" for k, m in zip(("l_", "m_", "s_"), colour.RGB_TO_LMS)) + " FROM lin)"
_OK = ", ok AS (SELECT *, " + ", ".join(f"{m[0]}::DOUBLE * l_ + {m[1]}::DOUBLE * m_ + {m[2]}::DOUBLE * s_ AS {k}" for k, m in zip(("okl", "oka", "okb"), colour.LMS_TO_LAB)) + " FROM lms)"
_KEY = ["l_orderkey", "l_linenumber"]


def _rgb(spark, d):
    return spark.sql(f"SELECT * FROM ({_RGB[8:-1].replace('FROM lineitem', 'FROM {lineitem}')}) x", lineitem=table(spark, d, "lineitem"))


def _ok(spark, d):
    return _rgb(spark, d).withColumns(dict(zip(("okl", "oka", "okb"), colour.oklab(F.col("r"), F.col("g"), F.col("b")))))


def _r6(*names: str) -> list:
    return [(F.round(n, 5) + 0.0).alias(n) for n in names]


_S6 = lambda *names: ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in names)


@query(f"WITH {_RGB} SELECT l_orderkey, l_linenumber, printf('#%02X%02X%02X', r, g, b) AS hex FROM rgb")
def hex_encode(spark, d):
    return _rgb(spark, d).select(*_KEY, colour.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query(f"WITH {_RGB} SELECT l_orderkey, l_linenumber, r, g, b FROM rgb")
def hex_decode(spark, d):
    x = _rgb(spark, d).withColumn("hex", colour.to_hex(F.col("r"), F.col("g"), F.col("b")))
    return x.select(*_KEY, *[c.alias(n) for n, c in zip("rgb", colour.from_hex(F.col("hex")))])


@query(f"WITH {_RGB}{_LIN}{_LMS}{_OK} SELECT l_orderkey, l_linenumber, {_S6('okl', 'oka', 'okb')} FROM ok")
def srgb_to_oklab(spark, d):
    return _ok(spark, d).select(*_KEY, *_r6("okl", "oka", "okb"))


@query(f"WITH {_RGB} SELECT l_orderkey, l_linenumber, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM rgb")
def oklab_to_srgb(spark, d):
    back = colour.oklab_to_rgb(F.col("okl"), F.col("oka"), F.col("okb"))
    return _ok(spark, d).select(*_KEY, *[(F.round(c, 3) + 0.0).alias(n) for n, c in zip("rgb", back)])


_F = lambda m, w: (lambda x: f"CASE WHEN {x} > 216 / 24389.0::DOUBLE THEN cbrt({x}) ELSE (24389 / 27.0::DOUBLE * {x} + 16) / 116 END")(f"(({m[0]}::DOUBLE * rl + {m[1]}::DOUBLE * gl + {m[2]}::DOUBLE * bl) / {w}::DOUBLE)")


@query(f"WITH {_RGB}{_LIN}, f AS (SELECT *, " + ", ".join(f"{_F(m, w)} AS f{k}" for k, (m, w) in enumerate(zip(colour.RGB_TO_XYZ, colour.WHITE))) + " FROM lin) SELECT l_orderkey, l_linenumber, round(116 * f1 - 16, 4) + 0.0 AS lab_l, round(500 * (f0 - f1), 4) + 0.0 AS lab_a, round(200 * (f1 - f2), 4) + 0.0 AS lab_b FROM f")
def srgb_to_cielab(spark, d):
    lab = colour.cielab(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, d).select(*_KEY, *[(F.round(c, 4) + 0.0).alias(n) for n, c in zip(("lab_l", "lab_a", "lab_b"), lab)])


_HUE = "((degrees(atan2(okb, oka)) % 360) + 360) % 360"


@query(f"WITH {_RGB}{_LIN}{_LMS}{_OK} SELECT l_orderkey, l_linenumber, round(sqrt(oka * oka + okb * okb), 5) AS chroma, CASE WHEN sqrt(oka * oka + okb * okb) > 0.01 THEN round({_HUE}, 3) END AS hue FROM ok")
def hue_chroma(spark, d):
    c = colour.chroma(F.col("oka"), F.col("okb"))
    return _ok(spark, d).select(*_KEY, F.round(c, 5).alias("chroma"), F.when(c > 0.01, F.round(colour.hue(F.col("oka"), F.col("okb")), 3)).alias("hue"))


@query("SELECT l_orderkey, l_linenumber, least(abs(h1 - h2) % 360, 360 - abs(h1 - h2) % 360) AS gap FROM (SELECT *, CAST((l_orderkey * 7) % 360 AS DOUBLE) AS h1, CAST((l_partkey * 13) % 360 AS DOUBLE) AS h2 FROM lineitem) t")
def hue_distance(spark, d):
    h1, h2 = ((F.col("l_orderkey") * 7) % 360).cast("double"), ((F.col("l_partkey") * 13) % 360).cast("double")
    return table(spark, d, "lineitem").select(*_KEY, colour.hue_gap(h1, h2).alias("gap"))


_RAMP = lambda x, lo, hi: f"(CASE WHEN {x} <= {lo} THEN 0.0 WHEN {x} >= {hi} THEN 1.0 ELSE pow(({x} - {lo}) / ({hi} - {lo}), 2) * (3 - 2 * (({x} - {lo}) / ({hi} - {lo}))) END)::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, round({_RAMP('(l_quantity / 50)::DOUBLE', '0.2::DOUBLE', '0.8::DOUBLE')}, 6) AS t FROM lineitem")
def smoothstep(spark, d):
    return table(spark, d, "lineitem").select(*_KEY, F.round(colour.ramp(F.col("l_quantity") / 50, 0.2, 0.8), 6).alias("t"))


@query(f"WITH {_RGB}{_LIN}{_LMS}{_OK} SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) ELSE 0 END * {_RAMP('okl', '0.12::DOUBLE', '0.30::DOUBLE')}, 5) AS saturation FROM ok")
def saturation(spark, d):
    return _ok(spark, d).select(*_KEY, F.round(colour.saturation(F.col("r"), F.col("g"), F.col("b"), F.col("okl")), 5).alias("saturation"))


_N = f"WITH {_RGB}{_LIN}{_LMS}{_OK}, n AS (SELECT *, sqrt(oka * oka + okb * okb) AS c, {_HUE} AS h FROM ok)"
_GREY = f"(1 - {_RAMP('c', '0.025::DOUBLE', '0.06::DOUBLE')})"


@query(_N + f" SELECT l_orderkey, l_linenumber, round({_GREY}, 4) AS grey, round(1 - {_RAMP('okl', '0.20::DOUBLE', '0.34::DOUBLE')}, 4) AS dark, round({_RAMP('okl', '0.88::DOUBLE', '0.96::DOUBLE')}, 4) AS light, round(CASE WHEN h BETWEEN 30 AND 100 THEN 1 ELSE 0 END * (1 - {_RAMP('c', '0.05::DOUBLE', '0.10::DOUBLE')}) * (1 - {_GREY}), 4) AS brown FROM n")
def neutral_parts(spark, d):
    x = _ok(spark, d)
    parts = colour.neutral_parts(F.col("okl"), colour.chroma(F.col("oka"), F.col("okb")), colour.hue(F.col("oka"), F.col("okb")))
    return x.select(*_KEY, *[F.round(c, 4).alias(k) for k, c in parts.items()])


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN least(l_discount, l_tax) < 0.05 THEN 0 ELSE 1 - " + _RAMP("least(abs(h1 - h2) % 360, 360 - abs(h1 - h2) % 360)", "15.0::DOUBLE", "45.0::DOUBLE") + " END, 5) AS alike FROM (SELECT *, CAST((l_orderkey * 7) % 360 AS DOUBLE) AS h1, CAST((l_partkey * 13) % 360 AS DOUBLE) AS h2 FROM lineitem) t")
def same_hue(spark, d):
    h1, h2 = ((F.col("l_orderkey") * 7) % 360).cast("double"), ((F.col("l_partkey") * 13) % 360).cast("double")
    return table(spark, d, "lineitem").select(*_KEY, F.round(colour.same_hue(F.col("l_discount"), h1, F.col("l_tax"), h2), 5).alias("alike"))


_LUM = " + ".join(f"{w} * (CASE WHEN {c} / 255.0::DOUBLE <= 0.03928 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)" for c, w in (("r", 0.2126), ("g", 0.7152), ("b", 0.0722)))


@query(f"WITH {_RGB} SELECT l_orderkey, l_linenumber, CASE WHEN {_LUM} > 0.4 THEN '#111111' ELSE '#FFFFFF' END AS ink FROM rgb")
def readable_text_colour(spark, d):
    return _rgb(spark, d).select(*_KEY, colour.readable_text(colour.to_hex(F.col("r"), F.col("g"), F.col("b"))).alias("ink"))


# ---------------------------------------------------------------- pixels
# clusters of the oracle-able queries are a coarse label; those of the palettes are k-means

_LBL = ", lb AS (SELECT *, CAST(floor(r / 100) AS INT) * 4 + CAST(floor(g / 128) AS INT) AS label FROM px)"
_LOK = _LBL + _LIN.replace(", lin AS", ", lin AS").replace("FROM rgb", "FROM lb") + _LMS + _OK


def _labelled(spark, d):
    x = pixels.with_oklab(pixel_table(spark, d))
    return x.withColumn("label", (F.floor(F.col("r") / 100) * 4 + F.floor(F.col("g") / 128)).cast("int"))


def _gridded(spark, d):
    return pixels.on_grid(_labelled(spark, d))


@query(_T + _LOK + " SELECT poster, label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY poster), 6) AS share, round(avg(sqrt(oka * oka + okb * okb)), 5) AS chroma, round(avg(okl), 5) AS lightness, round(stddev_pop(okl), 5) AS lightness_std FROM ok GROUP BY poster, label")
def pixel_coverage(spark, d):
    return pixels.coverage(_labelled(spark, d)).select("poster", "label", "n", F.round("share", 6).alias("share"), *[F.round(c, 5).alias(c) for c in ("chroma", "lightness", "lightness_std")])


_SIZE = ", sz AS (SELECT poster, max(y) + 1 AS h, max(x) + 1 AS w FROM lb GROUP BY 1)"
_CW = "1.0 - 0.3 * least(greatest((pow((x - (w - 1) / 2.0::DOUBLE) / (w / 2.0::DOUBLE), 2) + pow((y - (h - 1) / 2.0::DOUBLE) / (h / 2.0::DOUBLE), 2)) / 2, 0.0), 1.0)"


@query(_T + _LBL + _SIZE + f" SELECT poster, label, round(sum({_CW}) / sum(sum({_CW})) OVER (PARTITION BY poster), 5) AS salient FROM lb JOIN sz USING (poster) GROUP BY poster, label")
def centre_weighted_coverage(spark, d):
    return pixels.centred_share(_gridded(spark, d)).select("poster", "label", F.round("salient", 5).alias("salient"))


@query(_T + _LBL + _SIZE + """, c AS (SELECT poster, label, (SELECT max(k) FROM generate_series(0, 5) t(k) WHERE k * h // 6 <= y) AS cy, (SELECT max(k) FROM generate_series(0, 3) t(k) WHERE k * w // 4 <= x) AS cx FROM lb JOIN sz USING (poster)),
  n AS (SELECT poster, label, cy, cx, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY poster, cy, cx) AS share FROM c GROUP BY 1, 2, 3, 4) SELECT poster, label, round(count(*) FILTER (share >= 0.08) / 24.0, 6)::DOUBLE AS spatial FROM n GROUP BY 1, 2""")
def grid_presence(spark, d):
    return pixels.grid_presence(_gridded(spark, d)).select("poster", "label", F.round("spatial", 6).alias("spatial"))


_NB = ", nb AS (SELECT a.poster, a.label AS l1, b.label AS l2 FROM lb a JOIN lb b ON a.poster = b.poster AND (a.y = b.y AND b.x = a.x + 1 OR a.x = b.x AND b.y = a.y + 1)), both_ AS (SELECT poster, l1, l2 FROM nb UNION ALL SELECT poster, l2, l1 FROM nb WHERE l1 <> l2)"


@query(_T + _LOK + _NB + """, ce AS (SELECT poster, label, avg(okl) AS cl, avg(oka) AS ca, avg(okb) AS cb FROM ok GROUP BY 1, 2)
  SELECT c.poster, c.label, round(coalesce(avg(sqrt(pow(c.cl - o.cl, 2) + pow(c.ca - o.ca, 2) + pow(c.cb - o.cb, 2))), 0), 5) AS contrast FROM ce c LEFT JOIN (SELECT * FROM both_ WHERE l1 <> l2) e ON e.poster = c.poster AND e.l1 = c.label LEFT JOIN ce o ON o.poster = e.poster AND o.label = e.l2 GROUP BY 1, 2""")
def neighbour_contrast(spark, d):
    x = _gridded(spark, d)
    return pixels.neighbour_contrast(x, pixels.centres(x)).select("poster", "label", F.round("contrast", 5).alias("contrast"))


@query(_T + _LBL + _NB + " SELECT poster, l1 AS label, round(count(*) FILTER (l1 = l2)::DOUBLE / count(*), 6) AS coherence FROM both_ GROUP BY 1, 2")
def coherence(spark, d):
    return pixels.coherence(_gridded(spark, d)).select("poster", "label", F.round("coherence", 6).alias("coherence"))


@query(_T + _LOK + ", ce AS (SELECT poster, label, avg(okl) AS cl, avg(oka) AS ca, avg(okb) AS cb FROM ok GROUP BY 1, 2) SELECT a.poster, a.label, b.label AS other, round(sqrt(pow(a.cl - b.cl, 2) + pow(a.ca - b.ca, 2) + pow(a.cb - b.cb, 2)), 5) AS distance FROM ce a JOIN ce b ON a.poster = b.poster AND a.label < b.label")
def cluster_distance_table(spark, d):
    return pixels.centre_distances(pixels.centres(_labelled(spark, d))).select("poster", "label", "other", F.round("distance", 5).alias("distance"))


# ---------------------------------------------------------------- palettes of coarse labels: the choice has SQL

_LABF = ", f AS (SELECT *, " + ", ".join(f"{_F(m, w)} AS f{k}" for k, (m, w) in enumerate(zip(colour.RGB_TO_XYZ, colour.WHITE))) + " FROM lin)"
_APART = lambda a, b: f"sqrt(pow({a}.l - {b}.l, 2) + pow({a}.a - {b}.a, 2) + pow({a}.b_ - {b}.b_, 2))"
_V1 = _T + _LBL + _LIN.replace("FROM rgb", "FROM lb") + _LABF + f""", c0 AS (SELECT poster, label, count(*) AS n, avg(116 * f1 - 16) AS l, avg(500 * (f0 - f1)) AS a, avg(200 * (f1 - f2)) AS b_, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM f GROUP BY 1, 2),
  c AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY poster) AS share, row_number() OVER (PARTITION BY poster ORDER BY n DESC, label) AS nth FROM c0 QUALIFY nth = 1 OR share >= 0.02),
  two AS (SELECT x.poster, min(x.nth) AS nth FROM c x JOIN c p ON x.poster = p.poster AND p.nth = 1 WHERE {_APART('x', 'p')} >= 15 GROUP BY 1),
  three AS (SELECT x.poster, min(x.nth) AS nth FROM c x JOIN c p ON x.poster = p.poster AND p.nth = 1 JOIN two t ON t.poster = x.poster JOIN c q ON q.poster = x.poster AND q.nth = t.nth WHERE {_APART('x', 'p')} >= 15 AND {_APART('x', 'q')} >= 15 GROUP BY 1),
  o AS (SELECT c.*, row_number() OVER (PARTITION BY c.poster ORDER BY CASE WHEN c.nth = 1 THEN 0 WHEN c.nth = two.nth THEN 1 WHEN c.nth = three.nth THEN 2 ELSE 3 END, c.nth) AS place, count(*) OVER (PARTITION BY c.poster) AS places FROM c LEFT JOIN two USING (poster) LEFT JOIN three USING (poster)),
  w AS (SELECT *, printf('#%02X%02X%02X', CAST(round_even(r, 0) AS INT), CAST(round_even(g, 0) AS INT), CAST(round_even(b, 0) AS INT)) AS hex, round(share, 4) AS ratio FROM o)
  SELECT poster, """ + ", ".join(f"max({k}) FILTER (place = least({i}, places)) AS {n}_{k}" for i, n in enumerate(SLOTS, 1) for k in ("hex", "ratio")) + " FROM w GROUP BY poster"


@query(_V1)
def area_palette_of_labels(spark, d):
    """The first version's choice, clusters being coarse labels."""
    x = _labelled(spark, d)
    return palettes.palette_v1(x.withColumns(dict(zip(pixels.LAB, colour.cielab(F.col("r"), F.col("g"), F.col("b"))))))


_D = lambda x: f"{x}::DOUBLE"
_DOT = lambda m, v: " + ".join(f"{_D(c)} * {x}" for c, x in zip(m, v))
_BACK = ", ".join(f"pow({_DOT(m, ('ll', 'rla', 'rlb'))}, 3) AS {k}3" for k, m in zip("lms", colour.LAB_TO_LMS))
_LINEAR = ", ".join(f"least(greatest({_DOT(m, ('l3', 'm3', 's3'))}, 0), 1) AS {k}_lin" for k, m in zip("rgb", colour.LMS_TO_RGB))
_BYTES = ", ".join(f"least(greatest(255 * CASE WHEN {k}_lin <= 0.0031308 THEN 12.92::DOUBLE * {k}_lin ELSE 1.055::DOUBLE * pow({k}_lin, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 0), 255) AS {k}" for k in "rgb")
_PARTS_SQL = f"""1 - {_RAMP('chroma', '0.025::DOUBLE', '0.06::DOUBLE')} AS grey, 1 - {_RAMP('ll', '0.20::DOUBLE', '0.34::DOUBLE')} AS dark, {_RAMP('ll', '0.88::DOUBLE', '0.96::DOUBLE')} AS light,
  CASE WHEN hue BETWEEN 30 AND 100 THEN 1 ELSE 0 END * (1 - {_RAMP('chroma', '0.05::DOUBLE', '0.10::DOUBLE')}) * {_RAMP('chroma', '0.025::DOUBLE', '0.06::DOUBLE')} AS brown"""
_GAP = lambda a, b: f"sqrt(pow({a}.ll - {b}.ll, 2) + pow({a}.rla - {b}.rla, 2) + pow({a}.rlb - {b}.rlb, 2))"
_ALIKE = lambda a, b: f"CASE WHEN least({a}.chroma, {b}.chroma) < 0.05 THEN 0 ELSE 1 - {_RAMP(f'least(abs({a}.hue - {b}.hue) % 360, 360 - abs({a}.hue - {b}.hue) % 360)', '15.0::DOUBLE', '45.0::DOUBLE')} END"
_TIER = lambda g: f"CASE WHEN {g} >= 0.12 THEN 0 WHEN {g} >= 0.12::DOUBLE * 0.6::DOUBLE THEN 1 WHEN {g} >= 0.12::DOUBLE * 0.3::DOUBLE THEN 2 ELSE 3 END"
_V2 = _T + _LOK + _NB + _SIZE + f""", g0 AS (SELECT poster, label, count(*) AS n, avg(okl) AS ll, avg(oka) AS la, avg(okb) AS lb, avg(sqrt(oka * oka + okb * okb)) AS mc, sum(sqrt(oka * oka + okb * okb)) AS sc FROM ok GROUP BY 1, 2),
  g1 AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY poster) AS coverage, sum(sc) OVER (PARTITION BY poster) / sum(n) OVER (PARTITION BY poster) AS colourful, la * CASE WHEN sqrt(la * la + lb * lb) > 1e-6 THEN mc / sqrt(la * la + lb * lb) ELSE 1 END AS rla, lb * CASE WHEN sqrt(la * la + lb * lb) > 1e-6 THEN mc / sqrt(la * la + lb * lb) ELSE 1 END AS rlb FROM g0),
  sal AS (SELECT poster, label, sum({_CW}) / sum(sum({_CW})) OVER (PARTITION BY poster) AS salient FROM lb JOIN sz USING (poster) GROUP BY poster, label),
  con AS (SELECT e.poster, e.l1 AS label, avg(sqrt(pow(c.ll - o.ll, 2) + pow(c.la - o.la, 2) + pow(c.lb - o.lb, 2))) AS contrast FROM (SELECT * FROM both_ WHERE l1 <> l2) e JOIN g0 c ON c.poster = e.poster AND c.label = e.l1 JOIN g0 o ON o.poster = e.poster AND o.label = e.l2 GROUP BY 1, 2),
  dis AS (SELECT x.poster, x.label, sum(o.coverage * sqrt(pow(x.ll - o.ll, 2) + pow(x.rla - o.la, 2) + pow(x.rlb - o.lb, 2))) / sum(o.coverage) AS dist FROM g1 x JOIN g1 o ON x.poster = o.poster AND x.label <> o.label GROUP BY 1, 2),
  g2 AS (SELECT g1.*, salient, least(coalesce(contrast, 0) / 0.4, 1)::DOUBLE AS contrast, least(coalesce(dist, 0) / 0.4, 1)::DOUBLE AS distinctiveness, sqrt(rla * rla + rlb * rlb) AS chroma, ((degrees(atan2(rlb, rla)) % 360) + 360) % 360 AS hue, {_BACK} FROM g1 JOIN sal USING (poster, label) LEFT JOIN con USING (poster, label) LEFT JOIN dis USING (poster, label)),
  g3 AS (SELECT *, {_LINEAR} FROM g2), g4 AS (SELECT *, {_BYTES} FROM g3),
  g5 AS (SELECT *, printf('#%02X%02X%02X', CAST(round_even(r, 0) AS INT), CAST(round_even(g, 0) AS INT), CAST(round_even(b, 0) AS INT)) AS hex, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END * {_RAMP('ll', '0.12::DOUBLE', '0.30::DOUBLE')} AS saturation, {_PARTS_SQL} FROM g4),
  g6 AS (SELECT *, {_RAMP('colourful', '0.010::DOUBLE', '0.040::DOUBLE')} AS strength, greatest(grey, dark, light, brown) AS neutrality, (1 - 0.7::DOUBLE * grey) * (1 - 0.5::DOUBLE * dark) * (1 - 0.5::DOUBLE * light) * (1 - 0.3::DOUBLE * brown) AS raw FROM g5
    QUALIFY row_number() OVER (PARTITION BY poster ORDER BY coverage DESC, hex) = 1 OR coverage >= 0.015 OR (chroma >= 0.09 AND coverage >= 0.004)),
  k AS (SELECT *, 1 - strength * (1 - raw) AS nf, sqrt(salient / max(salient) OVER (PARTITION BY poster)) AS cov, least(chroma / 0.20, 1)::DOUBLE AS vivid FROM g6),
  p1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY poster ORDER BY (((0.25::DOUBLE + 0.45::DOUBLE * (1 - strength)) * cov + strength * (0.25::DOUBLE * saturation + 0.20::DOUBLE * vivid) + 0.15::DOUBLE * contrast + 0.15::DOUBLE * distinctiveness) * nf
    + 0.45::DOUBLE * neutrality * {_RAMP('coverage', '0.30::DOUBLE', '0.65::DOUBLE')} * (1 - {_RAMP('colourful', '0.020::DOUBLE', '0.050::DOUBLE')})) * {_RAMP('coverage', '0.008::DOUBLE', '0.035::DOUBLE')} DESC, coverage DESC, hex DESC) = 1),
  p2 AS (SELECT k.* FROM k JOIN p1 USING (poster) WHERE k.label <> p1.label QUALIFY row_number() OVER (PARTITION BY k.poster ORDER BY {_TIER(_GAP('k', 'p1'))}, (0.50::DOUBLE * k.cov + 0.20::DOUBLE * least({_GAP('k', 'p1')} / 0.5, 1) + 0.15::DOUBLE * k.saturation + 0.15::DOUBLE * k.vivid) * (1 - 0.5::DOUBLE * (1 - k.nf)) * (1 - 0.40::DOUBLE * ({_ALIKE('k', 'p1')})) DESC, k.coverage DESC, k.hex DESC) = 1),
  q2 AS (SELECT * FROM p2 UNION ALL SELECT * FROM p1 WHERE poster NOT IN (SELECT poster FROM p2)),
  p3 AS (SELECT k.* FROM k JOIN p1 USING (poster) JOIN q2 USING (poster) WHERE k.label <> p1.label AND k.label <> q2.label QUALIFY row_number() OVER (PARTITION BY k.poster ORDER BY {_TIER(f"least({_GAP('k', 'p1')}, {_GAP('k', 'q2')})")},
    (0.30::DOUBLE * (least({_GAP('k', 'p1')} / 0.5, 1) + least({_GAP('k', 'q2')} / 0.5, 1)) + 0.20::DOUBLE * k.saturation + 0.20::DOUBLE * k.cov) * (1 - 0.40::DOUBLE * greatest({_ALIKE('k', 'p1')}, {_ALIKE('k', 'q2')})) DESC, k.coverage DESC, k.hex DESC) = 1),
  q3 AS (SELECT * FROM p3 UNION ALL SELECT * FROM q2 WHERE poster NOT IN (SELECT poster FROM p3))"""


@query(_V2 + " SELECT p1.poster, p1.hex AS primary_hex, q2.hex AS secondary_hex, q3.hex AS tertiary_hex, round(p1.coverage, 4) AS primary_ratio, round(q2.coverage, 4) AS secondary_ratio, round(q3.coverage, 4) AS tertiary_ratio FROM p1 JOIN q2 USING (poster) JOIN q3 USING (poster)")
def role_palette_of_labels(spark, d):
    """The second version's choice, clusters being coarse labels."""
    return _v2(palettes.palette_v2(_gridded(spark, d)))


_HEXLAB = "hx AS (SELECT poster, nth, " + ", ".join(f"CAST('0x' || substr(hex, {i}, 2) AS INT) AS {c}" for i, c in ((2, "r"), (4, "g"), (6, "b"))) + " FROM (SELECT poster, 1 AS nth, hex FROM p1 UNION ALL SELECT poster, 2, hex FROM q2 UNION ALL SELECT poster, 3, hex FROM q3) t)"
_HEXOK = (_LIN + _LMS + _OK).replace("lin AS", "hlin AS").replace("FROM rgb", "FROM hx").replace("lms AS", "hlms AS").replace("FROM lin", "FROM hlin").replace(", ok AS", ", hok AS").replace("FROM lms", "FROM hlms")
_LIGHT = "sum(greatest(round(coverage, 4), 1e-6::DOUBLE) * okl) / sum(greatest(round(coverage, 4), 1e-6::DOUBLE))"


@query(_V2 + ", " + _HEXLAB + _HEXOK + f""", near AS (SELECT a.poster, min(sqrt(pow(a.okl - b.okl, 2) + pow(a.oka - b.oka, 2) + pow(a.okb - b.okb, 2))) AS d FROM hok a JOIN hok b ON a.poster = b.poster AND a.nth < b.nth GROUP BY 1),
  cv AS (SELECT poster, 1 AS nth, coverage FROM p1 UNION ALL SELECT poster, 2, coverage FROM q2 UNION ALL SELECT poster, 3, coverage FROM q3),
  li AS (SELECT poster, {_LIGHT} AS l FROM hok JOIN cv USING (poster, nth) GROUP BY 1), me AS (SELECT poster, avg(okl) AS l FROM ok GROUP BY 1)
  SELECT p1.poster, concat_ws(',', CASE WHEN near.d < 0.08 THEN 'similar' END, CASE WHEN p1.neutrality > 0.6 AND EXISTS (SELECT 1 FROM k WHERE k.poster = p1.poster AND k.label <> p1.label AND k.chroma >= 0.12 AND k.coverage >= 0.05) THEN 'neutral_over_accent' END,
    CASE WHEN p1.chroma >= 0.12 AND p1.coverage < 0.05 THEN 'speck' END, CASE WHEN abs(me.l - li.l) > 0.22 THEN 'lightness_drift' END) AS flags FROM p1 JOIN near USING (poster) JOIN li USING (poster) JOIN me USING (poster)""")
def review_flags_of_labels(spark, d):
    """What looks wrong about the second version's choice of coarse labels."""
    return palettes.review_flags(None, _gridded(spark, d)).select("poster", F.array_join("flags", ",").alias("flags"))


# ---------------------------------------------------------------- palettes: clustering has no SQL


#: A logo for each poster, from other columns of the same rows; a third of it is clear.
LOGOS = """
SELECT poster, CAST(floor(nth / 10) AS INT) AS y, CAST(nth % 10 AS INT) AS x, r, g, b, alpha FROM (
  SELECT l_partkey AS poster, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS nth,
    CAST((l_tax * 3000) % 256 AS INT) AS r, CAST((l_quantity * 5) % 128 AS INT) AS g, CAST(floor(l_extendedprice / 9) % 256 AS INT) AS b, CASE WHEN l_linenumber % 3 = 0 THEN 90 ELSE 255 END AS alpha FROM {lineitem}) p
"""


def _clustered(spark, d, how, space="oklab"):
    return clusters.cluster(pixels.sampled(pixel_table(spark, d), 60, 90, by_poster=True), how, space)


def _summed(spark, d, how, space="oklab", logo=None):
    """Posters in one row each, from the one shuffle of their pixels."""
    return summaries.clustered_as(pixels.sampled(pixel_table(spark, d), 60, 90, by_poster=True), how, space, logo)


def _logo_queue(spark, d):
    p = pixels.sampled(pixel_table(spark, d), 80, 120, by_poster=True)
    logo = pixels.sampled(_by_part(spark, d, LOGOS), 300, 300, by_poster=True)
    return roles.logo_colours(summaries.clustered_as(roles.solid(logo), clusters.LOGO), p)


@query()
def kmeans_labels(spark, d):
    return _clustered(spark, d, clusters.V1).select("poster", "y", "x", "label")


@query()
def palette_v1(spark, d):
    return palettes.palette_v1(_summed(spark, d, clusters.V1, "cielab"))


def _v2(p):
    return p.select("poster", *[c for s in SLOTS for c in (F.col(f"{s}_hex"), F.round(f"{s}_coverage", 4).alias(f"{s}_ratio"))])


@query()
def palette_v2(spark, d):
    return _v2(palettes.palette_v2(_summed(spark, d, clusters.V2)))


@query()
def logo_colours(spark, d):
    return _logo_queue(spark, d).select("poster", F.col("logo.hex").alias("colours"))


@query()
def palette_v3(spark, d):
    logo = materialise(_logo_queue(spark, d), "logos", tidy=True)  # at most two colours a poster; the pixels that they took are gone then
    return roles.palette_v3(_summed(spark, d, clusters.V3, logo=logo))


@query()
def review_flags(spark, d):
    return palettes.review_flags(None, _summed(spark, d, clusters.V2))


def _compared(spark, d, third=False):
    """The versions side by side, from one pass over the pixels."""
    kinds = {"one": (clusters.V1, "cielab"), "two": (clusters.V2, "oklab")} | ({"three": (clusters.V3, "oklab")} if third else {})
    x = summaries.clustered(pixels.sampled(pixel_table(spark, d), 60, 90, by_poster=True), kinds)
    more = ["three"] if third else []
    x = palettes.palette_v1(x.select("poster", "one.*", "two", *more), "two", *more).selectExpr("poster", "primary_hex AS v1_primary", "secondary_hex AS v1_secondary", "tertiary_hex AS v1_tertiary", "two.*", *more)
    first = [f"v1_{s}" for s in SLOTS]
    x = palettes.review_flags(None, x, *first, *[f"{s}_hex" for s in SLOTS], *more)
    return x.select("poster", *first, *[F.col(f"{s}_hex").alias(f"v2_{s}") for s in SLOTS], "flags", *more)


@query()
def compare_palettes(spark, d):
    x = _compared(spark, d, third=True)
    two = [c for c in x.columns if c not in ("poster", "three")]
    return roles.palette_v3(x.select("poster", *two, "three.*"), keep=tuple(two)).select("poster", *two, *ROLES)


@query()
def report_summary(spark, d):
    c = _compared(spark, d)
    return c.agg(F.count("*").alias("posters"), F.count_if(F.col("v1_primary") != F.col("v2_primary")).alias("changed"), F.count_if(F.size("flags") > 0).alias("flagged"))


@query(" UNION ALL ".join(f"SELECT '{r}' AS role, {lo}::DOUBLE AS least, {hi}::DOUBLE AS most, (SELECT count(*) FROM (" + TITLES.format(customer="customer", supplier="supplier") + f") t WHERE {r}_hex <> '') AS titles" for r, (lo, hi) in roles.ROLE_WEIGHTS.items()))
def role_weights(spark, d):
    n = titles(spark, d).agg(*[F.count_if(F.col(f"{r}_hex") != "").alias(r) for r in ROLES])
    return n.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(lo).alias("least"), F.lit(hi).alias("most"), F.col(r).alias("titles")) for r, (lo, hi) in roles.ROLE_WEIGHTS.items()])).alias("x")).select("x.*")


@query(_T + " SELECT media_type, tmdb_id, identity1_hex AS primary_hex, base_hex AS secondary_hex, accent_hex AS tertiary_hex, 0.275::DOUBLE AS primary_ratio, 0.45::DOUBLE AS secondary_ratio, 0.055::DOUBLE AS tertiary_ratio FROM titles")
def legacy_triple(spark, d):
    x = titles(spark, d).select("media_type", "tmdb_id", *[F.col(f"{r}_hex").alias(r) for r in ROLES])
    return palettes.legacy_triple(x).select("media_type", "tmdb_id", *[f"{s}_{k}" for k in ("hex", "ratio") for s in SLOTS])


from . import feed_queries  # noqa: E402, F401  they register themselves
