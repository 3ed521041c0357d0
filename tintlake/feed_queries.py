"""Registered queries of feeds, streams and exports, and of what prunes and counts, with their DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .plans import listed, refresh
from .plans.cut import new_folder
from .plans.served import Served
from .plans.store import Store
from .queries import _DIRTY, _OPEN, _PARTS, _RANKED, _RES, _T, _V2, ROLES, TITLE_SCHEMA, TITLES, TVDB_SCHEMA, _gridded, _sql, part_titles, query, table, titles, tvdb
from .operators import catalogue, palettes, postings, roles, tables
from .sources import feeds
from .streaming import jobs

# ---------------------------------------------------------------- sources that check what they read


@query("""SELECT 'movie' AS kind, c_custkey AS tvdb_id, c_name AS title, c_acctbal AS score, CASE WHEN c_custkey % 3 <> 0 THEN 'https://a.test/i/' || CAST(c_custkey AS VARCHAR) END AS image,
  CAST(c_custkey // 100 AS INT) AS page, CAST(row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS INT) AS place FROM customer WHERE c_custkey <> 0""")
def listing_source(spark, d):
    """A listing in pages of 100 titles, read by the source that checks their chain."""
    folder = new_folder(spark, "pages")
    x = table(spark, d, "customer").where("c_custkey <> 0").withColumn("page", F.floor(F.col("c_custkey") / 100))
    last = x.agg(F.max("page")).first()[0]
    image = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("i/"), F.col("c_custkey").cast("string")))
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), image.alias("image"))
    pages = x.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("data"))  # 100 titles each
    pages = pages.withColumn("links", F.struct(F.when(F.col("page") < last, F.concat(F.lit("https://a.test/all?page="), (F.col("page") + 1).cast("string"))).alias("next")))
    pages.write.partitionBy("page").json(f"{folder}/movie")
    place = F.col("ordinal").bitwiseAND((1 << 32) - 1).cast("int").alias("place")
    return feeds.read_pages(spark, f"{folder}/movie", "movie", "https://a.test").select("kind", "tvdb_id", "title", "score", "image", F.shiftright("ordinal", 32).cast("int").alias("page"), place)


@query(_T + """, c AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type, user_id AS tmdb_id FROM events WHERE user_id <> 0)
  SELECT t.media_type, t.tmdb_id, CASE WHEN c.tmdb_id IS NOT NULL AND status <> 'done' THEN 'pending' ELSE status END AS status, CASE WHEN c.tmdb_id IS NOT NULL THEN 0 ELSE attempts END AS attempts,
  CASE WHEN c.tmdb_id IS NOT NULL AND status = 'done' THEN NULL ELSE palette_version END AS palette_version FROM titles t LEFT JOIN c ON t.media_type = c.media_type AND t.tmdb_id = c.tmdb_id""")
def change_feed_stream(spark, d):
    """Events as windows of changes of a week, in pages; they arrive in two parts, each followed by a run of the stream."""
    folder = new_folder(spark, "feed")
    store = Store(spark, f"{folder}/store")
    store.write("titles", titles(spark, d))
    day = F.to_date("ts")
    first = table(spark, d, "events").agg(F.min(day)).first()[0] or date(2024, 1, 1)
    x = table(spark, d, "events").withColumn("week", F.floor(F.date_diff(day, F.lit(first)) / 7).cast("int")).withColumn("page", (F.floor(F.col("event_id") / 1000) % 50 + 1).cast("int"))
    x = x.withColumn("media_type", F.when(F.col("event_id") % 2 == 0, "movie").otherwise("tv"))
    pages = x.groupBy("media_type", "week", "page").agg(F.collect_set("user_id").alias("ids"))
    # pages are numbered without gaps within their window, which says how many it has
    pages = pages.selectExpr("media_type", "week", "ids", "CAST(row_number() OVER (PARTITION BY media_type, week ORDER BY page) AS INT) AS page", "CAST(count(*) OVER (PARTITION BY media_type, week) AS INT) AS total_pages")
    start = F.date_add(F.lit(first), F.col("week") * 7)
    pages = pages.select("media_type", start.cast("string").alias("start"), F.date_add(start, 7).cast("string").alias("end"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("results"), "page", "total_pages", "week")
    for part in (F.col("week") < 2, F.col("week") >= 2):
        pages.where(part).drop("week").repartition("media_type", "start").write.mode("append").partitionBy("media_type", "start", "end").json(f"{folder}/in")
        jobs.follow_change_feed(store, f"{folder}/in", str(first), f"{folder}/checkpoint")
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "status", "attempts", "palette_version")


# ---------------------------------------------------------------- exports by tasks


def refusing_target(options: dict[str, str]) -> feeds.Send:
    """A folder that refuses every third batch."""
    send = feeds.folder_target(options)

    def refuse(name: str, items: str) -> None:
        if int(name.rsplit("-", 1)[1]) % 3 == 1:
            raise RuntimeError("429")
        send(name, items)

    return refuse


_SENT = _DIRTY.replace("rn <= 700", "rn <= 2000")


@query(_T + f", {_SENT} SELECT t.kind, t.tvdb_id, CASE WHEN CAST(floor((rn - 1) / 50) AS BIGINT) % 3 <> 1 THEN 0 ELSE t.dirty END AS dirty FROM tvdb t LEFT JOIN d ON t.kind = d.kind AND t.tvdb_id = d.tvdb_id")
def export_committed(spark, d):
    """Batches of 50 from as many tasks; the target refuses every third, whose titles stay dirty."""
    folder = new_folder(spark, "export")
    store = Store(spark, f"{folder}/store")
    store.write(listed.TABLE, tvdb(spark, d))
    listed.export_from_tasks(store, 2000, 50, tasks=200, sender=f"{__name__}:refusing_target", folder=f"{folder}/out")
    return store.read(listed.TABLE, TVDB_SCHEMA).select("kind", "tvdb_id", "dirty")


@query(_T + f", {_SENT} SELECT kind, tvdb_id, CAST(floor((rn - 1) / 50) AS BIGINT) AS batch FROM d WHERE CAST(floor((rn - 1) / 50) AS BIGINT) % 3 <> 1")
def export_stream_committed(spark, d):
    """Payloads that arrive as files, one a batch of 50, in two parts; which titles the target took."""
    folder = new_folder(spark, "export")
    batches = catalogue.export_batches(tvdb(spark, d), 2000, 50)
    rows = catalogue.payloads(batches)
    for part in (F.col("batch") % 2 == 0, F.col("batch") % 2 == 1):
        rows.where(part).write.option("maxRecordsPerFile", 1).mode("append").parquet(f"{folder}/in")
        taken = jobs.follow_payloads(spark, f"{folder}/in", f"{folder}/checkpoint", f"{folder}/acknowledged", f"{__name__}:refusing_target", jobs.Budget(max_files=1), folder=f"{folder}/out")
    return batches.join(taken.select("batch"), "batch", "left_semi").select("kind", "tvdb_id", "batch")


# ---------------------------------------------------------------- streams with state and with a budget


@query("""WITH p AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '|' || event_type AS pair, event_id FROM events)
  SELECT pair, CAST(1 + max(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM p GROUP BY pair""")
def stream_dedupe(spark, d):
    """Requests for pairs that arrive in four files: two with many that repeat within the delay, also across files, one
    much later that moves the watermark, and then some pairs again, which are computed once more."""
    folder = new_folder(spark, "requests")
    x = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("|"), F.col("event_type")).alias("pair"), F.col("ts").alias("at"), "event_id")
    later = lambda days: F.col("at") + F.make_interval(days=F.lit(days))
    clock = x.limit(1).select(F.lit("clock").alias("pair"), later(200).alias("at"))
    arrivals = [x.where("event_id % 3 <> 0"), x.withColumn("at", later(1)), clock, x.where("event_id % 5 = 0").withColumn("at", later(400))]
    for rows in arrivals:
        rows.select("pair", "at").write.mode("append").parquet(f"{folder}/in")
        jobs.follow_requests(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", "40 days")
    out = spark.read.schema("pair string, at timestamp").parquet(f"{folder}/out")
    return out.where("pair <> 'clock'").groupBy("pair").agg(F.count("*").alias("n"))


@query(_T + ", res AS (" + _RES.format(titles="SELECT * FROM titles") + """) SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id, coalesce(n.status, o.status) AS status,
  CASE WHEN n.tmdb_id IS NULL THEN o.attempts WHEN n.status = 'error' THEN coalesce(o.attempts, 0) + 1 ELSE 0 END AS attempts FROM titles o FULL JOIN res n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def streaming_budgeted(spark, d):
    """Results in eight files, two a micro-batch; a run that stops after one micro-batch, and one that goes on."""
    folder = new_folder(spark, "stream")
    results = catalogue.conform(_sql(spark, d, _RES.format(titles=TITLES), "customer", "supplier"), TITLE_SCHEMA)
    results.repartition(8, "tmdb_id").write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    store.write("titles", titles(spark, d))
    for most in (1, 0):
        jobs.follow_results(store, f"{folder}/in", f"{folder}/checkpoint", jobs.Budget(max_files=2, max_batches=most))
    return store.read("titles", TITLE_SCHEMA).select("media_type", "tmdb_id", "status", "attempts")


# ---------------------------------------------------------------- counters


@query(_T + _RANKED.format("(SELECT * FROM titles WHERE adult = 0)") + f""", o AS (SELECT CASE WHEN tmdb_id % 10 = 3 THEN 'not_found' WHEN poster_path IS NULL OR poster_path = '/p9.jpg' THEN 'no_poster' WHEN poster_path = '/p11.jpg' THEN 'error' ELSE 'done' END AS status
  FROM ranked WHERE {_OPEN.replace("coalesce(nullif(palette_version, 0), 1)", "1")}) SELECT status, count(*) AS n FROM o GROUP BY status""")
def run_counters(spark, d):
    """What a run of the first pipeline counted while it wrote."""
    store = Store(spark, f"{new_folder(spark, 'run')}/store")
    store.write("titles", titles(spark, d).withColumn("palette_version", F.lit(1)))  # nothing is cached
    details = titles(spark, d).where("tmdb_id % 10 <> 3").select("media_type", "tmdb_id", "title", "adult", "poster_path", "logo_path")
    failed = F.when(F.col("poster_path") == "/p11.jpg", "broken").alias("error")
    found = refresh.process(store, details, lambda p: p.where("poster_path <> '/p9.jpg'").select("pair", *[F.lit("#010203").alias(r) for r in ROLES], failed))
    return spark.createDataFrame(sorted(found.items()), "status string, n long")


# ---------------------------------------------------------------- reads that prune


def _search_sql(q: str, limit: int, more: str = "") -> str:
    return f"(SELECT '{q}' AS q, tmdb_id, title FROM part_titles WHERE title ILIKE '%{q}%'{more} ORDER BY lower(title) = '{q}' DESC, starts_with(lower(title), '{q}') DESC, popularity DESC NULLS LAST, tmdb_id LIMIT {limit})"


_SEARCHES = (("bolt", 50, None), ("red", 100, "done"), ("re", 30, None))


@query(f"WITH {_PARTS} " + " UNION ALL ".join(_search_sql(q, n, f" AND status = '{s}'" if s else "") for q, n, s in _SEARCHES))
def search_indexed(spark, d):
    """Three searches through postings; the last is too short for a trigram."""
    folder = new_folder(spark, "postings")
    x = part_titles(spark, d)
    postings.build(x, folder)
    found = [postings.search_indexed(spark, folder, x, q.upper(), n, status=s).select(F.lit(q).alias("q"), "tmdb_id", "title") for q, n, s in _SEARCHES]
    return found[0].unionAll(found[1]).unionAll(found[2])


def _served(spark, d):
    served = Served(spark, f"{new_folder(spark, 'served')}/titles", span=100)
    served.publish(titles(spark, d))
    return served


@query(_T + """ (SELECT 'key' AS read, media_type, tmdb_id, title FROM titles WHERE media_type = 'tv' AND tmdb_id = 7)
  UNION ALL (SELECT 'page', media_type, tmdb_id, title FROM titles WHERE media_type = 'movie' AND status = 'done' AND tmdb_id > 100 AND updated_at >= '2026-01-10' ORDER BY tmdb_id LIMIT 100)""")
def served_reads(spark, d):
    """A title by its key and a page of titles after a key, from directories of 100 ids."""
    served = _served(spark, d)
    one, page = served.get("tv", 7), served.page("movie", 100, 100, "2026-01-10")
    return one.select(F.lit("key").alias("read"), "media_type", "tmdb_id", "title").unionAll(page.select(F.lit("page"), "media_type", "tmdb_id", "title"))


@query(_T + ", res AS (SELECT * FROM (" + _RES.format(titles="SELECT * FROM titles") + """) r WHERE tmdb_id % 1000 < 300) SELECT coalesce(o.media_type, n.media_type) AS media_type, coalesce(o.tmdb_id, n.tmdb_id) AS tmdb_id,
  CASE WHEN n.tmdb_id IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.tmdb_id IS NULL THEN o.attempts WHEN n.status = 'error' THEN coalesce(o.attempts, 0) + 1 ELSE 0 END AS attempts FROM titles o FULL JOIN res n ON o.media_type = n.media_type AND o.tmdb_id = n.tmdb_id""")
def save_results_served(spark, d):
    """Results of some spans of ids, saved into the directories that they fall into."""
    served = _served(spark, d)
    results = _sql(spark, d, _RES.format(titles=TITLES), "customer", "supplier").where("tmdb_id % 1000 < 300")
    served.change(results, catalogue.save)
    return served.read().select("media_type", "tmdb_id", "status", "attempts")


# ---------------------------------------------------------------- functions for SQL


@query()
def ladder_rows(spark, d):
    """The rungs of posters' ladders by the table function, clusters being coarse labels of one region each."""
    return tables.ladder_rows(roles.described(_gridded(spark, d).withColumn("region", F.lit(0))))


# ---------------------------------------------------------------- the review of palettes

_FEATURES = ("lightness", "chroma", "saturation", "distinctiveness", "contrast", "neutrality", "neutral_factor")


@query(_V2 + """ SELECT k.poster, k.hex, round(k.coverage, 6) AS coverage, round(k.ll, 4) AS lightness, round(k.chroma, 4) AS chroma, round(k.saturation, 4) AS saturation, round(k.distinctiveness, 4) AS distinctiveness, round(k.contrast, 4) AS contrast,
  round(k.neutrality, 3) AS neutrality, round(k.nf, 3) AS neutral_factor, CASE k.label WHEN p1.label THEN 'primary' WHEN q2.label THEN 'secondary' WHEN q3.label THEN 'tertiary' END AS role FROM k JOIN p1 USING (poster) JOIN q2 USING (poster) JOIN q3 USING (poster)""")
def report_candidates(spark, d):
    """The candidates of the second version's roles and what they were judged by, clusters being coarse labels."""
    rows = palettes.report_rows(None, _gridded(spark, d))
    digits = {c: 3 if c.startswith("neutral") else 4 for c in _FEATURES}
    return rows.select("poster", "hex", F.round("coverage", 6).alias("coverage"), *[F.round(c, n).alias(c) for c, n in digits.items()], "role")
