"""Behaviour of the catalogue on small tables."""

from datetime import date

from pyspark.sql import functions as F

from tintlake.functions import colour, text
from tintlake.operators import catalogue, ranking, search
from tintlake.schemas import ROLES, STATE, TITLES, TVDB_TITLES
from tintlake.sources import listings


def at():
    return F.lit("2026-01-01T00:00:00+00:00")


def titles(spark, rows):
    """rows: dicts with any columns of the table."""
    base = {f.name: None for f in TITLES.fields} | {"adult": 0, "status": "pending", "attempts": 0, "updated_at": "2026-01-01T00:00:00+00:00"}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in TITLES.fields) for r in rows], TITLES)


def tvdb(spark, rows):
    base = {f.name: None for f in TVDB_TITLES.fields} | {"status": "pending", "attempts": 0, "dirty": 0, "updated_at": "x"}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in TVDB_TITLES.fields) for r in rows], TVDB_TITLES)


def movies(n, **more):
    return [{"media_type": "movie", "tmdb_id": i, "popularity": 100.0 - i, **more} for i in range(1, n + 1)]


def keys(df):
    return [(r.media_type[0], r.tmdb_id) for r in df.orderBy("rank").collect()]


def test_interleaves(spark):
    tv = [{"media_type": "tv", "tmdb_id": 101, "popularity": 999.0}, {"media_type": "tv", "tmdb_id": 102, "popularity": 998.0}]
    x = titles(spark, movies(3) + tv)
    assert keys(ranking.work_queue(x)) == [("m", 1), ("t", 101), ("m", 2), ("t", 102), ("m", 3)]
    done = titles(spark, [m | ({"status": "done", "palette_version": 3} if m["tmdb_id"] == 1 else {}) for m in movies(3)] + tv)
    assert keys(ranking.work_queue(done, top=3)) == [("t", 101), ("m", 2)]
    assert keys(ranking.work_queue(done, top=3, limit=1)) == [("t", 101)]


def test_rank_is_exact_with_ties(spark):
    rows = [{"media_type": "movie" if i % 3 else "tv", "tmdb_id": i, "popularity": [None, 5.0, 5.0, float(i % 40)][i % 4]} for i in range(1, 900)]
    got = keys(ranking.interleaved_rank(titles(spark, rows), bins=8))
    by = {k: [(k[0], r["tmdb_id"]) for r in sorted((r for r in rows if r["media_type"] == k), key=lambda r: (r["popularity"] is None, -(r["popularity"] or 0), r["tmdb_id"]))] for k in ("movie", "tv")}
    want = []
    for i in range(900):
        want += by["movie"][i : i + 1] + by["tv"][i : i + 1]
    assert got == want


def test_old_versions_and_cache(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 1, "status": "done", "poster_path": "/a.jpg", "base_hex": "#000000"}, {"media_type": "movie", "tmdb_id": 2, "status": "done", "palette_version": 3, "poster_path": "/b.jpg", "base_hex": "#111111"}])
    assert keys(ranking.work_queue(x)) == [("m", 1)]
    assert [(r.pair, r.base_hex) for r in catalogue.palette_cache(x).collect()] == [("/b.jpg|", "#111111")]


def test_prune(spark):
    x = titles(spark, [m | ({"status": "done"} if m["tmdb_id"] == 6 else {}) for m in movies(6)] + [{"media_type": "movie", "tmdb_id": 50, "popularity": 500.0, "adult": 1}])
    once = catalogue.prune(x, 3)
    assert sorted(r.tmdb_id for r in once.collect()) == [1, 2, 3, 6]
    assert catalogue.prune(once, 3).count() == 4


def test_seed_is_idempotent_and_keeps_order(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 1, "title": "Old", "popularity": 1.0, "status": "done"}])
    new = spark.createDataFrame([("movie", 1, "New", 0, 2.0, 0), ("movie", 2, None, 0, 3.0, 1), ("movie", 2, "Two", 1, None, 2)], "media_type string, tmdb_id long, title string, adult int, popularity double, ordinal long")
    once = catalogue.seed(x, new, at())
    got = {r.tmdb_id: (r.title, r.adult, r.popularity, r.status) for r in once.collect()}
    assert got == {1: ("Old", 0, 2.0, "done"), 2: ("Two", 1, None, "pending")}
    assert sorted(map(str, catalogue.seed(once, new, at()).collect())) == sorted(map(str, once.collect()))


def test_error_then_done(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 1, "status": "done", "base_hex": "#222222", "palette_version": 3, "poster_path": "/p"}])
    err = catalogue.save(x, spark.createDataFrame([("movie", 1, "error", "boom" * 300)], "media_type string, tmdb_id long, status string, error string"), at())
    r = err.first()
    assert (r.status, r.attempts, r.base_hex, r.palette_version, r.poster_path, len(r.error)) == ("error", 1, None, None, None, 500)
    r = catalogue.save(err, spark.createDataFrame([("movie", 1, "done", "#333333")], "media_type string, tmdb_id long, status string, base_hex string"), at()).first()
    assert (r.status, r.attempts, r.palette_version, r.error) == ("done", 0, 3, None)


def test_several_results_of_a_title_are_one(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 1}])
    two = spark.createDataFrame([("movie", 1, "error", 2), ("movie", 1, "no_poster", 1)], "media_type string, tmdb_id long, status string, ordinal long")
    assert [(r.status, r.attempts) for r in catalogue.save(x, two, at()).collect()] == [("error", 1)]
    y = tvdb(spark, [{"kind": "movie", "tvdb_id": 1}])
    twice = spark.createDataFrame([("movie", 1, "error"), ("movie", 1, "error")], "kind string, tvdb_id long, status string")
    assert [(r.status, r.attempts) for r in catalogue.save_b(y, twice, at()).collect()] == [("error", 1)]


def test_requeue(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 550, "status": "done", "palette_version": 3}, {"media_type": "movie", "tmdb_id": 551, "status": "no_poster", "attempts": 2}])
    ids = spark.createDataFrame([("movie", 550), ("movie", 551), ("movie", 9999)], "media_type string, tmdb_id long")
    assert {r.tmdb_id: (r.status, r.palette_version, r.attempts) for r in catalogue.requeue(x, ids).collect()} == {550: ("done", None, 0), 551: ("pending", None, 0)}


def test_second_queue(spark):
    x = tvdb(spark, [{"kind": "series", "tvdb_id": 1, "score": 10.0}, {"kind": "series", "tvdb_id": 2, "score": 90.0}, {"kind": "movie", "tvdb_id": 3, "score": 5000.0}, {"kind": "movie", "tvdb_id": 4}])
    assert [(r.kind[0], r.tvdb_id) for r in ranking.work_queue_b(x).orderBy("rank").collect()] == [("s", 2), ("m", 3), ("s", 1), ("m", 4)]


def test_export_budget(spark):
    x = tvdb(spark, [{"kind": "movie", "tvdb_id": i, "score": float(i), "status": "done", "dirty": 1, "base": "#000000"} for i in range(1, 1201)])
    b = catalogue.export_batches(x, 700)
    rows = b.collect()
    assert len(rows) == 700 and {r.batch for r in rows} == {0, 1} and min(rows, key=lambda r: r.rn).key == "movie:1200"
    assert catalogue.acknowledge(x, b).where("dirty = 1").count() == 500
    first = catalogue.payloads(b).where("batch = 0").first()["items"]
    assert first.startswith('{"items":[{"key":"movie:1200","colours":{"base":"#000000","identity1":null')


def test_search(spark):
    rows = [(1, "The Matrix", 50.0, "pending"), (2, "Matrix", 5.0, "pending"), (3, "100% Wolf", 9.0, "pending"), (4, "Some Film", 99.0, "done")]
    x = titles(spark, [{"media_type": "movie", "tmdb_id": i, "title": t, "popularity": p, "status": s} for i, t, p, s in rows])
    ids = lambda *a, **b: [r.tmdb_id for r in search.search(x, *a, **b).collect()]
    assert ids("matrix") == [2, 1] and ids("%") == [3] and ids("4") == [4] and ids("") == [4, 1, 3, 2]
    assert ids(status="done") == [4] and ids(media_type="tv") == [] and ids("", 2, 1) == [1, 3]


def test_lookup(spark):
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 550}, {"media_type": "tv", "tmdb_id": 1399}])
    req = spark.createDataFrame([(0, "tv", 1399), (1, "movie", 550), (2, "movie", 999), (3, "movie", 550)], "pos int, media_type string, tmdb_id long")
    assert [(r.tmdb_id, r.found) for r in search.lookup(x, req).collect()] == [(1399, True), (550, True), (999, False)]
    assert [r.tmdb_id for r in search.missing(x, req).collect()] == [999]


def test_ranks_kept_under_offset(spark):
    x = titles(spark, movies(5, status="done"))
    assert [r["rank"] for r in ranking.top_ranked(x, 5, 3).orderBy("rank").collect()] == [4, 5]


def test_windows():
    assert len(listings.change_windows("2026-09-01", date(2026, 9, 27))) == 2
    assert listings.change_windows("2026-09-27", date(2026, 9, 27)) == []


def test_text(spark):
    x = spark.createDataFrame([("/a/b.jpg",), ("a.b/c",), ("",), (None,), ("http://h/x.png",)], "p string")
    got = [tuple(r) for r in x.select(text.absolute_url(F.col("p"), "https://h"), text.thumbnail_url(F.col("p"))).collect()]
    assert got == [("https://h/a/b.jpg", "/a/b_t.jpg"), ("https://h/a.b/c", "a.b/c"), (None, ""), (None, None), ("http://h/x.png", "http://h/x_t.png")]


def test_colour_round_trip(spark):
    x = spark.range(0, 4096).select(*[((F.col("id") * k) % 256).cast("int").alias(c) for k, c in ((7, "r"), (31, "g"), (113, "b"))])
    back = colour.oklab_to_rgb(*colour.oklab(F.col("r"), F.col("g"), F.col("b")))
    worst = x.agg(*[F.max(F.abs(v - F.col(c))) for v, c in zip(back, "rgb")]).first()
    assert max(worst) < 0.5
    r = spark.range(1).select(*colour.oklab(F.lit(255), F.lit(255), F.lit(255))).first()
    assert abs(r[0] - 1) < 1e-3 and abs(r[1]) < 1e-3 and abs(r[2]) < 1e-3


def test_state(spark):
    s = catalogue.set_state(catalogue.set_state(spark.createDataFrame([], STATE), "k", "1"), "k", "2")
    assert catalogue.get_state(s, "k") == "2" and catalogue.get_state(s, "z") is None


def test_models(spark):
    whole = {f"{r}_hex": "#ABCDEF" for r in ROLES}
    x = titles(spark, [{"media_type": "movie", "tmdb_id": 1, "status": "done", **whole}, {"media_type": "movie", "tmdb_id": 2, "status": "done", **whole, "accent_hex": ""}])
    assert {r.tmdb_id: r.palette is not None for r in search.model(x).collect()} == {1: True, 2: False}
