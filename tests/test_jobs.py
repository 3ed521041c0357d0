"""Sources, store, both pipelines, streams and the command line, end to end on small files."""

import gzip
import json
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintlake import cli
from tintlake.functions import text
from tintlake.plans import listed, refresh
from tintlake.plans.store import Conflict, Store
from tintlake.schemas import ROLES, STATE, TITLES, TVDB_TITLES
from tintlake.sources import listings
from tintlake.streaming import jobs

DAY = date(2025, 3, 18)


def export(folder, name, rows):
    with gzip.open(folder / name, "wt") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n")


@pytest.fixture
def feeds(tmp_path):
    """Films 11 to 16, one of them adult, in an export of yesterday; shows 71 and 72 in one of today; three change files."""
    films = [(11, "Ash", 3.5, False), (12, "Birch", 8.25, False), (13, "Cedar", None, False), (14, "Dogwood", 2.0, False), (15, "Elm", 99.0, True), (16, "Fir", 0.1, False)]
    export(tmp_path, "movie_ids_03_17_2025.json.gz", [{"id": i, "original_title": t, "popularity": p, "adult": a} for i, t, p, a in films])
    export(tmp_path, "tv_series_ids_03_18_2025.json.gz", [{"id": i, "original_name": t, "popularity": p} for i, t, p in ((71, "Grove", 5.0), (72, "Heath", 4.0))])
    for k, (a, b) in enumerate(listings.change_windows("2025-02-10", DAY)):
        (tmp_path / f"changes_movie_{a}_{b}-0.json").write_text(json.dumps({"results": [{"id": 12}, {"id": 14 + 86 * k}, {"id": 0}, {"id": None}], "page": 1, "total_pages": 1}))
    return tmp_path


def details(spark):
    """Film 13 and show 72 have none; film 14 has no poster; 12 and 16 share theirs, with and without a logo."""
    rows = [("movie", 11, "Ash", 0, "/ash.jpg", None), ("movie", 12, "Birch", 0, "/wood.jpg", "/birch.png"), ("movie", 14, "Dogwood", 0, None, None), ("movie", 16, "Fir", 0, "/wood.jpg", None), ("tv", 71, "Grove", None, "/wood.jpg", None)]
    return spark.createDataFrame(rows, "media_type string, tmdb_id long, title string, adult int, poster_path string, logo_path string")


def plain_colours(asked):
    def colours(pairs):
        asked.append({r.pair for r in pairs.collect()})
        return pairs.select("pair", *[F.lit(f"#00000{i}").alias(r) for i, r in enumerate(ROLES)])

    return colours


def test_refresh(spark, feeds, tmp_path):
    store, folder, asked = Store(spark, f"file://{tmp_path}/store"), f"file://{feeds}", []
    colours = plain_colours(asked)
    assert refresh.seed(store, folder, DAY) == {"movie": 6, "tv": 2}
    assert refresh.seed(store, folder, DAY) == {}
    assert refresh.process(store, details(spark), colours) == {"done": 4, "no_poster": 1, "not_found": 2}
    assert asked == [{"/ash.jpg|", "/wood.jpg|birch.png".replace("|", "|/"), "/wood.jpg|"}]
    got = {r.tmdb_id: r for r in store.read("titles", TITLES).collect()}
    assert got[15].status == "pending" and got[12].primary_hex == "#000001" and got[12].palette_version == 3
    store.write("state", spark.createDataFrame([("changes:movie", "2025-02-10"), ("changes:tv", "2025-03-18")], STATE))
    assert refresh.sync(store, folder, DAY) == {"movie": 4, "tv": 0}
    got = {r.tmdb_id: r for r in store.read("titles", TITLES).collect()}
    assert (got[12].status, got[12].palette_version, got[14].status) == ("done", None, "pending")
    assert refresh.process(store, details(spark), colours) == {"done": 1, "no_poster": 1}
    assert asked[1] <= {"/wood.jpg|/birch.png"}
    assert refresh.prune(store, 1) > 0


def test_errors_are_tried_again(spark, feeds, tmp_path):
    """A poster that can't be used is an error of its titles: five attempts, then no more; it is never taken for none."""
    store, folder = Store(spark, f"file://{tmp_path}/store"), f"file://{feeds}"
    refresh.seed(store, folder, DAY)
    plain = plain_colours([])
    broken = lambda pairs: plain(pairs).withColumn("error", F.when(F.col("pair").startswith("/ash"), F.lit("e" * 600)))
    assert refresh.process(store, details(spark), broken) == {"done": 3, "no_poster": 1, "not_found": 2, "error": 1}
    for attempts in range(2, 6):
        assert refresh.process(store, details(spark), broken) == {"error": 1}
        r = store.read("titles", TITLES).where("tmdb_id = 11").first()
        assert (r.status, r.attempts, len(r.error), r.title, r.base_hex, r.palette_version) == ("error", attempts, 500, "Ash", None, None)
    assert refresh.process(store, details(spark), broken) == {}
    other = Store(spark, f"file://{tmp_path}/b")
    listed.seed(other, listed_rows(spark))
    none = spark.createDataFrame([], "kind string, tvdb_id long, logo string")
    fail = lambda p: p.where("poster_path <> '/gone.jpg'").select("pair", *[F.lit("#010203").alias(r) for r in ROLES], F.when(F.col("poster_path") == "/reed.jpg", "no image").alias("error"))
    assert listed.process(other, none, fail) == {"done": 1, "error": 1, "no_poster": 2}
    got = {r.tvdb_id: r for r in other.read(listed.TABLE, TVDB_TITLES).collect()}
    assert (got[310].status, got[310].attempts, got[310].dirty, got[310].base) == ("error", 1, 0, None) and got[311].dirty == 1
    assert listed.process(other, none, fail) == {"error": 1}


def test_a_title_listed_twice_counts_as_its_last_row(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/b")
    rows = [("movie", 5, f"t{k}", float(k), f"/{k}.jpg", k) for k in (3, 1, 4, 2)]
    assert listed.seed(store, spark.createDataFrame(rows, "kind string, tvdb_id long, title string, score double, image string, ordinal long"))["movie"] == {"listed": 1, "gone": 0}
    r = store.read(listed.TABLE, TVDB_TITLES).first()
    assert (r.title, r.score, r.image) == ("t4", 4.0, "/4.jpg")


def test_time_budget_and_limit(spark, feeds, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/store"), f"file://{feeds}"
    refresh.seed(store, folder, DAY)
    assert sum(refresh.process(store, details(spark), plain_colours([]), limit=2).values()) == 2
    one = refresh.process(store, details(spark), plain_colours([]), max_minutes=1e-9, step=2)
    assert sum(one.values()) == 2  # the step in which the time runs out is finished
    rest = refresh.process(store, details(spark), plain_colours([]), max_minutes=60, step=2)
    assert sum(rest.values()) == 3 and refresh.process(store, details(spark), plain_colours([]), max_minutes=60) == {}


def test_missing_export_fails(spark, feeds):
    with pytest.raises(RuntimeError):
        listings.locate_export(spark, f"file://{feeds}", "movie", date(2025, 3, 25))
    with pytest.raises(RuntimeError):
        listings.locate_export(spark, f"file://{feeds}/none", "movie", DAY)
    export(feeds, "movie_ids_03_18_2025.json.gz", [{"original_title": "no id"}])
    with pytest.raises(Exception, match="no id"):
        listings.read_export(spark, listings.locate_export(spark, f"file://{feeds}", "movie", DAY), "movie").collect()


def test_streams(spark, feeds, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    out = tmp_path / "exports"
    out.mkdir()
    (out / "a.json.gz").write_bytes((feeds / "movie_ids_03_17_2025.json.gz").read_bytes())
    jobs.follow_exports(store, f"file://{out}", "movie", f"{tmp_path}/c1")
    jobs.follow_exports(store, f"file://{out}", "movie", f"{tmp_path}/c1")
    assert store.current("titles")[0] == 1 and store.read("titles", TITLES).count() == 6
    changes = tmp_path / "changes"
    changes.mkdir()
    (changes / "1.json").write_text(json.dumps({"results": [{"id": 12}]}))
    store.change("titles", TITLES, lambda x: x.withColumn("status", F.lit("no_poster")))
    jobs.follow_changes(store, f"file://{changes}", "movie", f"{tmp_path}/c2")
    assert [r.tmdb_id for r in store.read("titles", TITLES).where("status = 'pending'").collect()] == [12]


def test_a_batch_that_runs_again_is_saved_once(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), []
    for at, status in (("2025-03-01", "error"), ("2025-03-02", "error")):
        rows.append({f.name: None for f in TITLES.fields} | {"media_type": "movie", "tmdb_id": 5, "status": status, "adult": 0, "attempts": 0, "updated_at": at})
    results = spark.createDataFrame([tuple(r.values()) for r in rows], TITLES)
    results.write.parquet(f"file://{tmp_path}/in")
    jobs.follow_results(store, f"file://{tmp_path}/in", f"file://{tmp_path}/c")
    attempts = lambda: [r.attempts for r in store.read("titles", TITLES).collect()]
    assert attempts() == [1] and store.last_batch("titles", f"file://{tmp_path}/c") == 0
    for f in (tmp_path / "c" / "commits").glob("*"):  # as if the driver had been lost before the stream knew
        f.unlink()
    jobs.follow_results(store, f"file://{tmp_path}/in", f"file://{tmp_path}/c")
    assert attempts() == [1]


def test_two_writers_do_not_undo_each_other(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    row = lambda v: spark.createDataFrame([("k", v)], STATE)
    assert store.write("state", row("1")) == 1
    version, _ = other.current("state")
    assert store.write("state", row("2")) == 2
    with pytest.raises(Conflict):
        other.write("state", row("3"), version)
    assert [r.value for r in other.read("state", STATE).collect()] == ["2"] and other.compact("state") == 3


# ---------------------------------------------------------------- the second pipeline


def listed_rows(spark):
    rows = [("series", 901, "Kelp", 40.0, "/kelp.jpg"), ("series", 902, "Moss", 7.0, None), ("movie", 310, "Reed", 55.0, "/reed.jpg"), ("movie", 311, "Sedge", None, "/gone.jpg")]
    return spark.createDataFrame(rows, "kind string, tvdb_id long, title string, score double, image string")


def test_second_pipeline(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    logos = spark.createDataFrame([("series", 901, "/mark.png")], "kind string, tvdb_id long, logo string")
    colours = lambda p: p.where("poster_path <> '/gone.jpg'").select("pair", *[F.concat(F.lit("#"), F.substring(F.md5("pair"), 1, 6)).alias(r) for r in ROLES])
    out = f"file://{tmp_path}/out"
    first = listed.run(store, listed_rows(spark), logos, colours, listed.to_folder(out))
    assert first["seed"] == {"series": {"listed": 2, "gone": 0}, "movie": {"listed": 2, "gone": 0}}
    assert first["process"] == {"done": 2, "no_poster": 2} and first["export"] == {"sent": 4, "remaining": 0, "refused": None}
    items = {i["key"]: i["colours"] for f in (tmp_path / "out").glob("*.json") for i in json.loads(f.read_text())["items"]}
    assert set(items) == {"series:901", "series:902", "movie:310", "movie:311"} and items["series:902"] is None and len(items["movie:310"]) == 6
    again = listed.run(store, listed_rows(spark), logos, colours, listed.to_folder(out))
    assert again["process"] == {} and again["export"]["sent"] == 0
    less = listed.run(store, listed_rows(spark).where("tvdb_id <> 901"), logos, colours, listed.to_folder(out))
    assert less["seed"]["series"] == {"listed": 1, "gone": 1} and less["export"]["sent"] == 1 and less["stats"]["series"]["not_found"] == 1
    assert listed.seed(store, listed_rows(spark).where("kind = 'movie'"))["series"] == {"listed": 0, "gone": 0}  # nothing listed is no listing
    back = listed.run(store, listed_rows(spark), logos, colours, listed.to_folder(out))
    assert back["process"] == {"done": 1}


def test_export_stops_at_a_refusal(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = {f.name: None for f in TVDB_TITLES.fields} | {"kind": "movie", "status": "done", "dirty": 1, "attempts": 0}
    store.write(listed.TABLE, spark.createDataFrame([tuple((base | {"tvdb_id": i, "score": float(i)}).values()) for i in range(1, 96)], TVDB_TITLES))
    got = []

    def send(name, items):
        if len(got) == 2:
            raise RuntimeError("429")
        got.append([i["key"] for i in json.loads(items)["items"]])

    sent = listed.export(store, send, most=70, size=20)
    assert (sent.sent, sent.remaining, sent.refused) == (40, 55, "429") and got[0][0] == "movie:95" and len(got[1]) == 20
    sent = listed.export(store, lambda name, items: None, most=30, size=20)
    assert (sent.sent, sent.remaining) == (30, 25)


def test_colours_that_arrive_are_sent(spark, tmp_path):
    store, got = Store(spark, f"file://{tmp_path}/store"), []
    base = {f.name: None for f in TVDB_TITLES.fields} | {"kind": "series", "tvdb_id": 4, "status": "pending", "dirty": 0, "attempts": 0}
    store.write(listed.TABLE, spark.createDataFrame([tuple(base.values())], TVDB_TITLES))
    spark.createDataFrame([tuple((base | {"status": "done", "base": "#010203"}).values())], TVDB_TITLES).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        jobs.follow_colours(store, f"file://{tmp_path}/in", f"file://{tmp_path}/c", lambda name, items: got.append(json.loads(items)))
    assert [i["key"] for b in got for i in b["items"]] == ["series:4"] and store.read(listed.TABLE, TVDB_TITLES).first().dirty == 0


def png(path, pixels):
    """A PNG file of rows of RGB or RGBA pixels."""
    h, w, n = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_command_line(spark, feeds, tmp_path, capsys):
    """Both pipelines from files: posters, a logo and a small version of a poster."""
    poster = np.zeros((120, 80, 3))
    poster[:60], poster[60:] = (150, 190, 220), (30, 40, 80)
    poster[80:100, 10:70] = (230, 110, 30)
    mark = np.zeros((20, 40, 4))
    mark[5:15, 5:35] = (230, 110, 30, 255)
    (tmp_path / "posters").mkdir()
    png(tmp_path / "posters" / "wood.png", poster)
    png(tmp_path / "posters" / "birch.png", mark)
    for kind in ("movie", "tv"):
        (tmp_path / "details" / kind).mkdir(parents=True)
    (tmp_path / "details" / "movie" / "12.json").write_text(json.dumps({"id": 12, "title": "Birch", "poster_path": "/wood.png", "images": {"logos": [{"file_path": "/birch.png", "iso_639_1": "en", "vote_average": 5.0, "width": 40}]}}))
    (tmp_path / "details" / "tv" / "71.json").write_text(json.dumps({"id": 71, "name": "Grove", "poster_path": "/none.png"}))
    run = lambda *a: (cli.main([f"file://{tmp_path}/{a[0]}", *a[1:]]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    where = ["--exports", f"file://{feeds}", "--details", f"file://{tmp_path}/details", "--posters", f"file://{tmp_path}/posters", "--today", str(DAY)]
    assert run("store", "seed", *where)[1] == {"movie": 6, "tv": 2}
    assert run("store", "process", *where, "--limit", "50")[1] == {"done": 1, "no_poster": 1, "not_found": 5}
    got = Store(spark, f"file://{tmp_path}/store").read("titles", TITLES).where("tmdb_id = 12").first()
    near = lambda code, rgb: max(abs(int(code[i : i + 2], 16) - c) for i, c in zip((1, 3, 5), rgb)) < 14
    assert near(got.base_hex, (150, 190, 220)) and near(got.identity1_hex, (230, 110, 30)) and got.logo_path == "/birch.png"
    assert run("store", "stats")[1]["movie"]["done"] == 1 and run("store", "prune", "--size", "2")[1]["deleted"] > 0
    lists = tmp_path / "listings"
    for d in ("series", "movie", "artworks/series", "artworks/movie"):
        (lists / d).mkdir(parents=True)
    (lists / "series" / "0.json").write_text(json.dumps({"data": [{"id": 901, "name": "Kelp", "score": 4.0, "image": "wood.jpg"}], "links": {"next": "1"}}))
    (lists / "series" / "1.json").write_text(json.dumps({"data": [{"id": 902, "name": "Moss", "score": 2.0, "image": None}], "links": {"next": None}}))
    (lists / "movie" / "0.json").write_text(json.dumps({"data": [{"id": 310, "name": "Reed", "score": 1.0, "image": "/lost.jpg"}], "links": {}}))
    (lists / "artworks" / "series" / "901.json").write_text(json.dumps({"data": {"id": 901, "artworks": [{"type": 23, "language": "eng", "score": 3.0, "image": "/birch.png"}]}}))
    (lists / "artworks" / "movie" / "310.json").write_text(json.dumps({"data": {"id": 310, "artworks": []}}))
    (lists / "artwork-types.json").write_text(json.dumps({"data": [{"id": 23, "name": "ClearLogo", "slug": "clearlogo", "recordType": "series"}]}))
    png(tmp_path / "posters" / "wood_t.jpg", poster)  # the small version; readers go by content, not by name
    second = ["--listings", f"file://{lists}", "--posters", f"file://{tmp_path}/posters", "--base", "https://a.test", "--out", f"file://{tmp_path}/out"]
    png(tmp_path / "posters" / "wood.jpg", 255 - poster)
    code, out = run("b", "tvdb", "run", *second)
    assert code == 0 and out["process"] == {"done": 1, "no_poster": 2} and out["export"]["sent"] == 3 and out["stats"]["unsent"] == 0
    b = Store(spark, f"file://{tmp_path}/b").read("tvdb_titles", TVDB_TITLES).where("tvdb_id = 901").first()
    assert near(b.base, (150, 190, 220)) and near(b.identity1, (230, 110, 30)) and b.logo == "https://a.test/birch.png"
    assert run("b", "tvdb", "stats")[1]["movie"] == {"no_poster": 1} and run("b", "tvdb", "export", *second)[1]["sent"] == 0
    with pytest.raises(SystemExit):
        cli.main(["store", "tvdb"])
    (lists / "series" / "1.json").unlink()
    with pytest.raises(Exception, match="goes on"):
        run("b", "tvdb", "seed", *second)


def test_images_are_found_by_name_before_they_are_decoded(spark, tmp_path, monkeypatch):
    """Of 200 files two are read; a small size that is broken gives way to the other; what has none that works is an error."""
    flat = np.zeros((12, 8, 3)) + (150, 190, 220)
    for k in range(200):
        png(tmp_path / f"p{k}.png", flat)
    for name in ("p1_t.png", "p2.png"):
        (tmp_path / name).write_bytes(b"no image")
    read, whole = [], listings.images_named

    def images_named(*a, **how):
        for x in whole(*a, **how):
            read.extend(f.rsplit("/", 1)[1] for f in x.inputFiles())
            yield x

    monkeypatch.setattr(listings, "images_named", images_named)
    pairs = spark.createDataFrame([(f"/{p}.png|{m}", f"/{p}.png", m or None) for p, m in (("p1", ""), ("p2", ""), ("p7", "/p9.png"), ("p7", ""), ("none", ""))], "pair string, poster_path string, logo_path string")
    got = {r.pair: r for r in cli.colours_from(spark, f"file://{tmp_path}")(pairs).collect()}
    assert set(got) == {"/p1.png|", "/p2.png|", "/p7.png|/p9.png", "/p7.png|"}
    assert all(got[k].base == "#96BEDC" and got[k].error is None for k in ("/p1.png|", "/p7.png|", "/p7.png|/p9.png")) and got["/p2.png|"].base is None and "decoded" in got["/p2.png|"].error
    assert sorted(read) == ["p1.png", "p1_t.png", "p2.png", "p7.png", "p9.png"]
    read.clear()
    cli.colours_from(spark, f"file://{tmp_path}")(pairs.where("pair = '/p7.png|' OR pair = '/p1.png|'").replace("/p1.png", "/p3.png", ["poster_path"])).collect()
    assert sorted(read) == ["p3.png", "p7.png"]
    assert cli.colours_from(spark, f"file://{tmp_path}")(pairs.where("pair = '/none.png|'")).isEmpty()
    plan = cli._sampled(spark, listings.image_paths(spark, f"file://{tmp_path}").where("file = 'p7.png'")).columns
    assert plan == ["file", "ok", "y", "x", "r", "g", "b"]


def test_report_of_a_folder(spark, tmp_path, capsys):
    """All versions of each poster that can be decoded, the candidates of the second, and the summary."""
    two = np.zeros((120, 80, 3))
    two[:70], two[70:] = (150, 190, 220), (230, 110, 30)
    (tmp_path / "in").mkdir()
    png(tmp_path / "in" / "two.png", two)
    png(tmp_path / "in" / "flat.png", np.zeros((120, 80, 3)) + (150, 190, 220))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    assert cli.main([f"file://{tmp_path}/out", "report", "--posters", f"file://{tmp_path}/in"]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["posters"] == 2 and summary["mean_ms"] > 0 and set(summary) == {"posters", "changed_primary", "flagged", "mean_ms"}
    rows = {r.file: r for r in spark.read.parquet(f"file://{tmp_path}/out/report").collect()}
    assert rows["flat.png"].v1_primary_hex == rows["flat.png"].v2_primary_hex == rows["flat.png"].base == "#96BEDC" and "similar" in rows["flat.png"].flags
    assert {rows["two.png"].v2_primary_hex, rows["two.png"].v2_secondary_hex} == {"#96BEDC", "#E66E1E"} and rows["two.png"].logo.source == "none"
    found = spark.read.parquet(f"file://{tmp_path}/out/report-candidates").groupBy("poster").agg(F.count("*").alias("n"), F.collect_set("role").alias("r")).collect()
    assert sorted((r.n, sorted(r.r)) for r in found) == [(1, ["primary"]), (2, ["primary", "secondary"])]


def test_parts_of_images_cover_all_names(spark, tmp_path):
    for k in range(9):
        png(tmp_path / f"p{k}.png", np.zeros((2, 2, 3)))
    parts = [sorted(r.file for r in x.collect()) for x in listings.images_named(spark, listings.image_paths(spark, f"file://{tmp_path}"), most=2)]
    assert len(parts) > 1 and sorted(f for p in parts for f in p) == [f"p{k}.png" for k in range(9)]


def test_manifest_and_parts(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"description": "d", "titles": [{"media_type": "tv", "id": 71, "name": "Grove", "category": "dark"}]}))
    r = listings.read_manifest(spark, f"file://{tmp_path}/m.json").first()
    assert (r.media_type, r.id, r.category, r.expect) == ("tv", 71, "dark", None)
    x = spark.createDataFrame([(" YES ", " a,, b,a "), ("0", ""), ("", None), (None, ",")], "f string, l string")
    assert [r[0] for r in x.select(text.is_true(F.col("f"), True)).collect()] == [True, False, True, True]
    assert [r[0] for r in x.select(text.csv_set(F.col("l"))).collect()] == [["a", "b"], [], None, []]


def test_logos(spark, tmp_path):
    logos = [{"file_path": "/a.svg", "iso_639_1": "en", "vote_average": 9.0, "width": 9}, {"file_path": "/b.PNG", "iso_639_1": None, "vote_average": 8.0, "width": 9}, {"file_path": "/c.png", "iso_639_1": "en", "vote_average": 1.0, "width": 5}]
    (tmp_path / "d.json").write_text(json.dumps({"id": 1, "title": "", "name": "N", "poster_path": "/p", "images": {"logos": logos}}))
    r = listings.read_details(spark, f"file://{tmp_path}/d.json", "movie").first()
    assert (r.title, r.logo_path) == ("N", "/c.png")
    types = spark.createDataFrame([(2, "Poster", None, "series"), (23, "Clear Logo", None, "series"), (25, "ClearLogo", None, "movie")], "id int, name string, slug string, recordType string")
    arts = spark.createDataFrame([(1, [(23, "spa", 99.0, "/x.png"), (23, "eng", 10.0, "/y.png"), (2, "eng", 500.0, "/z.png")]), (2, [])], "id long, artworks array<struct<type: int, language: string, score: double, image: string>>")
    assert {r.id: r.logo for r in listings.logos_of(arts, types, "series", "https://h").collect()} == {1: "https://h/y.png", 2: None}
