"""Feeds in pages and windows, exports by tasks, and streams with state and budgets: what fails, restarts and repeats."""

import json

import pytest
from pyspark.sql import functions as F

from tintlake.plans import listed
from tintlake.plans.store import Store
from tintlake.schemas import TITLES, TVDB_TITLES
from tintlake.sources import feeds
from tintlake.streaming import jobs


@pytest.fixture(autouse=True)
def senders(spark):
    """Tasks import the senders below from this file."""
    spark.sparkContext.addPyFile(__file__)


def page(folder, n, ids, following):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text(json.dumps({"status": "success", "data": [{"id": i, "name": f"t{i}", "score": i, "image": "a.jpg" if i else None} for i in ids], "links": {"next": following}}))


def test_a_listing_is_a_chain_of_pages(spark, tmp_path):
    folder = tmp_path / "series"
    read = lambda: feeds.read_pages(spark, f"file://{folder}", "series", "https://a.test")
    for n, ids, following in ((0, [5, 0, 7], "https://x/series?page=1"), (1, [9, 5], "2"), (2, [], None)):
        page(folder, n, ids, following)
    rows = sorted(read().collect(), key=lambda r: r.ordinal)
    assert [(r.tvdb_id, r.title, r.score, r.image) for r in rows] == [(i, f"t{i}", float(i), "https://a.test/a.jpg") for i in (5, 7, 9, 5)]
    assert read().rdd.getNumPartitions() == 3
    store = Store(spark, f"file://{tmp_path}/store")
    assert listed.seed(store, read())["series"] == {"listed": 3, "gone": 0}
    (folder / "1.json").unlink()
    with pytest.raises(Exception, match="but not \\[1\\]"):
        listed.seed(store, read())
    assert store.read(listed.TABLE, TVDB_TITLES).where("status = 'not_found'").isEmpty()  # no title was taken for gone
    page(folder, 1, [9], None)
    with pytest.raises(Exception, match="ends the listing"):
        read().collect()
    page(folder, 1, [9], "https://x/series?page=7")
    with pytest.raises(Exception, match="followed by"):
        read().collect()
    page(folder, 1, [9], "2")
    page(folder, 2, [4], "3")
    with pytest.raises(Exception, match="goes on"):
        read().collect()
    with pytest.raises(Exception, match="no page"):
        feeds.read_pages(spark, f"file://{new_page_folder(tmp_path)}", "series", "").collect()


def new_page_folder(tmp_path):
    (tmp_path / "empty").mkdir(exist_ok=True)
    return tmp_path / "empty"


def changes(folder, kind, start, end, ids, n=1, total=1):
    folder.mkdir(exist_ok=True)
    (folder / f"changes_{kind}_{start}_{end}-{n}.json").write_text(json.dumps({"results": [{"id": i} for i in ids], "page": n, "total_pages": total}))


def title_rows(spark, rows):
    base = {f.name: None for f in TITLES.fields} | {"media_type": "movie", "adult": 0, "attempts": 3}
    return spark.createDataFrame([tuple((base | {"tmdb_id": i, "status": s, "palette_version": v}).values()) for i, s, v in rows], TITLES)


def test_change_stream_goes_on_from_its_days(spark, tmp_path):
    folder, checkpoint, store = tmp_path / "feed", f"file://{tmp_path}/c", Store(spark, f"file://{tmp_path}/store")
    store.write("titles", title_rows(spark, [(i, "no_poster", None) for i in (1, 2, 3, 4)] + [(5, "done", 3)]))
    pending = lambda: {r.tmdb_id for r in store.read("titles", TITLES).where("status = 'pending' OR status = 'done' AND palette_version IS NULL").collect()}
    run = lambda: jobs.follow_change_feed(store, f"file://{folder}", "2025-01-01", checkpoint)
    changes(folder, "movie", "2025-01-01", "2025-01-15", [1, 0], 1, 2)
    changes(folder, "movie", "2025-01-01", "2025-01-15", [5], 2, 2)
    changes(folder, "movie", "2025-01-29", "2025-02-05", [4])  # the window before it hasn't come
    changes(folder, "tv", "2025-01-01", "2025-01-08", [1])
    run()
    assert pending() == {1, 5}
    version = store.current("titles")[0]
    run()
    assert store.current("titles")[0] == version  # nothing new, nothing written
    store.change("titles", TITLES, lambda t: t.withColumn("status", F.lit("no_poster")))
    changes(folder, "movie", "2025-01-15", "2025-01-29", [2])
    run()
    assert pending() == {2, 4}  # not 1 again
    changes(folder, "movie", "2025-02-05", "2025-02-06", [3], 2, 3)
    with pytest.raises(Exception, match="have 3 pages"):
        run()
    changes(folder, "movie", "2025-02-05", "2025-02-06", [3], 1, 3)
    changes(folder, "movie", "2025-02-05", "2025-02-06", [], 3, 3)
    run()
    assert pending() == {2, 3, 4}
    spark.dataSource.register(feeds.ChangeFeed)
    whole = spark.read.format("change_feed").option("since", "2025-01-15").option("kinds", "movie").load(f"file://{folder}")
    assert sorted((r.tmdb_id, r.start) for r in whole.collect()) == [(2, "2025-01-15"), (3, "2025-02-05"), (4, "2025-01-29")]


def dirty(spark, n):
    base = {f.name: None for f in TVDB_TITLES.fields} | {"kind": "movie", "status": "done", "dirty": 1, "attempts": 0}
    return spark.createDataFrame([tuple((base | {"tvdb_id": i, "score": float(i)}).values()) for i in range(1, n + 1)], TVDB_TITLES)


def second_refused(options):
    send = feeds.folder_target(options)

    def one(name, items):
        if name.endswith("-000001"):
            raise RuntimeError("503")
        send(name, items)

    return one


def failing(options):
    raise OSError("no target")


def test_tasks_send_and_only_what_arrived_is_acknowledged(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(listed.TABLE, dirty(spark, 95))
    send = lambda sender, **how: listed.export_from_tasks(store, 70, 20, sender=f"test_feeds:{sender}", folder=f"file://{tmp_path}/out", **how)
    first = send("second_refused", tasks=4)
    assert (first.sent, first.remaining) == (50, 45) and "1 batches" in first.refused
    left = {r.tvdb_id for r in store.read(listed.TABLE, TVDB_TITLES).where("dirty = 1").collect()}
    assert left == {*range(1, 26), *range(56, 76)}
    keys = [i["key"] for f in (tmp_path / "out").glob("*.json") for i in json.loads(f.read_text())["items"]]
    assert len(keys) == len(set(keys)) == 50 and "movie:95" in keys and "movie:60" not in keys
    version = store.current(listed.TABLE)[0]
    with pytest.raises(Exception, match="no target"):  # the job is aborted: nothing is acknowledged
        send("failing")
    assert store.current(listed.TABLE)[0] == version
    rest = listed.export_from_tasks(store, folder=f"file://{tmp_path}/out")
    assert (rest.sent, rest.remaining, rest.refused) == (45, 0, None)
    assert listed.export_from_tasks(store, folder=f"file://{tmp_path}/out").sent == 0 and store.current(listed.TABLE)[0] == version + 1


def test_payload_stream_acknowledges_each_micro_batch_once(spark, tmp_path):
    rows = lambda *n: spark.createDataFrame([(i, json.dumps({"items": [i]})) for i in n], "batch long, items string").coalesce(1)
    follow = lambda: {r.batch for r in jobs.follow_payloads(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/c", f"file://{tmp_path}/a", "test_feeds:second_refused", jobs.Budget(max_files=1), folder=f"file://{tmp_path}/out").collect()}
    rows(0).write.mode("append").parquet(f"file://{tmp_path}/in")
    rows(1, 2).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert follow() == {0}  # 2 stands behind the refused one in its task
    rows(5).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert follow() == {0, 5}
    assert sorted(f.name for f in (tmp_path / "out").glob("*.json")) == ["stream-000000.json", "stream-000005.json"]
    for f in (tmp_path / "c" / "commits").glob("2*"):  # as if the driver had been lost before the last commit
        f.unlink()
    for f in (tmp_path / "c" / "commits").glob(".2*"):
        f.unlink()
    assert follow() == {0, 5} and len(list((tmp_path / "a").glob("*.json"))) == 3


def test_a_pair_is_asked_for_once_within_the_delay(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(rows, "pair string, at string").select("pair", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        jobs.follow_requests(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/c", "2 hours")
        return sorted(r.pair for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    assert arrive(("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:05:00"), ("b", "2025-01-01 01:00:00")) == ["a", "b"]
    assert arrive(("a", "2025-01-01 01:30:00"), ("c", "2025-01-01 01:00:00")) == ["a", "b", "c"]  # in another file and run
    assert arrive(("d", "2025-01-02 00:00:00")) == ["a", "b", "c", "d"]  # the watermark goes on
    assert arrive(("a", "2025-01-02 01:00:00"), ("b", "2025-01-01 03:00:00")) == ["a", "a", "b", "c", "d"]  # b is too late


def test_a_stream_stops_between_micro_batches_and_goes_on(spark, tmp_path):
    schema = TITLES
    for k in range(5):
        title_rows(spark, [(k, "error", None)]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    whole, parts = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/parts")
    assert jobs.follow_results(whole, f"file://{tmp_path}/in", f"file://{tmp_path}/c1") == 1
    follow = lambda **b: jobs.follow_results(parts, f"file://{tmp_path}/in", f"file://{tmp_path}/c2", jobs.Budget(**b))
    assert follow(max_files=1, max_batches=2) == 2 and parts.read("titles", schema).count() == 2
    assert follow(max_files=1, max_minutes=1e-9) == 1  # the micro-batch in which the time runs out is finished
    assert follow(max_bytes=1, max_batches=1) == 1
    assert follow(max_files=1) == 1 and follow(max_files=1) == 0
    rows = lambda s: sorted((r.tmdb_id, r.status, r.attempts) for r in s.read("titles", schema).collect())
    assert rows(parts) == rows(whole) == [(k, "error", 1) for k in range(5)]
