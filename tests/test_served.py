"""Reads that prune and changes that rewrite little: postings of trigrams, and the catalogue in directories of ids."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tintlake.operators import catalogue, postings, search
from tintlake.plans.served import Served
from tintlake.schemas import TITLES


def metrics(df):
    """Rows and files that the scans of a query read; it has no exchange."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    value = lambda leaf, name: leaf.metrics().get(name).get().value()
    return [(value(leaves.apply(i), "numOutputRows"), value(leaves.apply(i), "numFiles")) for i in range(leaves.size())]


def test_postings_give_what_a_scan_gives(spark, tmp_path):
    words = ["Matrix", "THE MATRIX", "Émile", "éMILE zola", "100% Wolf", "a_b", "ab", "", None, "matmat", "İstanbul", "strasse", "Straße", "日本語の本", "42 steps"]
    rows = [("movie" if i % 2 else "tv", i, w, float(i % 7) if i % 5 else None, "done" if i % 3 else "pending") for i, w in enumerate(words * 3)]
    titles = spark.createDataFrame(rows, "media_type string, tmdb_id long, title string, popularity double, status string")
    folder = f"file://{tmp_path}/p"
    postings.build(titles, folder)
    for q in ("MAT", "émile", "0% W", "a_b", "ab", "zzz", "42", "straß", "本語の", "i̇stan", "  zola "):
        for how in ({}, {"media_type": "tv", "status": "done", "limit": 3, "offset": 1})[: 1 + (q == "MAT")]:
            want = [tuple(r) for r in search.search(titles, q, **how).collect()]
            assert [tuple(r) for r in postings.search_indexed(spark, folder, titles, q, **how).select(titles.columns).collect()] == want, q
    plan = postings.search_indexed(spark, folder, titles, "matrix")._jdf.queryExecution().toString()
    assert plan.count("FileScan") == 1 and "gram" in plan.split("PushedFilters")[1]  # postings alone, by their trigram
    with pytest.raises(ValueError):
        postings.search_indexed(spark, folder, titles, "x" * 201)


def title_rows(spark, ids):
    base = {f.name: None for f in TITLES.fields} | {"adult": 0, "attempts": 0, "status": "done", "updated_at": "2026-01-01"}
    return spark.createDataFrame([tuple((base | {"media_type": m, "tmdb_id": i, "title": f"t{i}"}).values()) for m, i in ids], TITLES)


def test_reads_open_the_directories_that_they_need(spark, tmp_path):
    served = Served(spark, f"file://{tmp_path}/t", span=100)
    assert served.read().isEmpty()
    served.publish(title_rows(spark, [(m, i) for m in ("movie", "tv") for i in range(1, 1001)]))
    assert served.read().count() == 2000
    rows, files = metrics(served.get("movie", 777))[0]
    assert files == 1 and rows <= 100 and [r.title for r in served.get("movie", 777).collect()] == ["t777"]
    assert served.get("tv", 5000).isEmpty() and metrics(served.get("tv", 5000))[0][1] == 0
    assert [r.tmdb_id for r in served.page("tv", 899, 3).collect()] == [900, 901, 902]
    scans = served.page("tv", 899, 3)
    scans.collect()
    assert served.read().where("media_type = 'tv' AND shard >= 9").count() == 101
    assert "PartitionFilters" in scans._jdf.queryExecution().toString() and "shard" in scans._jdf.queryExecution().toString().split("PartitionFilters")[1].split("]")[0]


def test_a_change_leaves_other_files_as_they_are(spark, tmp_path):
    served = Served(spark, f"file://{tmp_path}/t", span=100)
    served.publish(title_rows(spark, [("movie", i) for i in range(1, 1001)]))
    names = lambda: {f.relative_to(tmp_path).parent.as_posix(): f.name for f in Path(tmp_path / "t").rglob("*.parquet")}
    before = names()
    results = spark.createDataFrame([("movie", 250, "error"), ("movie", 251, "no_poster"), ("movie", 2000, "no_poster"), ("tv", 7, "error")], "media_type string, tmdb_id long, status string")
    assert served.change(results, catalogue.save) == 3
    after = names()
    changed = {d for d in after if before.get(d) != after[d]}
    assert changed == {"t/media_type=movie/shard=2", "t/media_type=movie/shard=20", "t/media_type=tv/shard=0"} and set(before) <= set(after)
    got = {(r.media_type, r.tmdb_id): r for r in served.read().collect()}
    assert len(got) == 1002 and got["movie", 250].attempts == 1 and got["movie", 251].status == "no_poster" and got["movie", 252].status == "done" and got["tv", 7].status == "error"
    assert served.change(results.where("false"), catalogue.save) == 0
    assert served.change(results, lambda t, n: t.withColumn("title", F.lit("x"))) == 3 and served.read().where("title = 'x'").count() == 102


def test_a_directory_takes_no_more_than_its_rows(spark, tmp_path):
    served = Served(spark, f"file://{tmp_path}/t", span=100)
    served.publish(title_rows(spark, [("movie", i) for i in range(1, 501)]))
    sizes = [f.stat().st_size for f in Path(tmp_path / "t").rglob("*.parquet")]
    assert len(sizes) == 6 and max(sizes) < 50_000  # the filter of the ids is as large as 100 ids need
    assert [r.tmdb_id for r in served.get("movie", 321).collect()] == [321]
