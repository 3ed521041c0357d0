"""What queries of posters put on disk: their pixels are shuffled once, and only small tables are written."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tintlake.operators import clusters, pixels, summaries
from tintlake.plans import cut

#: Queries, and what they may shuffle: rows by these columns.
ONCE = {
    "palette_v3": {"l_partkey", "of_"}, "compare_palettes": {"l_partkey"}, "report_summary": {"l_partkey"}, "report_candidates": {"l_partkey"}, "review_flags_of_labels": {"l_partkey"}, "review_flags": {"l_partkey"}, "palette_v2": {"l_partkey"}, "ladder_rows": {"l_partkey", "partition_by_0"}, "role_palette_of_labels": {"l_partkey"},
}


def shuffled(df):
    """Columns by which a plan's rows are shuffled, and how many shuffles that are."""
    found = re.findall(r"Exchange \w+\((\w+)#\d+L?[^)]*\)", df._jdf.queryExecution().executedPlan().toString())
    return set(found), len(found)


@pytest.mark.parametrize("name", sorted(ONCE))
def test_pixels_are_shuffled_once(spark, sf, name):
    before, folder = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), cut.shared_folder(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = set(cut._OPEN[0])
        columns, n = shuffled(__spark_entry__.queries()[name](spark, sf))
        written = [p.removeprefix(f"{folder}/").rsplit("-", 1)[0] for p in cut._OPEN[0] if p not in made]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert columns == ONCE[name] and n == len(columns)
    assert set(written) <= {"logo-clusters", "logos"}  # at most two colours a poster


def test_shuffles_of_a_written_table_are_gone(spark):
    files = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in b}
    before = files()
    cut.materialise(spark.range(1000).repartition(3, "id"), "t", tidy=True)
    assert not {f for f in files() - before if f.endswith(".data")}


def test_summaries_are_what_grouping_gives(spark, sf):
    """Counts of clusters in their posters' rows, held against the same by grouping pixels."""
    from tintlake import queries

    x = cut.materialise(clusters.cluster(pixels.sampled(queries.pixel_table(spark, sf), 60, 90), clusters.V3), "pixels")
    got = summaries.of(x).select("poster", F.inline("clusters")).where("label >= 0")
    want = pixels.coverage(x.where("label >= 0")).selectExpr("poster", "label", "n", "share", "chroma AS mean_chroma", "lightness AS ll", "lightness_std AS spread")
    raw = pixels.centres(x.where("label >= 0"))
    for more in (pixels.centred_share(x), pixels.grid_presence(x), pixels.largest_region(x), pixels.neighbour_contrast(x, raw)):
        want = want.join(more, ["poster", "label"])
    both = got.select(want.columns).unionAll(want.select(want.columns)).groupBy("poster", "label").agg(F.count("*").alias("k"), *[(F.max(c) - F.min(c)).alias(c) for c in want.columns[2:]])
    far = both.agg(F.min("k"), F.max("k"), *[F.max(c) for c in want.columns[2:]]).first()
    assert far[0] == far[1] == 2 and max(far[2:]) < 1e-9
