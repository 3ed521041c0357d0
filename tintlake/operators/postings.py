"""Search by substring through postings of trigrams, instead of a scan of all titles.

A posting is a row of a trigram and a title that has it, with the columns that search shows and orders by; rows lie in
order of trigram and key, so the statistics of Parquet lead to those of one trigram. A search reads the postings of the
rarest trigram of its text alone, and checks them by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

SIZE = 3


def grams(text: Column) -> Column:
    """The different runs of SIZE code points of a text in lower case; none of shorter texts."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - SIZE + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(SIZE))))


def build(titles: DataFrame, folder: str) -> None:
    """Writes the postings of titles (media_type, tmdb_id, title, popularity, status) below ``folder``, and how many each
    trigram has. A common trigram is many rows in as many files as they take, never one list."""
    rows = titles.select(F.explode(grams(F.col("title"))).alias("gram"), "media_type", "tmdb_id", "title", "popularity", "status")
    order = ["gram", "media_type", "tmdb_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/postings")
    n = titles.sparkSession.read.schema("gram string").parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    n.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")


def search_indexed(spark: SparkSession, folder: str, titles: DataFrame, q: str = "", limit: int = 20, offset: int = 0, media_type: str | None = None, status: str | None = None) -> DataFrame:
    """What ``search.search`` gives for the titles that the postings are of. Texts shorter than a trigram, and numbers,
    which may be ids, are searched for in ``titles``."""
    wanted = [g for g in spark.range(1).select(grams(F.lit(q.strip())).alias("g")).first().g]
    if not wanted or q.strip().isdecimal():
        return search.search(titles, q, limit, offset, media_type, status)
    # a row per trigram of the text, which is of 200 code points at most
    search.bounded(len(q), 0, search.LIMITS["query"], "length")
    known = {r.gram: r.n for r in spark.read.schema("gram string, n long").parquet(f"{folder}/grams").where(F.col("gram").isin(wanted)).collect()}
    rarest = min(wanted, key=lambda g: (known.get(g, 0), g))
    rows = spark.read.parquet(f"{folder}/postings").where(F.col("gram") == rarest).drop("gram")
    return search.search(rows, q, limit, offset, media_type, status)
