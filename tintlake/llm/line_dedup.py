"""Operator 10: later copies of repeated line runs are deleted. DataFrame functions only.

The lines with a word of all documents, in order of document and line, are the text of a suffix array whose letters
are line ids. Only lines that occur twice can be part of a repeated run, so the others are left out and break the
text. Prefix doubling ranks the suffixes: rank k orders suffixes by their first 2^k lines and comes from the pair
(rank k-1 here, rank k-1 2^(k-1) lines on); pairs are ranked by a range-partitioned sort of the distinct pairs, whose
row numbers follow their order without any single task seeing them all. Suffixes that share their first n lines, an
LCP interval of depth n, are those that agree in rank k at their start and at n - 2^k lines on, with 2^k <= n < 2^(k+1).

A run counts if it has ``min_words`` words. Any line of such a run lies in a shortest run of that many words, either
counted forward from a line or backward from one, that repeats as well; so the intervals of those runs, of at most
``min_words`` lines, find the lines of all maximal repeated runs, and log2(min_words) doublings are enough.
In each interval the first occurrence stays and the lines of all others are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, scratch, sieved

_KEY = ("doc", "text_hash")
#: An interval of more runs than _MANY, and more than a _FEW-th of all, isn't shuffled; there are fewer than _FEW.
_MANY, _FEW = 1000, 10_000


def _once(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text_hash, body): rows that repeat a document whole, id and text, are one. Only rows that may be such
    repeats, by a bitmap of the repeated keys, are shuffled."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("body"))
    key = F.xxhash64(*_KEY)
    repeated = d.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(key.alias("k"))
    x = sieved(d, key, cut(repeated, "line-repeats"), "maybe")
    return x.where("NOT maybe").drop("maybe").unionByName(x.where("maybe").drop("maybe").dropDuplicates([*_KEY]))


def repeated_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The lines that occur twice or more, with their place ``at`` among the lines with words and the ids as ranks."""
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    d = _once(docs, doc_id, text).select(*_KEY, F.posexplode(F.filter(lines, lambda z: z.words > 0)).alias("at", "l"))
    # two seeds make 128 bits
    line_id = F.struct(F.xxhash64(F.lit(1), "l.x").alias("a"), F.xxhash64(F.lit(2), "l.x").alias("b"))
    lines = cut(d.select(*_KEY, "l.line", "at", line_id.alias("id"), "l.words"), "lines")
    often = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return lines.join(ranked(often, ["id"]), "id").select(*_KEY, "line", "at", "words", "rank")


def ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``: numbers that rise in the order of ``by``. The sort is by ranges; Spark numbers the rows of each
    range above those of the ranges before it."""
    return cut(distinct.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def deleted_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, line) of the lines in later copies of repeated runs of ``min_words`` words or more."""
    lines = repeated_lines(docs, doc_id, text)
    # stretches of consecutive repeated lines, and words up to and before each line within them
    in_doc = Window.partitionBy(*_KEY).orderBy("at")
    lines = lines.withColumn("stretch", F.col("at") - F.row_number().over(in_doc))
    own = Window.partitionBy(*_KEY, "stretch")
    upto = F.sum("words").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    # lines - 1 from a line on, and back from it, until min_words words are in; null if the stretch ends before
    last = F.struct("at", "upto")
    forward = F.max(last).over(own.orderBy("before").rangeBetween(0, min_words - 1))
    backward = F.min(F.struct("at", "before")).over(own.orderBy("upto").rangeBetween(-(min_words - 1), 0))
    lines = lines.withColumn("f", forward).withColumn("g", backward)
    lines = lines.select(
        *_KEY, "stretch", "line", "at", "rank",
        F.when(F.col("f.upto") - F.col("before") >= min_words, F.col("f.at") - F.col("at") + 1).alias("ahead"),
        F.when(F.col("upto") - F.col("g.before") >= min_words, F.col("at") - F.col("g.at") + 1).alias("behind"),
    )
    # stretches with too few words can't hold a run
    enough = F.max(F.col("ahead").isNotNull()).over(own)
    level = cut(lines.withColumn("enough", enough).where("enough").drop("enough"), "line-level")
    base, size, copies = level.drop("rank"), 1, None
    while size <= min_words:
        runs = cut(_later_copies(level, size), "line-runs")
        copies = runs if copies is None else copies.unionByName(runs)
        if size * 2 > min_words:
            break
        level = cut(_double(level, size), "line-level")
        size *= 2
    # a run is given by its first and last line; spread to lines within its stretch
    marks = copies.select(*_KEY, F.explode(F.sequence("from", "to")).alias("at")).distinct()
    marks = marks.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), F.col("at").alias("a"))
    return base.join(marks, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("at") == F.col("a"))).select(*_KEY, "line")


def _double(level: DataFrame, size: int) -> DataFrame:
    """rank by twice as many lines. Suffixes that end before have no rank any more; those that are alone keep none."""
    own = Window.partitionBy(*_KEY, "stretch").orderBy("at")
    x = level.withColumn("next", F.lead("rank", size).over(own))
    pairs = x.where(F.col("rank").isNotNull() & F.col("next").isNotNull()).groupBy(F.col("rank").alias("r"), F.col("next").alias("n")).agg(F.count("*").alias("count"))
    pairs = ranked(pairs.where("count > 1").select("r", "n"), ["r", "n"]).withColumnRenamed("rank", "new")
    return x.join(pairs, (x["rank"] == pairs["r"]) & (x["next"] == pairs["n"]), "left").select(*[c for c in level.columns if c != "rank"], F.col("new").alias("rank"))


def _later_copies(level: DataFrame, size: int) -> DataFrame:
    """(doc, text_hash, from, to) of the runs of size to 2 * size - 1 lines that occurred before."""
    ahead = level.where(F.col("ahead").between(size, 2 * size - 1)).select(*_KEY, F.col("at").alias("from"), (F.col("at") + F.col("ahead") - 1).alias("to"))
    behind = level.where(F.col("behind").between(size, 2 * size - 1)).select(*_KEY, (F.col("at") - F.col("behind") + 1).alias("from"), F.col("at").alias("to"))
    runs = ahead.unionByName(behind).distinct().withColumn("tail", F.col("to") - size + 1)
    ranks = level.where(F.col("rank").isNotNull())
    for name, at in (("r1", "from"), ("r2", "tail")):
        own = ranks.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), F.col("at").alias("a"), F.col("rank").alias(name))
        runs = runs.join(own, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col(at) == F.col("a"))).drop("d", "h", "a")
    runs = runs.withColumn("n", F.col("to") - F.col("from")).withColumn("where", F.struct(F.col("doc").isNotNull().alias("known"), "doc", "text_hash", "from"))
    runs = cut(runs, "line-places")
    # the interval of each run, and its first occurrence; a null document comes first
    same = ["n", "r1", "r2"]
    intervals = cut(runs.groupBy(*same).agg(F.min("where").alias("first"), F.count("*").alias("times")).where("times > 1"), "line-intervals")
    # one key's runs would be one task's; intervals of so many are few, and sent to where their runs are
    many = max(_MANY, runs.count() // _FEW)
    large = F.broadcast(intervals.where(F.col("times") > many).select(*same, F.col("first").alias("large")))
    runs = runs.join(large, same, "left")
    rest = runs.where("large IS NULL").drop("large").join(intervals.where(F.col("times") <= many).drop("times"), same)
    found = runs.where("large IS NOT NULL").withColumnRenamed("large", "first").unionByName(rest)
    return found.where(~F.col("where").eqNullSafe(F.col("first"))).select(*_KEY, "from", "to")


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of later copies deleted from ``text``, and (last) n_lines and n_deleted.

    Copies are ordered by document id (null first) and line; copies within a document count too. A null text stays
    null with no lines; an empty one is a line without a word; lines without a word are kept and don't part a run.
    Rows that repeat a document whole, id and text, are one document and get one result. Other columns are kept;
    clashing ones named n_lines or n_deleted are kept too, and ours get an underscore. An empty table stays empty.
    """
    with scratch() as keep:
        gone = keep(cut(deleted_lines(docs, min_words, doc_id, text).groupBy(*_KEY).agg(F.collect_set("line").alias("gone")), "line-gone"))
    names = {c: fresh(docs, c) for c in ("d", "h", "gone", "n_lines", "n_deleted", "maybe")}
    # texts that surely lose no line aren't shuffled, whatever Spark joins the others with
    x = sieved(docs, F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))), gone.select(F.xxhash64(*_KEY).alias("k")), names["maybe"])
    gone = gone.select(F.col("doc").alias(names["d"]), F.col("text_hash").alias(names["h"]), F.col("gone").alias(names["gone"]))
    some = x.where(F.col(names["maybe"])).join(gone, F.col(doc_id).eqNullSafe(F.col(names["d"])) & (F.xxhash64(F.col(text)) == F.col(names["h"])), "left")
    lines, drop = F.split(F.col(text), "\n"), F.col(names["gone"])
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(names["n_lines"])
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    cleaned = F.when(drop.isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    n_deleted = F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long").alias(names["n_deleted"])
    some = some.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns], n_lines, n_deleted)
    return x.where(~F.col(names["maybe"])).select(*docs.columns, n_lines, F.lit(0).cast("long").alias(names["n_deleted"])).unionByName(some)


def oracle(min_words: int = 50) -> str:
    """The same in DuckDB: every shortest run, forward and backward, compared by its lines themselves."""
    return f"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, CAST(len(regexp_extract_all(body, '{WORD}')) AS BIGINT) AS words FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS at, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM l1 WHERE words > 0),
ends AS (SELECT a.doc_id, a.at AS s, min(b.at) AS e FROM l2 a JOIN l2 b ON a.doc_id = b.doc_id AND b.at >= a.at AND b.upto - (a.upto - a.words) >= {min_words} GROUP BY 1, 2
         UNION SELECT b.doc_id, max(a.at) AS s, b.at AS e FROM l2 b JOIN l2 a ON a.doc_id = b.doc_id AND b.at >= a.at AND b.upto - (a.upto - a.words) >= {min_words} GROUP BY b.doc_id, b.at),
runs AS (SELECT r.doc_id, r.s, r.e, string_agg(l.body, chr(10) ORDER BY l.at) AS body FROM ends r JOIN l2 l ON l.doc_id = r.doc_id AND l.at BETWEEN r.s AND r.e GROUP BY 1, 2, 3),
later AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM runs),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM later r JOIN l2 l ON l.doc_id = r.doc_id AND l.at BETWEEN r.s AND r.e WHERE r.nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) AS text FROM l0 l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
