"""Operator 6: mix sources to target weights with hash-threshold histograms. DataFrame functions only.

Every document has a 36-bit hash of its id. A source's budget beyond whole passes over it is met by taking the
documents whose hash lies under a threshold. The threshold comes from a histogram of words by source and the top
12 bits; only the bucket in which the budget ends is split by the next 12 bits, and that bucket's end by the last
12. No documents are sorted, each histogram has at most 4096 rows a source, and a larger budget takes a superset.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, scratch

#: Hash bits, and the bits that each histogram adds.
HASH_BITS, LEVEL_BITS = 36, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """The document's place in [0, 2^36), the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    Sources by code point, null last, have the weights in turn. A target stops at ``most`` times its source's size
    and what is over goes to the others by weight; that is a water level: with sources in the order of
    limit / weight, those below the level stay at their limit. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    x = per_source.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    x = x.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    x = x.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "stopped": F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_weight": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "turn": F.row_number().over(by_ratio),
    })
    x = x.withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("stopped")) / F.col("open_weight"))
    x = x.withColumn("stops", F.col("limit") <= F.col("weight") * F.col("level"))
    x = x.withColumn("level", F.min_by("level", F.when(~F.col("stops"), F.col("turn"))).over(everything))
    target = F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * F.col("level"))
    return x.select("source", "source_size", target.alias("target"))


def budgets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, passes, below): a document is taken ``passes`` times, and once more if its
    place is under ``below``. ``sized`` has (source, size, place)."""
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    some = F.col("source_size") > 0
    plan = plan.withColumn("passes", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = cut(plan, "mix-plan")
    end = plan.select("source", "rest", F.lit(0).cast("long").alias("cell"))
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # the cell in which each source's budget ends, one level finer: it has at most 2^LEVEL_BITS cells inside
        inside = F.shiftright("place", bits + LEVEL_BITS)
        docs = sized.withColumn("outer", inside)
        end = end.select(F.col("source").alias("s"), F.col("cell").alias("c"), "rest")
        found = docs.join(end, docs.source.eqNullSafe(end.s) & (docs.outer == end.c))
        cells = found.groupBy("source", F.shiftright("place", bits).alias("cell")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        end = cells.groupBy("source").agg(*[F.min_by(c, "cell").alias(c) for c in ("words", "upto", "rest")], F.min("cell").alias("cell"))
        end = end.withColumn("rest", F.col("rest") - (F.col("upto") - F.col("words")))
        end = cut(end, "mix-end")
    # the last cell is taken if that comes nearer to the target
    below = F.col("cell") + F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)
    end = end.select(F.col("source").alias("s"), below.alias("below"))
    plan = plan.join(end, plan.source.eqNullSafe(end.s), "left")
    return cut(plan.select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(1 << HASH_BITS)).alias("below")), "mix-budgets")


def times(size: Column) -> Column:
    """How often a document is taken, by the columns of ``budgets`` and its place."""
    return F.when(size > 0, F.col("passes") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).otherwise(0)


def mix_sizes(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """Per document: (doc_id, size, source_size, target, taken).

    taken is the words that the mix takes of it, repeats counted: whole documents, so a source misses its target by
    at most half of the documents in one of its 2^36 hash cells (rows that repeat an id share a cell and their fate).
    Null and empty texts have size 0 and nothing taken; an empty table gives an empty one; a null source is a
    source. Other columns aren't read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), place(F.col(doc_id)).alias("place"))
    with scratch() as keep:
        sized = keep(cut(sized, "mix-sized"))
        b = keep(budgets(sized, weights, share, most)).withColumnRenamed("source", "s")
    joined = sized.join(b, sized.source.eqNullSafe(b.s))  # Spark broadcasts b, one row a source, if it is small by its own size check
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("size"))).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the same columns.

    Documents without a word, whose copies no budget counts, stay out.
    """
    names = {c: fresh(docs, c) for c in ("size", "place", "s", "source_size", "target", "passes", "below", "copy")}
    own = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), place(F.col(doc_id)).alias("place"))
    with scratch() as keep:
        b = keep(budgets(cut(own, "mix-sized"), weights, share, most))
    b = b.select(F.col("source").alias(names["s"]), F.col("passes").alias(names["passes"]), F.col("below").alias(names["below"]))
    joined = docs.join(b, docs[source].eqNullSafe(b[names["s"]]))
    once_more = F.when(place(F.col(doc_id)) < F.col(names["below"]), 1).otherwise(0)
    # whether a text has a word at all needs no count
    copies = F.when(F.col(text).rlike(WORD), F.col(names["passes"]) + once_more).otherwise(0).cast("int")
    return joined.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(c) for c in docs.columns])


def oracle(weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> str:
    """The same rows in DuckDB, with one exact running sum in place of the histograms."""
    turns = " ".join(chain.from_iterable((f"WHEN {i} THEN {float(w)}",) for i, w in enumerate(weights)))
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS place FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM src),
weighed AS (SELECT *, CASE nth % {len(weights)} {turns} END::DOUBLE AS weight, source_size * {float(most)}::DOUBLE AS lim FROM named),
run AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, row_number() OVER r AS turn,
         coalesce(sum(lim) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS stopped,
         sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
         FROM weighed WINDOW r AS (ORDER BY lim / weight, nth)),
lev AS (SELECT *, (total * {float(share)}::DOUBLE - stopped) / open_weight AS level FROM run),
st AS (SELECT *, lim <= weight * level AS stops FROM lev),
fin AS (SELECT source, source_size, CASE WHEN stops THEN lim ELSE weight * (SELECT arg_min(level, turn) FROM st WHERE NOT stops) END AS target FROM st),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM fin),
cells AS (SELECT source, place, sum(size)::DOUBLE AS words FROM sized GROUP BY source, place),
upto AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM cells),
pick AS (SELECT u.source, u.place, (u.upto <= p.target - p.passes * p.source_size
           OR (u.upto - u.words <= p.target - p.passes * p.source_size AND 2 * (p.target - p.passes * p.source_size - (u.upto - u.words)) >= u.words)) AS more
         FROM upto u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.passes + CASE WHEN k.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN pick k ON k.source IS NOT DISTINCT FROM s.source AND k.place = s.place
"""
