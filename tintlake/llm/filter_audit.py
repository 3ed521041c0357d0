"""Operator 11: what each of five filters removes, alone and after the others, in every order.

Each task splits its texts into words, numbers the words that it sees and keeps a sparse document-term matrix as a shard
in compressed rows: where each document's row begins, the words' numbers, and how often they occur. Shards' vocabularies
are then dealt out by word and sorted, which numbers the words of all shards, and each shard's columns are renumbered;
so only distinct words of shards are shuffled, once, never words of documents. Sums of rows are words,
numbers of entries are distinct words; with the flags that the text itself gives, and the first document of each text,
every document has the set of filters that it fails. All 120 orders follow from the at most 32 counts of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, scratch, small_batches, tidy

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A shard is closed after the batch of texts that takes it to so many words.
SHARD_WORDS = 1 << 21
_ROW = "doc_id: long, part: string, text_hash: binary, fails: string"
#: Words of a bucket of the dictionary, about.
BUCKET = 1 << 16
#: Offsets, columns and counts (int32) of a matrix in compressed rows, each as ``_packed``.
SHARD = f"shard long, documents array<struct<{_ROW}>>, offsets binary, columns binary, counts binary, n_vocabulary int, vocabulary array<string>"
#: The matrix: offsets and counts (int32), columns as the dictionary numbers them (int64), little-endian.
MATRIX = f"shard long, documents array<struct<{_ROW}>>, offsets binary, columns binary, counts binary"
_ROWS = pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("text_hash", pa.binary()), ("fails", pa.string())]))


def _packed(x: np.ndarray) -> bytes:
    """Differences of int32 numbers, compressed: columns grow within a row, and new words have numbers in a row."""
    raw = np.diff(x, prepend=0).astype("<i4").tobytes()
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(x: pa.Buffer) -> np.ndarray:
    size = int.from_bytes(x[:4].to_pybytes(), "little")
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(x[4:], size), "<i4"), dtype=np.int32)


def _flags(texts: pa.Array) -> list[str]:
    """Of each text the failures that its characters decide: C, over 3 % of its code points are A-Z; D, a symbol."""
    many = pc.greater(pc.multiply(pc.count_substring_regex(texts, "[A-Z]"), 100), pc.multiply(pc.utf8_length(texts), 3))
    symbol = pc.match_substring_regex(texts, "[#$%&*|]")
    return ["C" * c + "D" * d for c, d in zip(many.to_pylist(), symbol.to_pylist())]


def _rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each has."""
    lists = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    word = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty strings
    return flat.filter(word), np.bincount(row[word.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 33
    documents: list[dict] = []
    words: list[pa.Array] = []
    sizes: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        nonlocal shard
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        v = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(documents)), np.concatenate(sizes))
        entry, n = np.unique(row * v + coded.indices.to_numpy(), return_counts=True)
        offsets = np.append(0, np.cumsum(np.bincount(entry // v, minlength=len(documents))))
        whole = lambda x: pa.array([_packed(x)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        out = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([documents], _ROWS), whole(offsets), whole(entry % v), whole(n), pa.array([len(coded.dictionary)], pa.int32()), lists],
            ["shard", "documents", "offsets", "columns", "counts", "n_vocabulary", "vocabulary"],
        )
        shard += 1
        for x in (documents, words, sizes):
            x.clear()
        return out

    for batch in batches:
        texts = pc.fill_null(batch.column(2), "")
        found, n = _rows(texts)
        hashes = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
        documents += [dict(doc_id=i, part=p or "", text_hash=h, fails=f) for i, p, h, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes, _flags(texts))]
        words.append(found)
        sizes.append(n)
        if sum(map(len, words)) >= SHARD_WORDS:
            yield closed()
            tidy()
    if documents:
        yield closed()


def _renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for offsets, local, counts, at, ids in zip(*(b.column(i) for i in range(2, 7))):
            offsets, local, counts = (_unpacked(x.as_buffer()) for x in (offsets, local, counts))
            number = np.full(int(local.max(initial=-1)) + 1, -1, np.int64)
            if at.is_valid:
                number[at.values.to_numpy()] = ids.values.to_numpy()
            if (number < 0).any():
                raise ValueError("a word of a shard isn't in the dictionary")
            out.append([offsets.tobytes(), number[local].astype("<i8").tobytes(), counts.tobytes()])
        blobs = [pa.array([x[i] for x in out], pa.binary()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *blobs], ["shard", "documents", "offsets", "columns", "counts"])
        tidy()


def term_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The dictionary (word, id, n_shards) and the shards (MATRIX) of the sparse document-term matrix.

    Words are maximal runs of anything but ASCII white space, as they are. Null texts are empty and give empty rows;
    each row of ``docs`` has a row, whatever its id. An id is a word's bucket and its place among the bucket's words in
    their order, so it depends on the words and the number of buckets alone.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(part).cast("string").alias("part"), F.col(text).cast("string").alias("text"))
    shards = cut(rows.mapInArrow(_shards, SHARD), "audit-shards")
    buckets = (shards.agg(F.sum("n_vocabulary").alias("n")).first().n or 0) // BUCKET + 1
    words = shards.select("shard", F.posexplode("vocabulary").alias("at", "word"))
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("long")
    numbered = words.select("shard", "at", "word", (F.shiftleft("bucket", 32) + place).alias("id"))
    dictionary = numbered.groupBy("word", "id").agg(F.count("*").alias("n_shards"))
    # at most a shard's vocabulary each; both lists are filled row by row, so they match
    ids = numbered.groupBy("shard").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("ids")).withColumnRenamed("shard", "s")
    coded = shards.join(ids, F.col("shard") == F.col("s"), "left").select("shard", "documents", "offsets", "columns", "counts", "at", "ids")
    return dictionary, coded.mapInArrow(_renumbered, MATRIX)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for documents, offsets, columns, counts in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
            offsets, counts = np.frombuffer(offsets.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4")
            entries = np.append(0, np.cumsum(np.frombuffer(columns.as_buffer(), "<i8") >= 0))  # a row's entries are different words
            total = np.append(0, np.cumsum(counts, dtype=np.int64))
            rows = documents.values
            out = dict(zip(("doc_id", "part", "text_hash", "fails"), rows.flatten()))
            out |= {"n_words": pa.array(np.diff(total[offsets])), "n_distinct": pa.array(np.diff(entries[offsets]))}
            yield pa.RecordBatch.from_pydict(out)
        tidy()


def row_sums(matrix: DataFrame) -> DataFrame:
    """Per document its doc_id, part, text_hash and fails as in the matrix, n_words (the sum of its row) and n_distinct
    (the number of its entries)."""
    return matrix.select("documents", "offsets", "columns", "counts").mapInArrow(_sums, _ROW.replace(":", "") + ", n_words long, n_distinct long")


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part and set of failed filters (``fails``, letters of FILTERS): n documents, good (quality 1) and toxic ones.

    A: under 200 words; B: distinct words are under half of them; C: over 3 % of code points are A-Z; D: a symbol of
    #$%&*|; E: the text is that of a smaller doc_id. Null parts are the empty string, null texts empty texts. A null
    doc_id is neither smaller nor larger than others and has no labels; rows that repeat an id and a text all count,
    none of them as a copy of the other. Of several labels of an id, one that is 1 is enough.
    """
    with scratch() as keep:
        _, matrix = term_matrix(docs, doc_id, text, part)
        rows = row_sums(matrix)
        a, b = F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words")
        known = F.concat(F.when(a, "A").otherwise(""), F.when(b, "B").otherwise(""), F.col("fails"))
        # repeated rows become one, so neither an id nor a text with a third of all rows is a group of that size below
        rows = cut(rows.groupBy("doc_id", "text_hash", "part", known.alias("fails")).agg(F.count("*").alias("n")), "audit-rows")
        first = rows.where("doc_id IS NOT NULL").groupBy(F.col("text_hash").alias("h")).agg(F.min("doc_id").alias("first"))
        copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.join(first, (F.col("doc_id") == F.col("first")) & (F.col("text_hash") == F.col("h")), "left")
        rows = cut(rows.select("doc_id", "part", F.concat("fails", F.when(copy, "E").otherwise("")).alias("fails"), "n"), "audit-flags")
        given = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("labelled"))
        given = given.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("q"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"))
        zero = F.lit(0).cast("long")
        marked = rows.join(given, F.col("doc_id") == F.col("labelled")).select("part", "fails", zero.alias("n"), (F.col("n") * F.col("q")).alias("good"), (F.col("n") * F.col("t")).alias("toxic"))
        both = rows.select("part", "fails", "n", zero.alias("good"), zero.alias("toxic")).unionAll(marked)
        return keep(cut(both.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "audit-counts"))


def orders(counts: DataFrame) -> DataFrame:
    """From ``failures``: per part, order of the five filters and step what the filter of that letter does there."""
    x = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    x = x.withColumn("letter", F.expr("substr(filter_order, step, 1)")).withColumn("before", F.expr("substr(filter_order, 1, step - 1)"))
    x = x.withColumn("failing", F.expr("instr(fails, letter) > 0")).withColumn("gone", F.expr("length(translate(before, fails, '')) < step - 1"))
    here = F.col("failing") & ~F.col("gone")
    # a document that fails k filters is removed by each of them in the k-th part of all orders
    share = F.expr(f"n * ({len(ORDERS)} div greatest(length(fails), 1))")
    total = lambda when, c=F.col("n"): F.sum(F.when(when, c).otherwise(0))
    return x.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(~F.col("failing") & ~F.col("gone")).alias("kept"), total(here).alias("removed"), total(F.col("failing") & F.col("gone")).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"), total(here, F.col("good")).alias("good_lost"), total(here, F.col("toxic")).alias("toxic_lost"),
        total(F.col("failing"), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of a table: 600 rows for each part that occurs (see ``failures`` for what fails), none for an empty table."""
    return orders(failures(docs, labels, doc_id, text, part))


#: The same in DuckDB, with the words of each text as a list.
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
given AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
f AS (SELECT part, q, t.doc_id, CAST(g.t AS INT) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fail FROM t LEFT JOIN given g ON t.doc_id = g.doc_id),
c AS (SELECT part, fail, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, list_aggregate(list_transform(o, lambda i: chr(64 + i::INT)), 'string_agg', '') AS filter_order, i AS step, o[i] AS f, n, good, toxic, fail[o[i]] AS failing,
  list_bool_or(list_transform(o[1:i - 1], lambda j: fail[j])) IS TRUE AS gone, len(list_filter(fail, lambda x: x)) AS fails FROM c, o, l),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (failing AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
