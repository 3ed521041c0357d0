"""Operator 8: near-duplicate documents by min-max hashing.

Under each of ``PERMUTATIONS`` random maps of the 64-bit shingle hashes both the least and the greatest value are
kept: two coordinates a map, each of which agrees for two sets with probability J. The coordinates make ``BANDS``
bands of ``ROWS``; a pair of similarity 0.75 meets in no band with probability (1 - 0.75^4)^40 < 3e-7.

1. Documents with one shingle set are one class, numbered; all that follows is between classes.
2. Classes that meet in a band's bucket are candidates. A bucket isn't expanded into pairs: its members are compared
   with one of them, its pivot, if they meet it in several buckets or in a bucket of two, and the links that hold join
   components. A bucket whose members all lie in one component has nothing left to say; what classes of several
   components still share a bucket are compared across components, by an exact prefix filter.
3. A candidate is a link if the full shingle sets say so. Sets are read again for classes that share a bucket only: a
   bitmap of bounded size lets their documents through, and few others, so texts aren't shuffled.
4. Components come from alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, fresh, scratch, sieved, small_batches, tidy

SHINGLE = 5
BANDS, ROWS = 40, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Buckets in which a class must meet a pivot of more than two members to be compared at once. Two sets of similarity
#: 0.75 meet in 12.7 on average; those that meet in fewer are compared across components.
MEETINGS = 4
#: Sizes of one class of sizes differ by this factor at most.
SIZE_STEP = 1.05
#: Classes that a shingle may have in one task.
HOT = 10_000

_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_ARROW = pa.struct([("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and offsets of the maps; factors of a shingle's words; factors of a band's coordinates."""
    rng = np.random.default_rng(7)
    draw = lambda *n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(PERMUTATIONS, 1), draw(PERMUTATIONS, 1), draw(SHINGLE), draw(ROWS)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only are lowered, and ASCII white space parts words
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n, factors = len(words) - SHINGLE + 1, _constants()[2]
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * factors[i]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """uint64 [2 * PERMUTATIONS]: least and greatest value of each map."""
    a, b, _, _ = _constants()
    least, most = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 4096):
        x = s[None, at : at + 4096] * a + b
        least, most = np.minimum(least, x.min(axis=1)), np.maximum(most, x.max(axis=1))
    return np.stack([least, most], axis=1).ravel()


def bands(s: np.ndarray) -> np.ndarray:
    """int64 [BANDS]: a key for each band, different between bands. A band has both coordinates of ROWS / 2 maps."""
    rows = signature(s).reshape(BANDS, ROWS)
    return _mix((rows * _constants()[3]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@F.arrow_udf(_SKETCH)
def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for text in batch:
            s = shingle_set(text.as_py(), hashes)
            rows.append({"n": len(s), "node": xxhash.xxh3_128_digest(s.tobytes()), "bands": bands(s)} if len(s) else {"n": 0, "node": None, "bands": None})
        yield pa.array(rows, _ARROW)
        tidy()


@F.arrow_udf(T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))
def sets_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The class and the shingle set of each text."""
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(x.as_py(), hashes).tobytes() for x in batch]
        yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])
        tidy()


@F.arrow_udf(T.BooleanType())
def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether 100 * intersection >= 75 * union, of two sets as bytes."""
    for left, right in batches:
        out = []
        for x, y in zip(left, right):
            a = np.frombuffer(x.as_buffer(), np.uint64)
            b = np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            out.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield pa.array(out, pa.bool_())
        tidy()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links (a, b), by alternating large-star and small-star."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the least of it and its neighbours
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lesser neighbours go to the least of these
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        lesser = edges.join(least, "a")
        edges = cut(lesser.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@F.arrow_udf(T.ArrayType(T.LongType()))
def set_array(sets: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in sets], pa.list_(pa.int64()))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP))).cast("int")


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that can be similar, by exact prefix filtering.

    Only shingles that two components or more have can be in an intersection. A class's are ranked, rare ones first.
    A similar pair of n and m <= n shingles has 7 * intersection >= 3 * (n + m), so from the first shingle that it
    shares in this order on, both have that many left. The larger set looks for it where enough is left for a partner
    of a size that it can have (0.75 n at least), by classes of sizes; the smaller one is found where 7 * left >= 6 *
    m. So text that many share, but that isn't enough for a link by itself, is never looked up. A shingle that very
    many classes have is dealt out to several tasks.
    """
    own = sets.join(members.select("id", "root").distinct(), "id").withColumn("n", (F.octet_length("shingles") / 8).cast("int"))
    shingles = cut(own.select("id", "root", "n", F.explode(set_array("shingles")).alias("shingle")), "shingles")
    several = shingles.groupBy("shingle").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("df")).where("r1 <> r2").select("shingle", "df")
    by_id = Window.partitionBy("id")
    left = (F.count("*").over(by_id) - F.row_number().over(by_id.orderBy("df", "shingle")) + 1).cast("int")
    x = shingles.join(several, "shingle").withColumn("left", left).where("4 * left >= 3 * n")
    x = cut(x.withColumn("parts", F.ceil(F.col("df") / HOT).cast("int")).drop("df"), "prefixes")
    most = F.least(F.col("n"), F.floor(7 * F.col("left") / 3).cast("int") - F.col("n"))
    sizes = F.sequence(_size_class(F.ceil(F.col("n") * 0.75)), _size_class(most))
    probes = x.where(4 * most >= 3 * F.col("n")).select("shingle", "parts", F.explode(sizes).alias("size"), F.col("id").alias("p"), F.col("root").alias("rp"), "n", "left")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = x.where("7 * left >= 6 * n").select("shingle", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), _size_class(F.col("n")).alias("size"), F.col("id").alias("q"), F.col("root").alias("rq"), F.col("n").alias("m"), F.col("left").alias("left_q"))
    could = (F.col("rp") != F.col("rq")) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("p") > F.col("q")))) & (7 * F.least("left", "left_q") >= 3 * (F.col("n") + F.col("m")))
    pairs = probes.join(found, ["shingle", "size", "part"]).where(could)
    return pairs.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


class _Classes:
    """The classes of a table of documents, and what is found of them on the way."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.docs = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        s = self.docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s"))
        self.sketches = cut(s.select("doc_id", "text_hash", "s.*"), "sketches")
        rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
        found = self.sketches.where("n > 0").groupBy("node").agg(F.min(rep).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        # numbers are read from the table, so they stay what they are
        self.classes = cut(found.select(F.monotonically_increasing_id().alias("id"), "node", "first", "n", "bands"), "classes")

    def members(self) -> DataFrame:
        """(band, id, n, size, pull) of the buckets with two classes or more. pull: how many others a class meets in
        all its buckets; copies of one text meet that text most often, so it pulls most and makes the best pivot."""
        rows = self.classes.select(F.explode("bands").alias("band"), "id", "n")
        shared = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
        found = cut(rows.join(shared, "band"), "buckets")
        return cut(found.join(found.groupBy("id").agg(F.sum("size").alias("pull")), "id"), "members")

    def sets(self, members: DataFrame) -> DataFrame:
        """(id, shingles) of the classes that share a bucket."""
        wanted = cut(self.classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "node", F.xxhash64("first.doc_id", "first.text_hash").alias("key")), "wanted")
        docs = sieved(self.docs, F.xxhash64("doc_id", F.xxhash64("text")), wanted.select("key"), "maybe")
        found = docs.where("maybe").select(sets_of("text").alias("s")).select("s.*").dropDuplicates(["node"])
        return cut(found.join(wanted, "node").select("id", "shingles"), "sets")

    def links(self) -> DataFrame | None:
        """(a, b) of similar classes, enough of them for the components; None if no bucket is shared."""
        members = self.members()
        if members.isEmpty():
            return None
        sets = self.sets(members)
        x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

        def hold(pairs: DataFrame) -> DataFrame:
            return cut(pairs.join(x, "a").join(y, "b").where(similar("x", "y")).select("a", "b"), "links")

        pivots = members.groupBy("band").agg(F.max(F.struct("pull", "id", "n")).alias("p")).select("band", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"))
        could = 4 * F.least("n", "m") >= 3 * F.greatest("n", "m")  # the sizes alone rule many out
        met = members.join(pivots, "band").where((F.col("id") != F.col("pivot")) & could)
        met = met.groupBy(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).agg(F.count("*").alias("times"), F.min("size").alias("size"))
        pairs = cut(met.where((F.col("times") >= MEETINGS) | (F.col("size") == 2)).select("a", "b"), "pairs")
        links = hold(pairs)
        members = members.select("band", "id").join(components(links), F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        members = cut(members, "members")
        several = members.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("size")).where("r1 <> r2 AND size > 2").select("band")
        left = cut(members.join(several, "band"), "members")
        if left.isEmpty():
            return links
        more = _across(left, sets).join(pairs, ["a", "b"], "left_anti")
        return links.unionByName(hold(cut(more, "pairs")))


def _labelled(docs: DataFrame, doc_id: str, text: str, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``label`` of, per document: (doc_id, text_hash, n, node, first). node: its class, null without shingles; first:
    the least (no_id, doc_id, text_hash) of its component, so null ids come last. The tables on the way are deleted."""
    with scratch() as keep:
        c = _Classes(docs, doc_id, text)
        links = c.links()
        own = c.classes.select("id", "node", "first")
        if links is not None:
            ids = cut(components(links).select(F.col("node").alias("id"), "root").join(own, "id").select("id", "root", "first"), "roots")
            linked = ids.join(ids.groupBy("root").agg(F.min("first").alias("least")), "root").select("id", "least")
            own = own.join(linked, "id", "left").select("node", F.coalesce("least", "first").alias("first"))
        own = cut(own.select("node", "first"), "components")
        return keep(cut(label(c.sketches.select("doc_id", "text_hash", "n", "node").join(own, "node", "left")), "labelled"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (doc_id, n_shingles, component_id, kept, text_hash).

    Shingle sets are of 64-bit hashes of five lower-cased (A-Z) words; links hold at 100 * intersection >= 75 * union.
    Null, empty and blank texts have no shingles and are linked with nothing. component_id is the smallest id of the
    component, null ids left aside; kept is whether that is the row's own id, so rows that repeat the smallest id
    are all kept, and a null id is kept only where its component has no other. An empty table gives an empty one.
    Other columns aren't read.
    """

    def label(x: DataFrame) -> DataFrame:
        x = x.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")))
        return x.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")

    return _labelled(docs, doc_id, text, label)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, with the same columns, and all rows without shingles (linked with nothing).

    The row is one with the smallest id, null ids last, and of its texts the one with the least hash; of rows that
    repeat both, any one stays. Rows that surely go nowhere near the list of what goes are passed on as they are; only
    the others are shuffled, and joined with it exactly.
    """

    def label(x: DataFrame) -> DataFrame:
        """(key, gone) of the documents, by id and text, that go or of which one row of several stays."""
        gone = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
        x = x.where("node IS NOT NULL").groupBy(F.struct("doc_id", "text_hash").alias("key")).agg(F.max(gone).alias("gone"), F.count("*").alias("rows"))
        return x.where("gone OR rows > 1").select("key", "gone")

    marks = _labelled(docs, doc_id, text, label)
    names = {c: fresh(docs, c) for c in ("marked", "key", "maybe")}
    text_hash = F.xxhash64(F.col(text))
    x = sieved(docs, F.xxhash64(F.col(doc_id), text_hash), marks.select(F.xxhash64("key.doc_id", "key.text_hash").alias("k")), names["maybe"])
    maybe = F.col(names["maybe"]) & F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    once = x.where(maybe).withColumn(names["key"], F.struct(F.col(doc_id).alias("doc_id"), text_hash.alias("text_hash"))).dropDuplicates([names["key"]])
    gone = marks.where("gone").select(F.col("key").alias(names["marked"]))
    once = once.join(gone, F.col(names["key"]) == F.col(names["marked"]), "left_anti")
    return x.where(~maybe).select(*docs.columns).unionByName(once.select(*docs.columns))


#: The same in DuckDB, from the shingles themselves: every pair that shares one is counted, and reachability is recursive.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM w),
x AS (SELECT r, CAST(len(s) AS BIGINT) AS n, unnest(s) AS shingle FROM s),
both_ AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM x a JOIN x b ON a.shingle = b.shingle AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ WHERE 100 * i >= 75 * (n + m - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS t FROM s UNION SELECT x.r, e.b FROM reach x JOIN edges e ON x.t = e.a),
least_ AS (SELECT x.r, min(s.doc_id) AS component_id FROM reach x JOIN s ON s.r = x.t GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id IS NOT DISTINCT FROM l.component_id AS kept FROM s JOIN least_ l USING (r)
"""
