"""Operator 9: the licence of each file, by TF-IDF cosine to templates and inheritance from directories.

A header is a run of lines of a whole text: a line by itself, or from any line the fewest lines with so many words as
templates of a class of lengths have. A header, and the whole text of a file (a licence file), is a sparse TF-IDF
vector, and its licence is that of the template with the greatest cosine, if that reaches a threshold. Document
frequencies are counted over all files: for template words by word, for all others by one of ``BUCKETS`` hash buckets,
which bounds the table. By Cauchy-Schwarz a vector that shares no heavy word of a template, its anchors, can't reach
the threshold, so headers without an anchor aren't scored; nothing is lost by that.

A file that is nothing but licence text, by its name or its lines, is the licence of its directory; a file without a
header of its own has the licence of the nearest directory above it that has one. That is found per directory, by
joining its ancestors with the licensed directories.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches
from .licenses import TEMPLATES

FILE_NAMES = ("license", "licence", "copying", "unlicense")
MARKS = string.punctuation

_FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("line", T.IntegerType()), T.StructField("only", T.BooleanType())])
_ARROW = pa.struct([("license", pa.string()), ("score", pa.float64()), ("line", pa.int32()), ("only", pa.bool_())])


def words_of(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(MARKS))]


#: Buckets of the document frequencies of words that no template has.
BUCKETS = 1 << 16
#: Parts of each directory in the last join.
SALTS = 16
Templates = dict[str, tuple[str, ...]]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """idf of template words and of buckets, templates as (licence, unit vector), words that one of them is in ``by``."""

    idf: dict[str, float]
    other: np.ndarray
    templates: tuple[tuple[str, dict[str, float]], ...]
    anchors: frozenset[str]
    lengths: tuple[int, ...]
    threshold: float

    def weight(self, word: str) -> float:
        return self.idf.get(word) or float(self.other[bucket(word)])


def model(n_files: int, df: dict[str, int], buckets: dict[int, int], threshold: float = 0.7, given: Templates = TEMPLATES) -> Model:
    weight = lambda n: math.log((1 + n_files) / (1 + n)) + 1
    bags = [(name, Counter(words_of(t))) for name, texts in given.items() for t in texts if words_of(t)]
    idf = {w: weight(df.get(w, 0)) for _, bag in bags for w in bag}
    other = np.full(BUCKETS, weight(0))
    for b, n in buckets.items():
        other[b] = weight(n)
    templates, anchors = [], set()
    for name, bag in bags:
        norm = math.sqrt(math.fsum((n * idf[w]) ** 2 for w, n in bag.items()))
        v = {w: n * idf[w] / norm for w, n in bag.items()}
        templates.append((name, v))
        # cosine^2 is at most the sum of squares of the shared words; without the anchors that is under threshold^2. Rare
        # words first: a common one that a template repeats would let nearly all texts through
        rest = 1.0
        for w in sorted(v, key=lambda w: (-idf[w], w)):
            if rest < threshold**2 - 1e-9:
                break
            anchors.add(w)
            rest -= v[w] ** 2
    # a class of lengths for each power of the root of 2
    lengths = {round(2 ** (math.ceil(2 * math.log2(sum(bag.values()))) / 2)) for _, bag in bags}
    return Model(idf, other, tuple(templates), frozenset(anchors), tuple(sorted(lengths)), threshold)


def closest(count: Counter, m: Model) -> tuple[str | None, float]:
    """The licence nearest to the words, with the cosine; none under the threshold. Ties go to the first template."""
    x = {w: n * m.weight(w) for w, n in count.items()}
    norm = math.sqrt(math.fsum(v * v for v in x.values()))
    best, name = 0.0, None
    for licence, v in m.templates:
        small, large = (x, v) if len(x) < len(v) else (v, x)
        cosine = math.fsum(y * large[w] for w, y in small.items() if w in large) / norm
        if cosine > best + 1e-12:
            best, name = cosine, licence
    return (name, min(1.0, best)) if best >= m.threshold else (None, best)


def headers(sizes: list[int], hot: list[int], m: Model) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of lines that are headers and have one of the ``hot`` lines, by first and last line.
    sizes: words by line, none 0."""
    upto = np.cumsum([0, *sizes])
    hot_lines = np.array(hot)
    ends = {n: np.searchsorted(upto, upto[:-1] + n, "left") - 1 for n in m.lengths}
    for first in range(len(sizes)):
        found = {first, *[int(e[first]) for e in ends.values() if e[first] < len(sizes)]}
        if max(found) < (at := int(hot_lines[min(len(hot) - 1, int(np.searchsorted(hot_lines, first)))])) or at < first:
            continue
        for last in sorted(found):
            if last >= at:
                yield first, last


def scan(text: str | None, m: Model) -> dict:
    """The best header of a whole text, the first of equal ones; ``only``: whether each line with words lies in a
    header that states a licence, or the whole text states one."""
    best = {"license": None, "score": 0.0, "line": None, "only": False}
    if not text or m.anchors.isdisjoint(words_of(text)):
        return best
    lines = [(i, w) for i, x in enumerate(text.split("\n")) if (w := words_of(x))]
    hot = [k for k, (_, w) in enumerate(lines) if not m.anchors.isdisjoint(w)]
    stated = 0  # lines before this lie in headers that state a licence, or don't
    covered, at = True, -1
    count: Counter = Counter()
    for first, last in headers([len(w) for _, w in lines], hot, m):
        if first != at:
            at, upto, count = first, first, Counter()
        for k in range(upto, last + 1):
            count.update(lines[k][1])
        upto = last + 1
        name, score = closest(count, m)
        if name is not None:
            covered, stated = covered and first <= stated, max(stated, last + 1)
            if score > best["score"] + 1e-12:
                best |= {"license": name, "score": score, "line": lines[first][0]}
    if covered and stated == len(lines):
        return best | {"only": True}
    name, score = closest(Counter(w for _, ws in lines for w in ws), m)
    if name is not None:
        best |= {"only": True} | ({"license": name, "score": score, "line": lines[0][0]} if score > best["score"] + 1e-12 else {})
    return best


class _Bare(dict):
    """(word without marks, bucket) by word as it stands in a text."""

    def __missing__(self, word: str) -> tuple[str, int]:
        if len(self) > 50_000:
            self.clear()
        bare = word.strip(MARKS)
        found = self[word] = (bare, bucket(bare))
        return found


def train(files: DataFrame, text: str, threshold: float, given: Templates = TEMPLATES) -> Model:
    """Document frequencies over all files: a number for each template word and each bucket comes to the driver. A word
    counts once a file; two of one bucket count as one."""
    known = frozenset(w for texts in given.values() for t in texts for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        buckets, bare, files = np.zeros(BUCKETS, np.int64), _Bare(), 0
        for batch in batches:
            for t in batch.column(0):
                found = [bare[w] for w in set((t.as_py() or "").lower().split())]
                n.update({w for w, _ in found} & known)
                buckets[np.unique(np.fromiter((b for w, b in found if w), np.int64))] += 1
                files += 1
        some = np.flatnonzero(buckets)
        rows = [("", -1, files), *((w, -1, k) for w, k in n.items()), *((None, b, k) for b, k in zip(some.tolist(), buckets[some].tolist()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64()))], ["word", "bucket", "n"])

    found = files.select(text).mapInArrow(count, "word string, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in found if r.word is not None}
    return model(df.pop("", 0), df, {r.bucket: r.n for r in found if r.word is None}, threshold, given)


def found_column(text: str, m: Model) -> Column:
    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scan(x.as_py(), m) for x in batch], _ARROW)

    return run(F.col(text))


def scan_licenses(files: DataFrame, threshold: float = 0.7, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates: Templates = TEMPLATES) -> DataFrame:
    """Per file: path, the columns of ``keep``, license, score and line (from 0) of its own header (null without),
    inherited_from (the directory whose licence it has, if it has none itself) and effective (its licence).

    A null path has no directory and inherits nothing; a path without '/' lies in the root ''. Of several licence
    files in a directory the one with the greatest score counts, then the first licence by name. Null and empty texts
    have no header. Files that repeat a path are judged each by itself. An empty table gives an empty one. Columns of
    ``keep`` named like one of ours get an underscore. Other columns aren't read.
    """
    ours = ("path", "license", "score", "line", "inherited_from", "effective")
    named_ = {c: c if c.lower() not in ours else c + "_" for c in keep}
    own = small_batches(files).select(F.col(path).alias("path"), F.struct(F.lit(0).alias("0"), *[F.col(c).alias(named_[c]) for c in keep]).alias("keep"), F.col(text).alias("text"))
    m = train(own, "text", threshold, templates)
    here = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    x = own.select("path", "keep", found_column("text", m).alias("f"), here.alias("directory"), name.rlike(f"^({'|'.join(FILE_NAMES)})([.-].*)?$").alias("named"))
    x = cut(x.select("path", "keep", "directory", "named", "f.*"), "licenses")
    stated = x.where((F.col("named") | F.col("only")) & F.col("license").isNotNull() & F.col("directory").isNotNull())
    licensed = stated.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select(F.col("directory").alias("above"), F.col("best.license").alias("given"))
    # each directory's ancestors, itself first; nearest is longest
    directories = x.where("directory IS NOT NULL AND license IS NULL").select("directory").distinct()
    parts = F.filter(F.split("directory", "/"), lambda p: p.isNotNull())
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = directories.select("directory", F.explode(F.array_distinct(above)).alias("above"))
    nearest = chain.join(licensed, "above").groupBy("directory").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("n"))
    # a directory may hold a third of all files, so each is dealt out to several tasks
    nearest = nearest.select(F.col("directory").alias("d"), F.col("n.above").alias("inherited_from"), F.col("n.given").alias("given"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("path", "keep"), F.lit(SALTS)).cast("int")
    out = x.join(nearest, (x.directory == nearest.d) & (salt == nearest.salt) & x.license.isNull(), "left")
    score = F.when(F.col("license").isNotNull(), F.col("score"))
    return out.select("path", *[F.col("keep")[c].alias(c) for c in named_.values()], "license", score.alias("score"), "line", "inherited_from", F.coalesce("license", "given").alias("effective"))


def scan_documents(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``scan_licenses`` of a corpus without paths: a document is a file named by its id in a directory for its
    language within one for its source ('none' where that is null)."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), threshold, keep=("doc_id",))
