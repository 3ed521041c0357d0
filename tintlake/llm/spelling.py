"""Operator 13: spelling variants of frequent words, by a bidirectional FM-index over the vocabulary.

Two words differ by one code point exactly if one half of the first stands unchanged at its end of the second and the
rest matches with one error. So every word is searched twice: its first half after a delimiter, then to the right over
the second half with one error; its second half before a delimiter, then to the left over the first. What the second
search finds counts only if the first can't have found it.

The vocabulary is sorted, by words for the first search and by reversed words for the second, and cut into shards of
bounded size; a shard is an index of its own, the delimited words as one text with its suffix ranks. All words that
begin with a half lie in a row, so a query goes to the shard, or the few, whose range meets that half. Only links and
their sums leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches, tidy

# What a run of letters is, and whose runs lose a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
DELETED_OF = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a shard, and the most shards: their bounds are what every task gets.
SHARD, MOST_SHARDS = 1 << 13, 1 << 15
#: Code points of a shard's bound that are told; a bound is a place in the order, so a cut one is as good.
BOUND = 32
LINKS = "word string, n long, near string, near_n long"
#: Of a word in one shard: how many near words, and the best of them.
SUMS = "word string, n long, n_near long, near string, near_n long"
#: Distinct results that a task holds before it hands them on.
HELD = 300_000
#: Words searched side by side, and the most cells of their table of letters.
TOGETHER, CELLS = 2048, 1 << 22
# Symbols of a shard's text: its end sorts before the delimiter, that before the letters in the order of code points.
_END, _MARK, _BITS = 0, 1, 7
_CODE = np.zeros(256, np.uint8)
_CODE[[*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]] = np.arange(2, 92)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re
    import zlib
    from collections import Counter

    run, held = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LENGTH), {}  # shorter runs have no result that counts

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return b

    for batch in batches:
        lower = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
        for doc_id, text in zip(batch.column(0).to_pylist(), lower):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for w, n in Counter(run.findall(text.as_py())).items():
                h = zlib.crc32(w.encode(), start)
                if h % DELETED_OF == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < LEAST_LENGTH:
                        continue
                held[w] = held.get(w, 0) + n
        if len(held) >= HELD:
            yield out()
            tidy()
    yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words (word, n) that occur LEAST_COUNT times in all texts, with at least LEAST_LENGTH code points.

    A run of letters counts with A-Z in lower case. Of the runs whose crc32 of `<doc_id>:<run>` DELETED_OF divides, the
    code point at that number modulo the length is left out first. A null id is empty text there; a null or empty text
    has no runs; rows that repeat an id count each by itself.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of a text of 7-bit symbols, whose last is the least and occurs once, in order; by doubled prefixes."""
    n, width = len(codes), 8
    padded = np.append(codes, np.zeros(width, codes.dtype)).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << _BITS | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        if rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        key, width = rank * (n + 1) + later, 2 * width


class Ranks:
    """The last column of a text's sorted rotations as a wavelet matrix: how often a symbol, and lesser ones, stand in
    an interval of suffix ranks, for many intervals at once."""

    def __init__(self, codes: np.ndarray):
        column = codes[suffix_array(codes) - 1]
        self.first = np.append(0, np.cumsum(np.bincount(column, minlength=1 << _BITS)))[:-1]
        self.ones, self.zeros = [], []
        for level in range(_BITS):
            bit = column >> (_BITS - 1 - level) & 1
            self.ones.append(np.append(0, np.cumsum(bit, dtype=np.int64)))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            column = np.concatenate((column[bit == 0], column[bit == 1]))
        symbols = np.arange(1 << _BITS)
        self.leaf = np.zeros(len(symbols), np.int64)
        self.leaf = self.narrow(np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64), symbols)[0] - self.first

    def narrow(self, lo: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the pattern with one symbol ``c`` more, its size, and how many lesser symbols stood there."""
        hi, less = lo + size, np.zeros(len(lo), np.int64)
        for level in range(_BITS):
            ones, bit = self.ones[level], (c >> (_BITS - 1 - level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            less += np.where(bit, hi - lo - b + a, 0)
            lo, hi = np.where(bit, self.zeros[level] + a, lo - a), np.where(bit, self.zeros[level] + b, hi - b)
        return self.first[c] + lo - self.leaf[c], hi - lo, less

    def children(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols of each interval: the interval's number, the symbol, and what ``narrow`` gives for it."""
        of, c, hi = np.arange(len(lo)), np.zeros(len(lo), np.int64), lo + size
        for level in range(_BITS):
            a, b = self.ones[level][lo], self.ones[level][hi]
            zero, one = hi - b > lo - a, b > a
            of, c = np.concatenate((of[zero], of[one])), np.concatenate((2 * c[zero], 2 * c[one] + 1))
            lo, hi = np.concatenate(((lo - a)[zero], self.zeros[level] + a[one])), np.concatenate(((hi - b)[zero], self.zeros[level] + b[one]))
        order = np.lexsort((c, of))
        of, c, lo, size = of[order], c[order], lo[order], (hi - lo)[order]
        before = np.cumsum(size) - size
        fresh_of = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        return of, c, self.first[c] + lo - self.leaf[c], size, before - np.repeat(before[fresh_of], np.diff(np.append(np.flatnonzero(fresh_of), len(of))))


class Index:
    """A bidirectional FM-index of distinct words between delimiters; ``words`` is sorted by code points."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        text = np.array([_MARK], np.uint8)
        if words:
            letters = np.frombuffer("\n".join(["", *self.words, ""]).encode("latin-1"), np.uint8)
            text = np.where(letters == 10, _MARK, _CODE[letters]).astype(np.uint8)
        self.forward, self.backward = Ranks(np.append(text, np.uint8(_END))), Ranks(np.append(text[::-1], np.uint8(_END)))

    def near(self, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's number and that of a word one error away, each once. ``right``: first halves exact, the
        error in what follows; else second halves exact, the error before, without what the other search finds."""
        size = np.array([len(q) for q in queries])
        half = size // 2 if right else size - size // 2
        text = np.full((len(queries), int(size.max(initial=0)) + 1), _MARK, np.int64)
        for i, q in enumerate(queries):
            text[i, : len(q)] = _CODE[np.frombuffer((q if right else q[::-1]).encode("latin-1"), np.uint8)]
        ranks = self.backward if right else self.forward
        # what repeats the letter at the border between the halves is found from both sides
        border = text[np.arange(len(queries)), half]
        same = np.logical_and.accumulate(np.where(np.arange(text.shape[1]) < half[:, None], True, text == border[:, None]), axis=1).sum(1)
        twin = text[np.arange(len(queries)), half - 1] == border

        # a state: query, symbols of it that are used, interval here and in the other direction, interval's size
        q = np.arange(len(queries))
        mark = np.zeros(len(q), np.int64) + _MARK
        n_marks = len(self.words) + 1
        at, a, b, n = np.zeros(len(q), np.int64), ranks.first[mark], ranks.first[mark], np.full(len(q), n_marks)
        exact = []
        while len(q):
            done = at == half[q]
            exact.append([x[done] for x in (q, at, a, b, n)])
            q, at, a, b, n = (x[~done] for x in (q, at, a, b, n))
            c = text[q, at]
            a, n, less = ranks.narrow(a, n, c)
            b, at = b + less, at + 1
            q, at, a, b, n = (x[n > 0] for x in (q, at, a, b, n))
        q, at, a, b, n = (np.concatenate(x) for x in zip(*exact)) if exact else (np.zeros(0, np.int64),) * 5
        once = []
        while len(q):
            of, c, a2, n2, less = ranks.children(a, n)
            b2, expected = b[of] + less, text[q, at]
            letter, other, last = c > _MARK, c != expected[of], at == size[q]
            put = letter & other  # before an equal letter it is the same as after it
            drop = ~last & (text[q, np.minimum(at + 1, text.shape[1] - 1)] != expected)  # so for one of equal letters
            if not right:
                put &= (at[of] > half[q[of]]) & ~((c == border[q[of]]) & (at[of] <= same[q[of]]))
                drop &= ~(twin[q] & (at < same[q]))
            swap = letter & other & ~last[of]
            once += [[q[of][put], at[of][put], a2[put], b2[put], n2[put]], [q[of][swap], at[of][swap] + 1, a2[swap], b2[swap], n2[swap]], [q[drop], at[drop] + 1, a[drop], b[drop], n[drop]]]
            go = letter & ~other
            q, at, a, b, n = q[of][go], at[of][go] + 1, a2[go], b2[go], n2[go]
        found = []
        q, at, a, b, n = (np.concatenate(x) for x in zip(*once)) if once else (np.zeros(0, np.int64),) * 5
        while len(q):
            c = text[q, at]
            a, n, less = ranks.narrow(a, n, c)
            b, at = b + less, at + 1
            whole = (n > 0) & (c == _MARK)
            # suffixes that begin with a delimiter: the last one of the text, then one a word in their order
            found.append((q[whole], (b if right else a)[whole] - ranks.first[_MARK] - 1))
            go = (n > 0) & (c != _MARK)
            q, at, a, b, n = (x[go] for x in (q, at, a, b, n))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _parts(queries: list[str]) -> Iterator[list[int]]:
    """Numbers of queries of like length, few enough to search side by side."""
    part: list[int] = []
    for i in sorted(range(len(queries)), key=lambda i: len(queries[i])):
        if part and (len(part) >= TOGETHER or (len(part) + 1) * (len(queries[i]) + 1) > CELLS):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _searcher(right: bool, summed: bool) -> Callable:
    """Over rows sorted by shard, its words before its queries: links, or their sums a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, index, counts, queries = None, {}, None, np.zeros(0, np.int64), []

        def searched() -> Iterator[pa.RecordBatch]:
            nonlocal index, counts
            if index is None:
                index = Index(list(words))
                counts = np.array([words[w] for w in index.words], np.int64)
            for part in _parts([w for w, _ in queries]):
                text, own = [queries[i][0] for i in part], np.array([queries[i][1] for i in part], np.int64)
                q, at = index.near(text, right)
                order = np.lexsort((at, -counts[at], q))
                q, at = q[order], at[order]
                names, columns = ["word", "n", "near", "near_n"], []
                if summed:
                    best, total = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q, np.bincount(q, minlength=len(part))
                    q, at = q[best], at[best]
                    names, columns = ["word", "n", "n_near", "near", "near_n"], [pa.array(total[q], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([text[i] for i in q], pa.string()), pa.array(own[q]), *columns, pa.array([index.words[i] for i in at], pa.string()), pa.array(counts[at])], names)
            queries.clear()

        for batch in batches:
            for s, query, w, n in zip(*(x.to_pylist() for x in batch.columns)):
                if s != shard:
                    yield from searched()
                    shard, words, index = s, {}, None
                if query:
                    queries.append((w, n))
                    if len(queries) >= 4 * TOGETHER:
                        yield from searched()
                else:
                    words[w] = n
        yield from searched()
        tidy()

    return run


def _router(bounds: list[tuple[str, int]], right: bool) -> Callable:
    """Copies each word to the shards that may hold words with its exact half. bounds: first keys of shards, in order."""
    from bisect import bisect_left, bisect_right

    keys, shards = [k for k, _ in bounds], [s for _, s in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                half = w[: len(w) // 2] if right else w[: len(w) // 2 - 1 : -1]
                first, last = max(0, bisect_left(keys, half[:BOUND]) - 1), bisect_right(keys, half + "\uffff")
                out += [(s, w, n) for s in shards[first:last]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "word", "n"])

    return run


def _search(words: DataFrame, right: bool, summed: bool, size: int | None) -> DataFrame:
    """``words`` is a written table: it is counted, sorted into shards and searched."""
    total = words.count()
    shards = max(1, -(-total // (size or SHARD)))
    shards = min(shards, MOST_SHARDS)
    key = F.col("word") if right else F.reverse("word")
    members = cut(words.repartitionByRange(shards, key).select(F.spark_partition_id().alias("shard"), "word", "n"), "spelling-shards")
    # a row per shard, at most MOST_SHARDS of at most BOUND letters
    bounds = members.groupBy("shard").agg(F.substring(F.min(key), 1, BOUND).alias("k")).collect()
    bounds = sorted((r.k, r.shard) for r in bounds)
    queries = words.select("word", "n").mapInArrow(_router(bounds, right), "shard int, word string, n long")
    rows = members.select("shard", F.lit(False).alias("query"), "word", "n").unionAll(queries.select("shard", F.lit(True), "word", "n"))
    rows = rows.repartition(max(1, len(bounds)), "shard").sortWithinPartitions("shard", "query")
    return rows.mapInArrow(_searcher(right, summed), SUMS if summed else LINKS)


def near_words(words: DataFrame, size: int | None = None) -> DataFrame:
    """All pairs of words one inserted, deleted or replaced code point apart (LINKS), from both sides. ``words``: distinct
    words of the letters a-z and U+00C0 to U+00FF, of two at least, and their counts n. ``size``: words of a shard."""
    words = cut(small_batches(words).select("word", "n"), "spelling-words")
    return _search(words, True, False, size).unionAll(_search(words, False, False, size))


def roots(forms: DataFrame) -> DataFrame:
    """From each word and its form, which occurs twice as often or more, the end of the way: word, root.

    Ways are doubled each round; counts are below 2^63, so none has more than 62 forms, and six rounds are enough.
    """
    up = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(6):
        more = up.select(F.col("word").alias("w"), F.col("root").alias("next"))
        joined = cut(up.join(more, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        up = joined.select("word", "root")
        up.materialised_at = joined.materialised_at
        if joined.where("moved").isEmpty():
            break
    return up


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int | None = None) -> DataFrame:
    """Per word of ``vocabulary``: word, form, root, n, n_near, form_n.

    Of the near words the one with the largest n, of equals the smallest in code-point order, is the form if its n is at
    least twice the word's; else form and form_n are null and the word is its own root. An empty table, and one whose
    texts have no word often enough, gives no rows. Other columns aren't read.
    """
    with scratch() as keep:
        words = keep(cut(vocabulary(docs, doc_id, text), "spelling-words"))
        sums = _search(words, True, True, size).unionAll(_search(words, False, True, size))
        best = sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"), F.first("n").alias("n"))
        best = best.withColumn("best_n", -F.col("best.m")).withColumn("is_form", F.col("best_n") >= 2 * F.col("n"))
        best = keep(cut(best.select(F.col("word").alias("w"), "n_near", F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n")), "spelling-best"))
        ends = keep(roots(best.where("form IS NOT NULL").select(F.col("w").alias("word"), "form")))
        x = words.join(best, F.col("word") == F.col("w"), "left").drop("w").join(ends.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
        return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
