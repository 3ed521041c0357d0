"""Operator 3: documents that hold benchmark items, by BM25 over an inverted index of the items.

The index holds the test items; every passage of every document is a query. Items are indexed by classes of their
length: the step of a class is the next power of two, 32 at least, and its passages are windows of two steps, one
step apart, so each item lies whole in some window, and what is found of an item doesn't depend on the others'
lengths. A posting's weight is its BM25 weight divided by the sum of the item's weights: a passage scores the share
of the item's weight that its words cover, and one threshold serves all items. All items above it are retrieved:

* an item's heaviest terms, its head, carry more of its weight than may be missing, so a passage above the threshold
  has some of them. Postings of heads alone, summed for all windows of a batch at once, leave few windows and items;
* block-max WAND retrieves from these: items lie in blocks of ``BLOCK``; the pivot is the first item that the terms'
  maxima could lift over the threshold, blocks that can't are leapt over, and only the rest is scored.

What is retrieved is then verified on word shingles of the item's question and of its answer. The benchmark is
searched in shards of items, one pass over the documents and one table of hits for each, so only one shard at a time
is in the driver and the tasks.
"""

from __future__ import annotations

import functools
import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, scratch, sieved, small_batches, tidy

BLOCK = 2
MARKS = string.punctuation + "…“”„«»¿¡‘’–—"
#: Words of a shingle in the verification.
SHINGLE = 5
#: Words of the texts that are searched together, and characters of the parts in which a long text is read.
BATCH_WORDS = 100_000
SLICE = 1 << 20

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation around them."""
    return [x for w in (text or "").lower().split() if (x := w.strip(MARKS))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's two parts: what follows its last question mark, or else its last sentence, is the answer."""
    at = text.rstrip().rfind("?")
    if at < 0 or not words_of(text[at + 1 :]):
        ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n", text.rstrip())]
        at = ends[-1] - 1 if ends else len(text)
    return words_of(text[: at + 1]), words_of(text[at + 1 :])


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str]) -> float | None:
    """The share of a part's shingles that the passage has; null for an empty part. A short part is one shingle."""
    if not part:
        return None
    n = min(SHINGLE, len(part))
    own = shingles(part, n)
    return len(own & shingles(passage, n)) / len(own)


@dataclass
class Index:
    """The items of one length class in order of their ids, with their postings by term."""

    item_ids: list[int | None]
    parts: list[tuple[list[str], list[str]]]
    postings: dict[int, list[int]]  # by term: items, rising
    weights: dict[int, list[float]]
    most: dict[int, float]
    block_most: dict[int, dict[int, float]]
    #: postings of the items' heads: those of term t are [head_ends[t], head_ends[t + 1])
    head_ends: np.ndarray
    head_items: np.ndarray
    head_weights: np.ndarray
    #: what the head terms of a passage must weigh at least, by item
    need: np.ndarray
    step: int
    threshold: float

    @property
    def n_blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK)


@dataclass
class Shard:
    term: dict[str, int]
    classes: list[Index]


def step_of(n_words: int) -> int:
    return max(32, 1 << (n_words - 1).bit_length())


def _index(items: list[tuple[int | None, str, dict[int, float]]], n_terms: int, step: int, threshold: float) -> Index:
    """items: id, text and the share of the item's weight that each term has."""
    postings: dict[int, list[int]] = {}
    weights: dict[int, list[float]] = {}
    heads: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
    need = np.zeros(len(items))
    for at, (_, _, share) in enumerate(items):
        for t, w in share.items():
            postings.setdefault(t, []).append(at)
            weights.setdefault(t, []).append(w)
        head = 0.0
        for t, w in sorted(share.items(), key=lambda x: (-x[1], x[0])):
            if head >= 1 - threshold / 2:
                break
            head += w
            heads[t].append((at, w))
        need[at] = head - (1 - threshold)
    block_most: dict[int, dict[int, float]] = {}
    for t, own in postings.items():
        found = block_most[t] = {}
        for i, w in zip(own, weights[t]):
            found[i // BLOCK] = max(w, found.get(i // BLOCK, 0.0))
    ends = np.cumsum([0, *map(len, heads)])
    flat = [x for h in heads for x in h]
    most = {t: max(w) for t, w in weights.items()}
    parts = [question_and_answer(t) for _, t, _ in items]
    return Index([i for i, _, _ in items], parts, postings, weights, most, block_most, ends, np.array([i for i, _ in flat], np.int64), np.array([w for _, w in flat]), need, step, threshold)


def build(rows: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_length: float, threshold: float, k1: float = 1.2, b: float = 0.75) -> Shard:
    """Indexes of some items, with the document frequencies and mean length of all."""
    term: dict[str, int] = {}
    classes: dict[int, list[tuple[int | None, str, dict[int, float]]]] = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        words = words_of(text)
        if not words:
            continue
        weight = {}
        for w, tf in Counter(words).items():
            idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
            weight[w] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean_length))
        total = sum(weight.values())
        classes.setdefault(step_of(len(words)), []).append((i, text, {term.setdefault(w, len(term)): x / total for w, x in weight.items()}))
    return Shard(term, [_index(items, len(term), step, threshold) for step, items in sorted(classes.items())])


def wand(terms: list[int], x: Index, allowed: list[int]) -> list[tuple[int, float]]:
    """Block-max WAND: (item, score) of all items in the ``allowed`` blocks (rising) whose score reaches the threshold."""
    need, far = x.threshold - 1e-9, len(x.item_ids)
    most = x.most
    cursor = [[x.postings[t][0], 0, t] for t in terms]
    out = []

    def seek(c: list[int], item: int) -> None:
        t = c[2]
        c[1] = bisect_left(x.postings[t], item, c[1])
        c[0] = x.postings[t][c[1]] if c[1] < len(x.postings[t]) else far

    while True:
        cursor.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursor):
            if c[0] >= far:
                break
            bound += most[c[2]]
            if bound >= need:
                pivot = k
                break
        if pivot < 0:
            return out
        item = cursor[pivot][0]
        while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK
        nth = bisect_left(allowed, block)
        if nth == len(allowed):
            return out
        if allowed[nth] > block:
            for c in cursor:  # no item before the next allowed block can reach the threshold
                if c[0] < allowed[nth] * BLOCK:
                    seek(c, allowed[nth] * BLOCK)
        elif sum(x.block_most[c[2]].get(block, 0.0) for c in cursor[: pivot + 1]) < need:
            leap = (block + 1) * BLOCK
            if pivot + 1 < len(cursor):
                leap = min(leap, cursor[pivot + 1][0])
            for c in cursor[: pivot + 1]:
                seek(c, leap)
        elif cursor[0][0] == item:
            score = math.fsum(x.weights[c[2]][c[1]] for c in cursor[: pivot + 1])
            if score >= need:
                out.append((item, score))
            for c in cursor[: pivot + 1]:
                seek(c, item + 1)
        else:
            for c in cursor[:pivot]:
                if c[0] < item:
                    seek(c, item)


def candidates(ids: np.ndarray, half: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs, in order, whose head terms weigh enough. A window is two half windows, the one of its
    number and the next; a term that both have counts twice here, which only lets more through."""
    own = np.flatnonzero(ids >= 0)
    own = own[x.head_ends[ids[own] + 1] > x.head_ends[ids[own]]]
    n_terms, n_items = len(x.head_ends) - 1, len(x.item_ids)
    pairs = np.unique(half[own] * n_terms + ids[own])
    h, t = pairs // n_terms, pairs % n_terms
    n = x.head_ends[t + 1] - x.head_ends[t]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.head_ends[t], n)
    key, weight = np.repeat(h, n) * n_items + x.head_items[place], x.head_weights[place]
    key, at = np.unique(np.concatenate([key, key - n_items]), return_inverse=True)
    enough = np.bincount(at, np.concatenate([weight, weight]), len(key)) >= x.need[key % n_items] - 1e-9
    key = key[enough & (key >= 0)]
    return key // n_items, key % n_items


class Numbers(dict):
    """Term number by word as it stands in the text: -1 for words that no item has, -2 for mere punctuation."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term = term

    def __missing__(self, word: str) -> int:
        bare = word.strip(MARKS)
        n = self.term.get(bare, -1) if bare else -2
        if len(self) > 50_000:
            self.clear()
        self[word] = n
        return n


def slices(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters, cut at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def _numbers(text: str, number: Numbers) -> np.ndarray:
    found = []
    for part in slices(text):
        words = part.lower().split()
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        found.append(ids[ids > -2])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def passage_of(text: str, start: int, n: int) -> list[str]:
    """Words start to start + n - 1 of a text."""
    out: list[str] = []
    seen = 0
    for part in slices(text):
        words = words_of(part)
        out += words[max(0, start - seen) : max(0, start + n - seen)]
        seen += len(words)
        if seen >= start + n:
            break
    return out


def search(texts: list[str | None], shard: Shard, question: float, answer: float) -> list[list[dict]]:
    """The verified hits of each text: of each item, the one with the greatest score, and of these the first."""
    out: list[list[dict]] = [[] for _ in texts]
    number, at = Numbers(shard.term), 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size < BATCH_WORDS):
            held.append((at, _numbers(texts[at] or "", number)))
            size += len(held[-1][1])
            at += 1
        ids = np.concatenate([i for _, i in held])
        for x in shard.classes:
            # half windows, numbered through; one more, empty, at the end of each text keeps its windows apart
            first = np.cumsum([0, *[len(i) // x.step + 2 for _, i in held]])
            half = np.concatenate([f + np.arange(len(i)) // x.step for f, (_, i) in zip(first, held)]).astype(np.int64)
            windows, items = candidates(ids, half, x)
            new = np.flatnonzero(np.diff(windows, prepend=-1))
            best: dict[tuple[int, int], dict] = {}
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(windows)]):
                k = int(np.searchsorted(first, windows[a], "right")) - 1
                if windows[a] == first[k + 1] - 1:
                    continue
                doc, start = held[k][0], int(windows[a] - first[k]) * x.step
                terms = np.unique(held[k][1][start : start + 2 * x.step])
                found = wand([t for t in terms.tolist() if t in x.postings], x, np.unique(items[a:b] // BLOCK).tolist())
                passage = passage_of(texts[doc], start, 2 * x.step) if found else []
                for item, score in found:
                    q, r = (overlap(p, passage) for p in x.parts[item])
                    if (q is None or q >= question) and (r is None or r >= answer) and score > best.get((doc, item), {"score": 0.0})["score"] + 1e-12:
                        best[doc, item] = {"item_id": x.item_ids[item], "score": score, "question": q, "answer": r, "first_word": start, "last_word": start + len(passage) - 1}
            for (doc, _), hit in sorted(best.items()):
                out[doc].append(hit)
    return out


def shards(benchmark: DataFrame, threshold: float, shard_items: int) -> Iterator[Shard]:
    """The benchmark's items, about ``shard_items`` at a time; statistics are those of the whole benchmark, and hits
    don't depend on the shards."""
    items = cut(benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct(), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"term": [w for c in found for w in c], "n": [c[w] for c in found for w in c]}, pa.schema([("term", pa.string()), ("n", pa.int64())]))

    df = cut(items.select("text").mapInArrow(terms, "term string, n long").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "terms")
    n_items = items.count()
    length = (df.agg(F.sum("n").alias("n")).first().n or 0) / max(1, n_items)
    n_shards = -(-n_items // shard_items)
    for k in range(n_shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)) == k)
        mine = rows.select("text").mapInArrow(terms, "term string, n long").select("term").distinct()
        frequency = {r.term: r.df for r in df.join(mine, "term").select("term", "df").collect()}
        yield build([(r.item_id, r.text) for r in rows.collect()], frequency, n_items, max(1.0, length), threshold)


def searcher(shard: Shard, question: float, answer: float):
    @F.arrow_udf(T.ArrayType(HIT))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(search(batch.to_pylist(), shard, question, answer), _ARROW)
            tidy()

    return run


def _hits(docs: DataFrame, benchmark: DataFrame, threshold: float, question: float, answer: float, shard_items: int, text: str, *keep: Column) -> DataFrame:
    """The ``keep`` columns and ``hit`` of each hit, from a table for each shard."""
    found = []
    small_batches(docs)
    with scratch() as kept:
        for shard in shards(benchmark, threshold, shard_items):
            x = docs.select(*keep, F.explode(searcher(shard, question, answer)(F.col(text))).alias("hit"))
            found.append(kept(cut(x, "hits")))
    if not found:
        return docs.select(*keep, F.lit(None).cast(HIT).alias("hit")).where("false")
    return functools.reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, shard_items: int = 4000) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, score (covered share of the item's
    BM25 weight), question and answer (shares of their shingles; null for a part without words), first_word,
    last_word (of the window).

    Documents without a hit, null and empty texts have no row; so have all if the benchmark is empty. Items without
    a word are never found. Items that repeat id and text are one item; items that only share an id, or have none,
    have a hit each. Rows that repeat a document id have hits of their own. Other columns aren't read.
    """
    return _hits(docs, benchmark, threshold, question, answer, shard_items, "text", F.col("doc_id")).select("doc_id", "hit.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, shard_items: int = 4000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the same columns.

    Whether a text holds one depends on the text alone, so texts are looked up by two 64-bit hashes; rows that surely
    aren't among those with hits are passed on without a shuffle. Null and empty texts hold nothing and stay; long ones
    are searched whole; rows that repeat an id or a text, or have no id, stay or go each by their text. An empty table
    stays empty, and an empty benchmark removes nothing; columns that clash with ours stay as they are.
    """
    key = F.struct(F.xxhash64(F.lit(1), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(text)).alias("b"))
    hits = _hits(docs, benchmark, threshold, question, answer, shard_items, text, key.alias("held")).select("held").distinct()
    names = {c: fresh(docs, c) for c in ("held", "maybe")}
    x = sieved(docs, F.xxhash64(F.lit(1), F.col(text)), hits.select("held.a"), names["maybe"])
    some = x.where(F.col(names["maybe"])).join(hits.select(F.col("held").alias(names["held"])), key == F.col(names["held"]), "left_anti")
    return x.where(~F.col(names["maybe"])).select(*docs.columns).unionByName(some.select(*docs.columns))
