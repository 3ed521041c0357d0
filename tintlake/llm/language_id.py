"""Operator 1: language spans of mixed text.

A word's script (by code point ranges) narrows the languages it can be of; character n-gram scores of the word rank
what is left; Viterbi with a penalty for each switch labels the words of the whole text. Runs of words with one label
are the spans, and the label with most letters is the document's language.

Words are scored for all documents of an Arrow batch at once with numpy, and Viterbi steps over word positions with
all documents of a block side by side, so Python's work is per position, not per word.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, lowest, small_batches, spread, tidy

# Unicode script ranges (first, last code point).
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
NAMES = ("Other", *SCRIPTS)
#: Buckets of hashed bigrams and trigrams.
BUCKETS = (1 << 13, 1 << 15)
UNKNOWN = "und"
#: Characters of the documents whose words Viterbi labels side by side (a longer text is by itself), and of those whose
#: n-grams are looked up at once, which takes most of the memory.
BLOCK, PART = 2_000_000, 250_000

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])
ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    tables: tuple[np.ndarray, np.ndarray]  # float32 [bucket, lang]: log probability
    allowed: np.ndarray  # bool [script, lang]
    penalty: float


@functools.cache
def code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is part of a word, its lower case, its script, whether it is a mark and no letter."""
    n = 0x110000
    word, lower, script, mark = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8), np.zeros(n, bool)
    for c in range(n):
        x = chr(c)
        mark[c] = c > 0x2FF and unicodedata.category(x)[0] == "M"
        if x.isalpha() or mark[c]:
            word[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = i
    return word, lower, script, mark


@dataclass
class Words:
    start: np.ndarray  # position in the joined text
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    grams: tuple[np.ndarray, np.ndarray]  # bucket of each n-gram
    first: np.ndarray  # index of each word's first n-gram
    offset: np.ndarray  # of each document in the joined text


def words_of(texts: list[str]) -> Words:
    word, lower, scripts, mark = code_points()
    offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word[raw] if len(raw) else np.zeros(0, bool)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    marks = np.cumsum(np.append(0, mark[raw]))
    bare = marks[end] - marks[start] == end - start  # marks without a letter are no word
    if bare.any():
        for a, b in zip(start[bare], end[bare]):
            inside[a:b] = False
        start, end = start[~bare], end[~bare]
    code = np.where(inside, lower[raw], 0).astype(np.uint64)
    one = np.concatenate([[0], code[:-1]]).astype(np.uint64)
    two = np.where(one == 0, 0, np.concatenate([[0, 0], code[:-2]])[: len(code)]).astype(np.uint64)
    at = np.flatnonzero(inside | (one > 0))  # letters, and what follows a word's last letter
    c, one, two = code[at], one[at], two[at]
    pair = one * np.uint64(0x110000) + c
    triple = (two * np.uint64(0x9E3779B97F4A7C15)) ^ pair
    grams = tuple(((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - b.bit_length() + 1)).astype(np.int32) for x, b in zip((pair, triple), BUCKETS))
    return Words(start, end, np.searchsorted(offset, start, "right") - 1, scripts[raw[start]] if len(start) else np.zeros(0, np.uint8), grams, np.searchsorted(at, start), offset)


def blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of the texts, long ones first, in blocks of about BLOCK characters."""
    block, size = [], 0
    for i in sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i])):
        if block and size + len(texts[i]) > BLOCK:
            yield block
            block, size = [], 0
        block.append(i)
        size += len(texts[i])
    if block:
        yield block


def segments(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """(text, position, segment) of all texts, in groups of about PART characters; long texts are cut between words."""
    group, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + PART)
            while end < len(t) and code_points()[0][ord(t[end])]:
                end += 1
            group.append((i, at, t[at:end]))
            size, at = size + end - at, end
            if size >= PART:
                yield group
                group, size = [], 0
    if group:
        yield group


def word_scores(w: Words, model: Model) -> np.ndarray:
    """float32 [word, lang]: log probability of a word's n-grams, relative to the best; languages that don't use
    its script are out of the question."""
    if not len(w.first):
        return np.zeros((0, len(model.langs)), np.float32)
    out = np.add.reduceat(model.tables[0][w.grams[0]] + model.tables[1][w.grams[1]], w.first, axis=0)
    out[~model.allowed[w.script]] -= 1e4
    return out - out.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: words of document after document; lengths: falling, none 0."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    back = np.empty(scores.shape, np.int16)
    label = np.empty(len(scores), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents longer than t
    value = scores[first].copy()
    for t in range(1, lengths[0]):
        n = active[t]
        v = value[:n]
        best = v.argmax(axis=1)
        top = v[np.arange(n), best][:, None] - penalty
        at = first[:n] + t
        back[at] = np.where(v >= top, own, best[:, None])
        value[:n] = np.maximum(v, top) + scores[at]
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return label


def identify(texts: list[str | None], model: Model) -> list[dict]:
    out = [{"lang_pred": UNKNOWN, "score": 0.0, "spans": []} for _ in texts]
    for block in blocks(texts):
        found = []
        for group in segments([texts[i] for i in block]):
            w = words_of([t for _, _, t in group])
            base = np.array([at for _, at, _ in group]) - w.offset[:-1]
            found.append((np.array([i for i, _, _ in group])[w.doc], w.start + base[w.doc], w.end + base[w.doc], word_scores(w, model)))
        doc, start, end, scores = map(np.concatenate, zip(*found))
        if not len(start):
            continue
        docs, lengths = np.unique(doc, return_counts=True)
        order = np.argsort(-lengths, kind="stable")
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        lengths = lengths[order]
        # words, longest document first
        places = np.repeat(heads - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(start))
        label = viterbi(scores[places], lengths, model.penalty)
        doc, start, end = doc[places], start[places], end[places]
        total = np.zeros((len(block), len(model.langs)))
        np.add.at(total, (doc, label), end - start)
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        last = np.append(new[1:], len(doc)) - 1
        for d, a, b, lang in zip(doc[new], start[new], end[last], label[new]):
            out[block[d]]["spans"].append({"start": int(a), "end": int(b), "lang": model.langs[lang]})
        for d in docs:
            best = int(total[d].argmax())
            out[block[d]] |= {"lang_pred": model.langs[best], "score": float(total[d, best] / total[d].sum())}
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: n-gram buckets (kind 0 and 1) and letters by script (kind 2)."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        rows: dict[str, list] = {"lang": [], "kind": [], "bucket": [], "n": []}
        for lang in sorted(set(langs)):
            for group in segments([t for t, x in zip(texts, langs) if x == lang]):
                w = words_of([t for _, _, t in group])
                for kind, found in enumerate((*w.grams, np.repeat(w.script, w.end - w.start))):
                    n = np.bincount(found)
                    some = np.flatnonzero(n)
                    rows["lang"] += [lang] * len(some)
                    rows["kind"] += [kind] * len(some)
                    rows["bucket"] += some.tolist()
                    rows["n"] += n[some].tolist()
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())]))


def train(docs: DataFrame, per_lang: int = 2000, penalty: float = 12.0, least_share: float = 0.005) -> Model | None:
    """A model of the languages in ``docs`` (doc_id, text, lang), from the ``per_lang`` documents of each that hash
    lowest by id and text; that bounds both what is read and the table of counts that the driver gets. Rows that
    repeat a document whole count once. None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", spread("doc_id", spread("text")).alias("h"))
    sample = lowest(known.select("lang", "h").distinct(), "lang", per_lang)
    # at most per_lang rows a language
    texts = known.join(F.broadcast(sample), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")
    found = texts.mapInArrow(_counts, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    langs = tuple(sorted(found.lang.unique()))
    code = found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
    tables = []
    for kind, size in enumerate((*BUCKETS, len(NAMES))):
        n, own = np.zeros((size, len(langs))), (found.kind == kind).to_numpy()
        n[found.bucket.to_numpy()[own], code[own]] = found.n.to_numpy()[own]
        tables.append(n)
    logs = tuple(np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n))).astype(np.float32) for n in tables[:2])
    allowed = tables[2] / np.maximum(1, tables[2].sum(axis=0)) >= least_share
    allowed[~allowed.any(axis=1)] = True  # a script that nothing was learnt of narrows nothing
    return Model(langs, logs, allowed, penalty)


def language_id(docs: DataFrame, model: Model | None, text: str = "text"):
    """The column struct(lang_pred, score, spans) for a text column of ``docs``.

    score: the share of letters in spans of lang_pred. Spans hold positions in the text. Null texts, texts without a
    letter, and any text where there is no model are 'und' with score 0 and no spans.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(T.ArrayType(SPAN)).alias("spans"))

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(identify(batch.to_pylist(), model), ARROW)
            tidy()

    return run(F.col(text))


def predict_languages(docs: DataFrame, per_lang: int = 2000, penalty: float = 12.0) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, spans; learns from the rows that aren't held out.

    Each row is predicted by its own text, so repeated ids and rows are kept. Without labelled rows all is 'und';
    an empty table gives an empty result. Other columns aren't read.
    """
    own = small_batches(docs).select("doc_id", "text", "lang")
    model = train(own.where(~held_out("doc_id")), per_lang, penalty)
    return own.select("doc_id", held_out("doc_id").alias("held_out"), language_id(own, model).alias("r")).select("doc_id", "held_out", "r.*")
