"""Operator 2: a quality score learnt from preference pairs (Bradley-Terry), thresholded at a score quantile.

A document's strength is linear in its features. A pair of a document labelled 1 and one labelled 0 is a preference;
the logistic loss of the pair's strength difference is minimised. The cut is a quantile of the strengths of all labelled
documents that may be learnt from; its level is the one that classifies them best, and both come from one histogram. The
score is the logistic function placed so that the cut scores ``at``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, held_out, lowest, sieved, small_batches, spread, tidy
from .quality_rules import measure

_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "mark": b"!", "bar": b"|", "stop": b".,;:?", "symbol": b"#*$%&<>@~^_=+\\{}[]"}
_OTHERS = {k: bytes(v) for k, v in _KINDS.items()}


#: Buckets of hashed byte trigrams; texts whose features, and pairs whose differences, are held at once.
GRAMS, ROWS = 256, 512


def grams(data: bytes) -> np.ndarray:
    """Roots of the shares of hashed trigrams of bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(GRAMS)
    h = ((x[:-2] << 16) ^ (x[1:-1] << 8) ^ x[2:]) * np.uint32(0x9E3779B1)
    return np.sqrt(np.bincount(h >> 24, minlength=GRAMS) / len(h))


def features(text: str | None) -> np.ndarray:
    """Rates of a whole text, each also as its square root, which tells small rates apart; its length; its trigrams."""
    data = (text or "").encode()
    words = data.split()
    n, letters, _, dup_lines, repeated = measure(text)
    w, size = max(1, len(words)), max(1, len(data))
    count = {k: len(data) - len(data.translate(None, v)) for k, v in _OTHERS.items()}
    rates = [
        count["symbol"] / size,
        count["mark"] / w,
        count["bar"] / w,
        count["upper"] / size,
        count["digit"] / size,
        count["stop"] / w,
        sum(map(bytes.isupper, words)) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        dup_lines / w,
        repeated / w,
        1 - len(set(words)) / w,
        min(letters / w, 50.0) / 50,
    ]
    return np.concatenate([rates, np.sqrt(rates), [math.log1p(n)], grams(data)])


N_FEATURES = len(features("a"))


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float
    level: float = 0.0  # the share of labelled strengths below the cut

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    @property
    def most(self) -> float:
        """No strength is greater, or less than its negative."""
        return max(1e-9, 6 * float(np.abs(self.weights).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.strengths(x) - self.cut + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, at: float = 0.3, n_pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 25) -> Ranker | None:
    """The weights, from a sample of labelled documents; the cut is 0 until ``cut_at`` sets it."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(0)
    better, worse = rng.choice(good, n_pairs), rng.choice(bad, n_pairs)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton steps of the convex loss
        gradient, curve = ridge * w, ridge * np.eye(len(w))
        for i in range(0, n_pairs, ROWS):
            d = z[better[i : i + ROWS]] - z[worse[i : i + ROWS]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient -= (p @ d) / n_pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / n_pairs
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4 / max(1e-9, float(np.linalg.norm(step))))
        if float(np.abs(step).max()) < 1e-6:
            break
    return Ranker(mean, scale, w, 0.0, at)


def best_level(good: np.ndarray, bad: np.ndarray) -> float:
    """The quantile level, of all strengths, at which cutting is least wrong; of equal ones the middle. good, bad:
    documents of label 1 and 0 by bin of strength."""
    below = lambda n: np.append(0, np.cumsum(n))
    errors = below(good) + bad.sum() - below(bad)
    least = np.flatnonzero(errors == errors.min())
    least = least[: 1 + int((np.diff(least) != 1).argmax())] if (np.diff(least) != 1).any() else least  # the first in a row
    return float(below(good + bad)[least[len(least) // 2]] / max(1, (good + bad).sum()))


def quantile_bin(n: np.ndarray, level: float) -> int:
    """The bin at whose lower end ``level`` of all lie below; where bins are empty there, the middle of the gap. Strengths
    of one bin are never parted."""
    below = np.append(0, np.cumsum(n))
    at = np.flatnonzero(below == below[np.abs(below - level * n.sum()).argmin()])
    return int(at[0] + at[-1]) // 2


def _each(f: Callable[[np.ndarray], np.ndarray]):
    """A column of numbers from the features of a text column."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [batch[i : i + ROWS] for i in range(0, len(batch), ROWS)]
            yield pa.array(np.concatenate([f(np.array([features(t.as_py()) for t in p])) for p in parts] or [np.zeros(0)]), pa.float64())
            tidy()

    return run


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def feature_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([features(x.as_py()) for x in batch], pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, at: float = 0.3) -> Ranker | None:
    """Learns from labelled rows that aren't held out. The weights are fitted on the ``per_class`` documents of each
    label whose id hashes lowest, one text of each id, which bounds the rows that come to the driver; the cut comes
    from the strengths of all of them. A repeated id counts with its lowest label. None without both labels."""
    small_batches(docs)
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = cut(rows.withColumn("h", spread("doc_id")), "labelled")
    # at most 2 * per_class rows
    sample = F.broadcast(lowest(rows, "quality", per_class).select("doc_id", "quality"))
    one = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", spread("text")).alias("text"))
    found = one.orderBy("doc_id").select("quality", feature_column("text").alias("x")).toArrow().combine_chunks()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES) if len(found) else np.zeros((0, N_FEATURES))
    ranker = fit(x, found.column("quality").to_numpy(), at)
    return ranker and cut_at(ranker, docs, rows)


def cut_at(ranker: Ranker, docs: DataFrame, rows: DataFrame, bins: int = 1 << 16) -> Ranker:
    """``ranker`` with the quantile of the strengths of all ``rows``' documents (doc_id, quality, h) that classifies them
    best. Texts aren't shuffled: a sieve of ids keeps unlabelled ones from being scored, and what is joined is (id, bin)."""
    some = sieved(docs.select("doc_id", "text"), spread("doc_id"), rows.select("h"), "maybe").where("maybe")
    place = F.least(F.lit(bins - 1), F.floor((_each(ranker.strengths)("text") / ranker.most + 1) * (bins / 2)))
    scored = some.select("doc_id", place.alias("bin")).distinct().join(rows, "doc_id")
    n = np.zeros((2, bins), np.int64)
    for r in scored.groupBy("quality", "bin").count().collect():  # two rows a bin at most
        n[r.quality, r.bin] = r["count"]
    level = best_level(n[1], n[0])
    return replace(ranker, cut=(quantile_bin(n.sum(axis=0), level) / (bins / 2) - 1) * ranker.most, level=level)


def score(text: str | Column, ranker: Ranker | None, at: float = 0.3) -> Column:
    """The score column of a text column; ``at`` everywhere without a ranker."""
    return F.lit(at) if ranker is None else _each(ranker.scores)(F.col(text) if isinstance(text, str) else text)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4000, at: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= ``at``).

    Every row is scored by its own text; null counts as empty text. Empty tables give an empty result; without both
    labels all score ``at``. Other columns aren't read.
    """
    ranker = train(docs, labels, per_class, at)
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text", ranker, at).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4000, at: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier, learnt from them, doesn't reject, with the same columns.

    Each row is judged by its own whole text, however long; null and empty texts are alike and go, once they score below
    ``at``. Rows that repeat an id, or have none, are judged each by itself; only labels go by id. Without both labels
    all rows stay. An empty table stays empty; columns that clash with the score's name stay as they are.
    """
    ranker, name = train(docs, labels, per_class, at), fresh(docs, "score")
    return docs.withColumn(name, score("text", ranker, at)).where(F.col(name) >= at).select(*docs.columns)
