"""Clusters of the pixels of posters: the one step of the palettes that runs in Python.

A task gets whole posters, sorted, and works on blocks of them side by side: points are [poster, pixel, axis], clusters
are counts and sums [poster, cluster]. ``pixels.sampled`` bounds the pixels of a poster before. Each pixel leaves with
its cluster, its connected region, its two neighbours' clusters and its poster's size, so that what follows needs no
window and no join over pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..plans.cut import materialise
from . import pixels as px

LABELLED = "poster long, y int, x int, r int, g int, b int, ll double, la double, lb double, label int, accent boolean, region int, right int, below int, h int, w int"
_IN = ("poster", "y", "x", "r", "g", "b", "ll", "la", "lb")
#: Pixels of the posters that are worked on together, and numbers in the largest array of theirs.
BLOCK_PIXELS, BLOCK_NUMBERS = 60_000, 4_000_000


# How posters are clustered.
@dataclass(frozen=True)
class Clustering:
    """Distances are in the space of the points. ``merge``: clusters closer than this are one, None for none; black
    and white: (limit of lightness, most chroma) of clusters that are one black or one white; accents: clusters of
    vivid pixels that theirs represents badly, at most; trim: the share of the shorter side that is border."""

    k: int = 12
    rounds: int = 30
    merge: float | None = 0.065
    black: tuple[float, float] = (0.22, 0.04)
    white: tuple[float, float] = (0.93, 0.03)
    accents: int = 3
    accent_distance: float = 0.12
    accent_chroma: float = 0.09
    accent_share: float = 0.004
    trim: float = 0.0


V1 = Clustering(k=8, rounds=25, merge=None, accents=0)
V2 = Clustering()
V3 = Clustering(k=16, accents=0, trim=0.03)
LOGO = Clustering(k=6, merge=0.08, accents=0)


def distinct(points: np.ndarray, on: np.ndarray) -> np.ndarray:
    """How many different points each poster has, to three decimals."""
    z = np.rint(points * 1000).astype(np.int64) + (1 << 19)
    key = np.where(on, (z[..., 0] << 40) | (z[..., 1] << 20) | z[..., 2], -1)
    key.sort(axis=1)
    return ((key[:, 1:] != key[:, :-1]) & (key[:, 1:] >= 0)).sum(axis=1) + (key[:, 0] >= 0)


def starts(points: np.ndarray, on: np.ndarray, k: np.ndarray) -> np.ndarray:
    """First centres [poster, k, axis]: with pixels in order of lightness, each next one is where the squared distances
    to those before reach a share of their sum; the shares are spread evenly by the golden ratio."""
    n, most = len(points), int(k.max())
    order = np.argsort(np.where(on, points[..., 0], np.inf), axis=1, kind="stable")
    points, on = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(on, order, 1)
    every, gap = np.arange(n), on.astype(float)
    out = np.full((n, most, points.shape[2]), 1e6)  # places beyond k are far from everything
    for j in range(most):
        upto = np.cumsum(gap, axis=1)
        at = (upto <= (upto[:, -1] * ((j + 1) * 0.6180339887498949 % 1))[:, None]).sum(axis=1)
        chosen = points[every, np.minimum(at, points.shape[1] - 1)]
        out[:, j] = np.where((j < k)[:, None], chosen, 1e6)
        away = ((points - chosen[:, None]) ** 2).sum(axis=2)
        gap = np.where(on, away if j == 0 else np.minimum(gap, away), 0.0)
    return out


def totals(points: np.ndarray, on: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts [poster, cluster] and sums [poster, cluster, axis]."""
    flat = (label + np.arange(len(points))[:, None] * k)[on]
    n = np.bincount(flat, minlength=len(points) * k).reshape(len(points), k)
    sums = [np.bincount(flat, points[..., c][on], len(points) * k).reshape(len(points), k) for c in range(points.shape[2])]
    return n, np.stack(sums, axis=2)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of the centres the nearest, the first of several."""
    best, label = None, None
    for j in range(centres.shape[1]):
        d = ((points - centres[:, None, j]) ** 2).sum(axis=2)
        closer = np.ones(d.shape, bool) if best is None else d < best
        best = d if best is None else np.minimum(best, d)
        label = np.where(closer, j, 0 if label is None else label)
    return label


def k_means(points: np.ndarray, on: np.ndarray, k: np.ndarray, rounds: int) -> np.ndarray:
    """Labels [poster, pixel]; a cluster that loses all its pixels stays where it was."""
    centres, label = starts(points, on, k), None
    for _ in range(rounds):
        now = nearest(points, centres)
        if label is not None and (now == label)[on].all():
            break
        label = now
        n, sums = totals(points, on, label, centres.shape[1])
        centres = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres)
    return label


def merged(n: np.ndarray, sums: np.ndarray, how: Clustering) -> np.ndarray:
    """[poster, cluster]: the cluster that each becomes part of. All near-blacks are one and all near-whites; then the
    closest two join until all are ``merge`` apart. A joined cluster's centre is its members' common mean."""
    n, sums, every = n.copy(), sums.copy(), np.arange(len(n))
    into = np.broadcast_to(np.arange(n.shape[1]), n.shape).copy()

    def join(keep: np.ndarray, gone: np.ndarray, where: np.ndarray) -> None:
        """Cluster ``gone`` of the posters ``where`` becomes part of ``keep``."""
        n[where, keep] += n[where, gone]
        sums[where, keep] += sums[where, gone]
        n[where, gone], sums[where, gone] = 0, 0.0
        into[where] = np.where(into[where] == gone[:, None], keep[:, None], into[where])

    centre = sums / np.maximum(n, 1)[..., None]
    chroma = np.hypot(centre[..., 1], centre[..., 2])
    for alike in ((n > 0) & (centre[..., 0] <= how.black[0]) & (chroma <= how.black[1]), (n > 0) & (centre[..., 0] >= how.white[0]) & (chroma <= how.white[1])):
        first = alike.argmax(axis=1)
        for j in range(1, n.shape[1]):
            where = np.flatnonzero(alike[:, j] & (first < j))
            join(first[where], np.full(len(where), j), where)
    later = np.triu(np.ones((n.shape[1], n.shape[1]), bool), 1)
    left = every
    while len(left):
        centre = sums[left] / np.maximum(n[left], 1)[..., None]
        gap = np.linalg.norm(centre[:, :, None] - centre[:, None], axis=3)
        gap[~(later & (n[left] > 0)[:, :, None] & (n[left] > 0)[:, None])] = np.inf
        at = gap.reshape(len(left), -1).argmin(axis=1)
        close = gap.reshape(len(left), -1)[np.arange(len(left)), at] < how.merge
        left, at = left[close], at[close]
        join(at // n.shape[1], at % n.shape[1], left)
    return into


def accents(points: np.ndarray, on: np.ndarray, label: np.ndarray, k: int, how: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """Labels with the badly represented vivid pixels, where there are enough, in clusters of their own from ``k`` on; and
    whether a pixel's cluster is such a one and large enough itself."""
    n, sums = totals(points, on, label, k)
    own = np.take_along_axis(sums / np.maximum(n, 1)[..., None], np.where(on, label, 0)[..., None], 1)
    out = on & (np.linalg.norm(points - own, axis=2) > how.accent_distance) & (np.hypot(points[..., 1], points[..., 2]) > how.accent_chroma)
    least = how.accent_share * on.sum(axis=1)
    some = np.flatnonzero((out.sum(axis=1) >= least) & out.any(axis=1))
    flag = np.zeros(on.shape, bool)
    if not len(some):
        return label, flag
    p, mine = points[some], out[some]
    part = k_means(p, mine, np.minimum(how.accents, distinct(p, mine)), how.rounds)
    size, _ = totals(p, mine, part, how.accents)
    label = label.copy()
    label[some] = np.where(mine, k + part, label[some])
    flag[some] = mine & (np.take_along_axis(size, part, 1) >= least[some, None])
    return label, flag


def regions(grid: np.ndarray) -> np.ndarray:
    """The connected region of each cell of a grid of labels, by its first cell; cells beside, above and below."""
    found = np.arange(grid.size).reshape(grid.shape)
    side, down = grid[:, 1:] == grid[:, :-1], grid[1:] == grid[:-1]
    while True:
        new = found.copy()
        np.minimum(new[:, 1:], np.where(side, found[:, :-1], grid.size), out=new[:, 1:])
        np.minimum(new[:, :-1], np.where(side, found[:, 1:], grid.size), out=new[:, :-1])
        np.minimum(new[1:], np.where(down, found[:-1], grid.size), out=new[1:])
        np.minimum(new[:-1], np.where(down, found[1:], grid.size), out=new[:-1])
        new = new.ravel()[new]  # and from there to where that one has got
        if (new == found).all():
            return found
        found = new


def labelled_block(cols: dict[str, np.ndarray], how: Clustering) -> dict[str, np.ndarray]:
    """The columns that a block of whole, sorted posters gets."""
    first = np.flatnonzero(np.diff(cols["poster"], prepend=cols["poster"][0] - 1))
    size = np.diff(np.append(first, len(cols["poster"])))
    which, place = np.repeat(np.arange(len(first)), size), np.arange(len(cols["poster"])) - np.repeat(first, size)
    h, w = np.maximum.reduceat(cols["y"], first) + 1, np.maximum.reduceat(cols["x"], first) + 1
    points, on = np.zeros((len(first), int(size.max()), 3)), np.zeros((len(first), int(size.max())), bool)
    points[which, place] = np.stack([cols[c] for c in px.LAB], axis=1)
    edge = np.rint(how.trim * np.minimum(h, w)).astype(int)[which]
    y, x = cols["y"], cols["x"]
    on[which, place] = (y >= edge) & (x >= edge) & (y < h[which] - edge) & (x < w[which] - edge)
    label = k_means(points, on, np.maximum(1, np.minimum(how.k, distinct(points, on))), how.rounds)
    if how.merge is not None:
        label = np.take_along_axis(merged(*totals(points, on, label, how.k), how), label, 1)
    flag = np.zeros(on.shape, bool)
    if how.accents:
        label, flag = accents(points, on, label, how.k, how)
    label = np.where(on, label, -1)[which, place]
    # all posters on one tall grid, with an empty row between them
    top = np.cumsum(np.append(0, h + 1))[:-1]
    grid = np.full((int((h + 1).sum()), int(w.max()) + 1), -1)
    row = top[which] + y
    grid[row, x] = label
    return {
        "label": label, "accent": flag[which, place], "region": regions(grid)[row, x] - (top * grid.shape[1])[which],
        "right": grid[row, x + 1], "below": grid[row + 1, x], "h": h[which], "w": w[which],
    }


def blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.Table]:
    """Whole posters of a sorted stream, a block at a time; ``k``: numbers that are held for each pixel."""
    held: list[pa.RecordBatch] = []

    def give(t: pa.Table) -> Iterator[pa.Table]:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(t.column("poster").to_numpy())) + 1, [len(t)]])
        first, largest = 0, 0
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            largest = max(largest, b - a)
            if i > first and (b - edges[first] > BLOCK_PIXELS or (i + 1 - first) * largest * k > BLOCK_NUMBERS):
                yield t.slice(edges[first], a - edges[first])
                first, largest = i, b - a
        yield t.slice(edges[first])

    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < BLOCK_PIXELS:
            continue
        t = pa.Table.from_batches(held)
        poster = t.column("poster").to_numpy()
        whole = int(np.searchsorted(poster, poster[-1]))  # the last poster may go on
        if whole:
            yield from give(t.slice(0, whole))
        held = t.slice(whole).to_batches()
        size = len(t) - whole
    if held:
        yield from give(pa.Table.from_batches(held))


def _runs(batches: Iterator[pa.RecordBatch], how: Clustering) -> Iterator[pa.RecordBatch]:
    """The pixels of a sorted stream with their clusters."""
    schema = pa.schema([(c, pa.int64() if c == "poster" else pa.float64() if c in px.LAB else pa.bool_() if c == "accent" else pa.int32()) for c in (*_IN, "label", "accent", "region", "right", "below", "h", "w")])
    for block in blocks(batches, how.k):
        part = {c: block.column(c).to_numpy() for c in _IN}
        part |= labelled_block(part, how)
        yield pa.RecordBatch.from_arrays([pa.array(part[f.name]).cast(f.type) for f in schema], schema=schema)


def cluster(pixels: DataFrame, how: Clustering = V2, space: str = "oklab") -> DataFrame:
    """LABELLED: pixels (poster, y, x, r, g, b) with what their clusters are; label -1 in the border. ``space``: oklab,
    or cielab for the first palette version. A poster must be of bounded size: see ``pixels.sampled``."""
    axes = colour.cielab(F.col("r"), F.col("g"), F.col("b")) if space == "cielab" else colour.oklab(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.select(F.col("poster").cast("long").alias("poster"), *[F.col(c).cast("int").alias(c) for c in ("y", "x", "r", "g", "b")])
    rows = rows.withColumns(dict(zip(px.LAB, axes))).repartition("poster").sortWithinPartitions("poster", "y", "x")
    return materialise(rows.mapInArrow(lambda batches: _runs(batches, how), LABELLED), "clusters")
