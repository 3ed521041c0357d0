"""Pixel statistics as relational work over (poster, y, x, r, g, b[, label]): grouping, windows and joins.

Posters are sampled to a fixed size, as images or as pixels of any number, so a poster is a bounded group. A gridded
table has labels and the columns of ``on_grid``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour

#: Columns of a colour in OKLab (Spark compares names without case, so not L, A and B beside r, g and b).
LAB = ("ll", "la", "lb")


def with_oklab(pixels: DataFrame) -> DataFrame:
    lightness, a, b = colour.oklab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({"ll": lightness, "la": a, "lb": b})


def from_images(images: DataFrame, width: int = 60, height: int = 90, clear: bool = False) -> DataFrame:
    """(poster, y, x, r, g, b) of decoded images (poster, image struct of Spark's image source), by box averages; with
    ``clear`` also alpha, and colours that aren't laid over white.

    Each cell of the sample is the mean of the image's pixels whose positions fall into it; a smaller image keeps its
    pixels. Grey images repeat their channel, alpha is laid over white; images that can't be decoded have no pixels.
    """
    x = images.where(F.col("image.width") > 0).select("poster", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for poster, h, w, n, data in zip(*[c if i == 4 else c.to_pylist() for i, c in enumerate(batch.columns)]):
                p = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n).astype(float)
                alpha = p[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255.0)
                rgb = p[..., 2::-1] if n >= 3 else np.repeat(p[..., :1], 3, axis=2)  # Spark's order is BGR
                p = np.concatenate([rgb, alpha], axis=2) if clear else rgb * (alpha / 255) + 255 * (1 - alpha / 255)
                rows, columns = min(h, height), min(w, width)
                cells = [np.arange(m) * k // m for m, k in ((h, rows), (w, columns))]
                p = np.add.reduceat(np.add.reduceat(p, np.searchsorted(cells[0], np.arange(rows)), axis=0), np.searchsorted(cells[1], np.arange(columns)), axis=1)
                p = np.rint(p / (np.bincount(cells[0])[:, None, None] * np.bincount(cells[1])[None, :, None])).astype(np.int32).reshape(rows * columns, -1)
                at = np.arange(rows * columns, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([poster] * len(at), pa.int64()), pa.array(at // columns), pa.array(at % columns), *[pa.array(p[:, c]) for c in range(p.shape[1])]], names)

    names = ["poster", "y", "x", "r", "g", "b", *(["alpha"] if clear else [])]
    return x.withColumn("poster", F.col("poster").cast("long")).mapInArrow(run, ", ".join(f"{c} {'long' if c == 'poster' else 'int'}" for c in names))


def triangle(images: DataFrame, width: int = 64, height: int = 96) -> DataFrame:
    """(poster, y, x, r, g, b): the sample of the first palette version, by a triangle filter as wide as two of its
    cells, rows after columns, each rounded to bytes. Alpha is laid over white."""
    x = images.where(F.col("image.width") > 0).select("poster", "image.height", "image.width", "image.nChannels", "image.data")

    def weights(size: int, cells: int) -> np.ndarray:
        scale = size / cells
        reach = max(scale, 1.0)
        centre = (np.arange(cells)[:, None] + 0.5) * scale
        found = np.maximum(0.0, 1 - np.abs(np.arange(size)[None] + 0.5 - centre) / reach)
        return found / found.sum(axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for poster, h, w, n, data in zip(*[c if i == 4 else c.to_pylist() for i, c in enumerate(batch.columns)]):
                p = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n).astype(float)
                alpha = p[..., -1:] / 255 if n in (2, 4) else 1.0
                p = (p[..., 2::-1] if n >= 3 else np.repeat(p[..., :1], 3, axis=2)) * alpha + 255 * (1 - alpha)
                p = np.rint(np.einsum("cw,hwk->hck", weights(w, width), np.rint(p)))
                p = np.rint(np.einsum("rh,hck->rck", weights(h, height), p)).clip(0, 255).astype(np.int32).reshape(-1, 3)
                at = np.arange(len(p), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([poster] * len(at), pa.int64()), pa.array(at // width), pa.array(at % width), *[pa.array(p[:, c]) for c in range(3)]], ["poster", "y", "x", "r", "g", "b"])

    return x.withColumn("poster", F.col("poster").cast("long")).mapInArrow(run, "poster long, y int, x int, r int, g int, b int")


def sampled(pixels: DataFrame, width: int = 60, height: int = 90, by_poster: bool = False) -> DataFrame:
    """Pixels of posters of any size, by box averages of ``width`` x ``height`` cells at most; smaller posters stay as
    they are. Cells are aggregated where the pixels are read, so a poster of any size is a bounded group afterwards.
    ``by_poster``: the pixels are partitioned by poster; then their sizes come from a window, and they are read once."""
    if by_poster:
        whole = Window.partitionBy("poster")
        x = pixels.where("poster IS NOT NULL").withColumns({"h_": F.max("y").over(whole) + 1, "w_": F.max("x").over(whole) + 1})
    else:
        size = pixels.groupBy("poster").agg((F.max("y") + 1).alias("h_"), (F.max("x") + 1).alias("w_"))
        x = pixels.join(size, "poster")
    cell = lambda p, n, most: F.when(F.col(n) > most, F.floor(F.col(p) * most / F.col(n))).otherwise(F.col(p)).cast("int").alias(p)
    more = [c for c in pixels.columns if c not in ("poster", "y", "x")]
    return x.select("poster", cell("y", "h_", height), cell("x", "w_", width), *more).groupBy("poster", "y", "x").agg(*[F.rint(F.avg(c)).cast("int").alias(c) for c in more])


def on_grid(labelled: DataFrame) -> DataFrame:
    """Adds what ``clusters.cluster`` gives besides labels, but for regions: right and below (-1 beyond the edge), h
    and w; for labels that come from elsewhere."""
    size = Window.partitionBy("poster")
    x = labelled.withColumns({
        "right": F.coalesce(F.lead("label").over(Window.partitionBy("poster", "y").orderBy("x")), F.lit(-1)), "below": F.coalesce(F.lead("label").over(Window.partitionBy("poster", "x").orderBy("y")), F.lit(-1)),
        "h": F.max("y").over(size) + 1, "w": F.max("x").over(size) + 1,
    })
    return x if "accent" in labelled.columns else x.withColumn("accent", F.lit(False))


def coverage(labelled: DataFrame) -> DataFrame:
    """(poster, label, n, share, chroma, lightness, lightness_std): each cluster's share, mean chroma, mean and
    population deviation of lightness."""
    g = labelled.groupBy("poster", "label").agg(F.count("*").alias("n"), F.avg(colour.chroma(F.col("la"), F.col("lb"))).alias("chroma"), F.avg("ll").alias("lightness"), F.stddev_pop("ll").alias("lightness_std"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("poster")))


def centre_weight(y: Column, x: Column, height: Column, width: Column, weight: float = 0.3) -> Column:
    dx, dy = (x - (width - 1) / 2) / (width / 2), (y - (height - 1) / 2) / (height / 2)
    return 1.0 - weight * colour.clip((dx * dx + dy * dy) / 2, 0.0, 1.0)


def centred_share(gridded: DataFrame) -> DataFrame:
    """(poster, label, salient): shares by weights that fall off from the centre."""
    g = gridded.groupBy("poster", "label").agg(F.sum(centre_weight(F.col("y"), F.col("x"), F.col("h"), F.col("w"))).alias("wt"))
    return g.select("poster", "label", (F.col("wt") / F.sum("wt").over(Window.partitionBy("poster"))).alias("salient"))


def grid_presence(gridded: DataFrame, columns: int = 4, rows: int = 6, least: float = 0.08) -> DataFrame:
    """(poster, label, spatial): the share of grid cells of which a cluster has at least ``least``. Pixels without a
    cluster count for their cell."""
    cell = lambda p, n, parts: F.floor(((p + 1) * parts - 1) / n).cast("int")  # noqa: E731  cell k holds k*n//parts up to (k+1)*n//parts
    x = gridded.withColumns({"cy": cell(F.col("y"), F.col("h"), rows), "cx": cell(F.col("x"), F.col("w"), columns)})
    n = x.groupBy("poster", "cy", "cx", "label").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("poster", "cy", "cx")))
    return n.groupBy("poster", "label").agg((F.count_if(F.col("share") >= least) / float(columns * rows)).alias("spatial"))


def neighbours(gridded: DataFrame) -> DataFrame:
    """(poster, label, other, n): how often a cluster's pixels have one of another, or of their own, right or below."""
    x = gridded.select("poster", "label", F.explode(F.array("right", "below")).alias("other"))
    return x.where("label >= 0 AND other >= 0").groupBy("poster", "label", "other").agg(F.count("*").alias("n"))


def neighbour_contrast(gridded: DataFrame, centres: DataFrame) -> DataFrame:
    """(poster, label, contrast): the mean colour distance across a cluster's borders; 0 without any."""
    edges = neighbours(gridded).where("label <> other")
    both = edges.unionByName(edges.select("poster", F.col("other").alias("label"), F.col("label").alias("other"), "n"))
    c = lambda p: centres.select("poster", F.col("label").alias(p), *[F.col(k).alias(f"{p}_{k}") for k in LAB])
    x = both.join(c("label"), ["poster", "label"]).join(c("other"), ["poster", "other"])
    gap = colour.distance([F.col(f"label_{k}") for k in LAB], [F.col(f"other_{k}") for k in LAB])
    found = x.groupBy("poster", "label").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("contrast"))
    return centres.select("poster", "label").join(found, ["poster", "label"], "left").fillna(0.0, ["contrast"])


def coherence(gridded: DataFrame) -> DataFrame:
    """(poster, label, coherence): of a cluster's neighbour pairs, the share within it."""
    x = neighbours(gridded)
    pairs = x.unionByName(x.where("label <> other").select("poster", F.col("other").alias("label"), F.col("label").alias("other"), "n"))
    return pairs.groupBy("poster", "label").agg((F.sum(F.when(F.col("label") == F.col("other"), F.col("n")).otherwise(0)) / F.sum("n")).alias("coherence"))


def largest_region(labelled: DataFrame) -> DataFrame:
    """(poster, label, region_share): the share of a cluster's pixels that lie in its largest connected region."""
    n = labelled.where("label >= 0").groupBy("poster", "label", "region").agg(F.count("*").alias("n"))
    return n.groupBy("poster", "label").agg((F.max("n") / F.sum("n")).alias("region_share"))


def centres(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("poster", "label").agg(*[F.avg(c).alias(c) for c in LAB])


def centre_distances(c: DataFrame) -> DataFrame:
    """(poster, label, other, distance) of the clusters of one poster; a poster has 16 at most."""
    o = c.select("poster", F.col("label").alias("other"), *[F.col(k).alias(f"o{k}") for k in LAB])
    gap = colour.distance([F.col(k) for k in LAB], [F.col(f"o{k}") for k in LAB])
    return c.join(o, "poster").where("label < other").select("poster", "label", "other", gap.alias("distance"))
