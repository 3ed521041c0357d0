"""The review of palettes over a folder of posters: all three versions side by side, what looks wrong, and a summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, palettes, pixels, roles
from ..schemas import ROLES, SLOTS
from ..sources import listings
from .cut import materialise

#: What each version samples a poster to: the first by a triangle filter, the others by box averages.
SIZES = {"v1": (64, 96), "v2": (60, 90), "v3": (80, 120)}


def compared(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of decoded images (file, poster, image) a row each: file, the swatches of the first two versions, the roles, ladder
    and sources of the third, flags; and the second version's candidates, a row each."""
    shown = images.select("poster", "image")
    one = palettes.palette_v1(clusters.cluster(pixels.triangle(shown, *SIZES["v1"]), clusters.V1, "cielab"))
    x = clusters.cluster(pixels.from_images(shown, *SIZES["v2"]), clusters.V2)
    two = materialise(palettes.palette_v2(x), "second")
    three = roles.palette_v3(clusters.cluster(pixels.from_images(shown, *SIZES["v3"]), clusters.V3), detail=True)
    rows = images.select("file", "poster").join(one.select("poster", *[F.col(f"{s}_{k}").alias(f"v1_{s}_{k}") for s in SLOTS for k in ("hex", "ratio")]), "poster")
    rows = rows.join(two.select("poster", *[c for s in SLOTS for c in (F.col(f"{s}_hex").alias(f"v2_{s}_hex"), F.round(f"{s}_coverage", 4).alias(f"v2_{s}_ratio"))]), "poster")
    rows = rows.join(three.select("poster", *ROLES, "sources", "ladder", "logo"), "poster").join(palettes.review_flags(two, x), "poster")
    return rows, palettes.report_rows(two, x)


def report(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """``compared`` of the images of a folder that can be decoded, and a summary: posters, those whose primary colour the
    second version changed, flagged ones, and what a poster took on average, in ms of wall-clock time."""
    began, rows, candidates = time.perf_counter(), None, None
    for images in listings.images_named(spark, listings.image_paths(spark, folder)):
        x = images.where("image.width > 0").withColumn("poster", F.xxhash64("file"))
        part, more = (materialise(y, "report") for y in compared(x))
        rows, candidates = (part, more) if rows is None else (rows.unionAll(part), candidates.unionAll(more))
    if rows is None:
        raise ValueError(f"there are no images in {folder}")
    n = rows.agg(F.count("*").alias("posters"), F.count_if(F.col("v1_primary_hex") != F.col("v2_primary_hex")).alias("changed_primary"), F.count_if(F.size("flags") > 0).alias("flagged")).first()
    return rows, candidates, n.asDict() | {"mean_ms": round(1000 * (time.perf_counter() - began) / max(1, n.posters), 1)}
