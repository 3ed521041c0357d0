"""The choice of a title's logo, and the types of artwork that are logos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_clear_logo


def logo_order(path: Column, language: Column, vote: Column, width: Column, place: Column) -> Column:
    """What a title's logos are ordered by, the best first; null for what is no PNG. Its last field is the path, so the
    least of a group is the title's logo, and groups of any size are reduced where they are read."""
    rank = F.when(language == "en", 0).when(language.isNull(), 1).otherwise(2)
    key = F.struct(rank.alias("r"), (-F.coalesce(vote, F.lit(0.0))).alias("v"), (-F.coalesce(width, F.lit(0))).alias("w"), place.alias("i"), path.alias("path"))
    return F.when(F.lower(path).endswith(".png"), key)


def artwork_order(image: Column, type_: Column, types: Column, language: Column, score: Column, place: Column) -> Column:
    """The same for artworks of some types: by language and score."""
    rank = F.when(language == "eng", 0).when(language.isNull() | (language == ""), 1).otherwise(2)
    key = F.struct(rank.alias("r"), (-F.coalesce(score, F.lit(0.0))).alias("s"), place.alias("i"), image.alias("image"))
    return F.when(F.array_contains(types, type_) & image.isNotNull(), key)


def best_logo(logos: Column) -> Column:
    """The path of the best PNG of an array of (file_path, iso_639_1, vote_average, width): English, then without a
    language, then others; by vote, then width, then place."""
    return F.array_min(F.transform(logos, lambda x, i: logo_order(x.file_path, x.iso_639_1, x.vote_average, x.width, i))).path


def best_artwork(artworks: Column, types: Column) -> Column:
    """The image of the best artwork of some types: English, then without a language, then others; by score, then place."""
    return F.array_min(F.transform(artworks, lambda x, i: artwork_order(x.image, x["type"], types, x.language, x.score, i))).image


def logo_types(types: DataFrame) -> DataFrame:
    """(recordType, types): the ids of the artwork types that are transparent logos, per record type."""
    return types.where(is_clear_logo(F.col("name"), F.col("slug"))).groupBy("recordType").agg(F.array_sort(F.collect_set("id")).alias("types"))
