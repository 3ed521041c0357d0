"""Schemas of the catalogue's tables and of its JSON sources."""

from __future__ import annotations

from pyspark.sql import types as T

ROLES = ("base", "identity1", "identity2", "highlight1", "highlight2", "accent")
SLOTS = ("primary", "secondary", "tertiary")
STATUSES = ("pending", "done", "no_poster", "not_found", "error")
MEDIA = ("movie", "tv")
KINDS = ("series", "movie")
PALETTE_VERSION = 3
MAX_ATTEMPTS = 5

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(*fields: str | T.StructField) -> T.StructType:
    """A schema of 'name type' fields; it needs no session."""
    return T.StructType([x if isinstance(x, T.StructField) else T.StructField(x.split()[0], _KINDS[x.split()[1]]) for x in fields])


def _list(name: str, *fields: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(struct(*fields)))


TITLES = struct(
    "media_type string", "tmdb_id long", "title string", "adult int", "popularity double", "poster_path string", "logo_path string",
    *[f for s in SLOTS for f in (f"{s}_hex string", f"{s}_ratio double")], *[f"{r}_hex string" for r in ROLES],
    "status string", "error string", "attempts int", "palette_version int", "updated_at string",
)
TVDB_TITLES = struct(
    "kind string", "tvdb_id long", "title string", "score double", "image string", "logo string", "status string", "error string", "attempts int", "palette_version int",
    *[f"{r} string" for r in ROLES], "dirty int", "seen int", "updated_at string",
)
STATE = struct("key string", "value string")
MOVIE_EXPORT = struct("id long", "original_title string", "adult boolean", "popularity double")
TV_EXPORT = struct("id long", "original_name string", "adult boolean", "popularity double")
CHANGES = struct(_list("results", "id long"), "page int", "total_pages int")
_IMAGES = T.StructField("images", struct(_list("logos", "file_path string", "iso_639_1 string", "vote_average double", "width int")))
DETAILS = struct("id long", "title string", "name string", "adult boolean", "poster_path string", _IMAGES)
LISTING = struct(_list("data", "id long", "name string", "score double", "image string"), T.StructField("links", struct("next string")))
ARTWORK_TYPES = struct("id int", "name string", "slug string", "recordType string")
ARTWORKS = struct("id long", _list("artworks", "type int", "language string", "score double", "image string"))
MANIFEST = struct("description string", _list("titles", "media_type string", "id long", "name string", "category string", "expect string"))
ARTWORK_TYPE_DOCUMENT = T.StructType([T.StructField("data", T.ArrayType(ARTWORK_TYPES))])
ARTWORK_DOCUMENT = T.StructType([T.StructField("data", ARTWORKS)])
