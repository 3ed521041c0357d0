"""String functions of the catalogue as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_url(path: Column, base: str) -> Column:
    """null and '' are null; http addresses stay; others are below ``base``."""
    below = F.concat(F.lit(base), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(path.isNull() | (path == ""), None).when(path.startswith("http"), path).otherwise(below)


def thumbnail_url(url: Column) -> Column:
    """``_t`` before the extension, if there is one after the last slash."""
    return F.regexp_replace(url, r"^(.*)\.([^./]*)$", "$1_t.$2")


def literal_pattern(q: str) -> str:
    """A LIKE pattern for texts that contain ``q`` itself, escaped with a backslash."""
    for c in "\\%_":
        q = q.replace(c, "\\" + c)
    return f"%{q}%"


def pair_key(poster: Column, logo: Column) -> Column:
    """The key of a poster and logo pair; no logo is ''."""
    return F.concat(poster, F.lit("|"), F.coalesce(logo, F.lit("")))


def title_or_name(title: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), name)


def short_error(message: Column) -> Column:
    return F.substring(message, 1, 500)


def is_true(value: Column, default: bool) -> Column:
    """1, true, yes and on are true; null and '' are the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isNull() | (v == ""), F.lit(default)).otherwise(v.isin("1", "true", "yes", "on"))


def csv_set(value: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""))


def is_clear_logo(name: Column, slug: Column) -> Column:
    """Whether an artwork type is a transparent logo: its name and slug without spaces contain 'clearlogo'."""
    return F.replace(F.lower(F.concat_ws(" ", name, slug)), F.lit(" "), F.lit("")).contains("clearlogo")
